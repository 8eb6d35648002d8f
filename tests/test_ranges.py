"""Running values, attention, cooldown chains, quantiles and the ring, in many blocks, against brute force."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatterflow.operators import attention, cooldown, prices, ranges, signals, stats
from chatterflow.plans.queries import QUERIES

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def blocks(spark):
    """Many small ranges."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_running_values(spark, blocks):
    draw = random.Random(1)
    rows = [(draw.choice(["a", "a", "a", "b", None]), i, draw.choice([None, draw.randrange(50)])) for i in range(300)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, v long")
    values = {"total": ("sum", "v"), "least": ("min", "v"), "seen": ("last", "v")}
    for before in (False, True):
        got = {r.i: (r.total, r.least, r.seen) for r in ranges.running(df, ["k"], ["i"], values, before).collect()}
        for k in ("a", "b", None):
            past = []
            for i, v in sorted(((i, v) for kk, i, v in rows if kk == k), key=lambda r: r[0]):
                past += [] if before else [v]
                there = [x for x in past if x is not None]
                assert got[i] == (sum(there), min(there, default=None), there[-1] if there else None)
                past += [v] if before else []
    ranked = {r.i: r.n for r in ranges.numbered(df, [], [F.desc("i")], "n").collect()}
    assert ranked == {i: 300 - i for i in range(300)}
    assert len({r._part for r in ranges.placed(df.filter("k = 'a'"), ["k"], ["i"]).select("_part").collect()}) > 4  # a key is spread
    assert ranges.running(df.filter("i < 0"), ["k"], ["i"], values).collect() == []


def brute_attention(events, mentions, runs, n, days=30):
    out = {}
    for name, ticker, at in events:
        later = {r: c for r, done, c in runs if done is not None and at < done <= at + dt.timedelta(days=days)}
        pool = [m for m in mentions if m[1] is not None and m[1] > at and (not later or m[2] in later)]
        own = [m for m in pool if m[0] == ticker]
        near = [m for m in own if m[1] <= at + dt.timedelta(days=n)]
        all_ = [m for m in pool if m[1] <= at + dt.timedelta(days=n)]
        once = lambda i, rows: len({m[i] for m in rows if m[i] is not None})
        mean = sum(c or 0 for c in later.values()) / len(later) if later else None
        label = "Low" if mean is None else "High" if mean >= 0.8 else "Medium" if mean >= 0.5 else "Low"
        label = "Medium" if mean is None and once(5, own) >= 2 and once(3, own) >= 2 else label
        out[name] = ("measurement" if later else "corpus", len(near), once(3, near), once(4, near), once(5, near), len(all_), label)
    return out


@pytest.mark.parametrize("one_day", [False, True])
def test_attention_in_both_scopes(spark, blocks, one_day):
    draw = random.Random(7)
    step = dt.timedelta(minutes=11) if one_day else dt.timedelta(hours=7)
    when = lambda n: START + draw.randrange(n) * step
    runs = [(f"r{i}", when(200) if i else None, draw.choice([0.9, 0.6, 0.2, None])) for i in range(8)]
    mentions = [(draw.choice("TTTU"), draw.choice([None] + [when(240)] * 9), f"r{draw.randrange(12)}", *(draw.choice([None, *(f"{c}{i}" for i in range(k))]) for c, k in (("t", 9), ("a", 25), ("s", 3)))) for _ in range(500)]
    events = [(f"e{i}", draw.choice("TTUV"), when(220)) for i in range(160)]
    m = spark.createDataFrame(mentions, "ticker string, created_time timestamp, analysis_run_id string, thread_id string, author_hash string, source_name string")
    e = spark.createDataFrame([*events, ("none", None, START), ("never", "T", None)], "signal_id string, ticker string, signal_time timestamp")
    r = spark.createDataFrame(runs, "analysis_run_id string, completed_at timestamp, coverage_reliability double")
    got = {x.signal_id: x for x in attention.attention(e, m, r).collect()}
    assert set(got) == {name for name, _, _ in events} and {x.scope for x in got.values()} == {"measurement", "corpus"}
    for n in (7, 14, 30):
        for name, want in brute_attention(events, mentions, runs, n).items():
            x = got[name]
            assert (x.scope, *(x[f"{k}_{n}d"] for k in ("mentions", "threads", "authors", "sources", "universe")), x.attention_reliability) == want, (name, n)
            assert x[f"share_{n}d"] == (pytest.approx(100 * want[1] / want[5], abs=0.00051) if want[5] else None)
    empty = attention.attention(e, m.filter("false"), r.filter("false")).collect()
    assert all(x.mentions_30d == 0 and x.share_30d is None and x.attention_reliability == "Low" for x in empty) and len(empty) == 160


def loop(rows):
    """(ticker, id, time, strength, run, manual) in order, with the last accepted event."""
    want, last = set(), {}
    first = lambda v: (v is not None, v or START)
    for ticker, name, at, strength, run, manual in sorted(rows, key=lambda r: (r[0], first(r[2]), r[1])):
        if ticker in last:
            t, s, old = last[ticker]
            stronger = s is not None and strength is not None and strength >= s + 12
            if not ((run is None or run != old) and (manual or t is None or at is None or at - t > dt.timedelta(hours=24) or stronger)):
                continue
        last[ticker] = at, strength, run
        want.add(name)
    return want


@pytest.mark.parametrize(("minutes", "runs", "top"), [(40_000, 400, 60), (3_000, 12, 60), (200_000, 3, 8), (4_000, 2, 200)])
def test_cooldown_chains_over_blocks(spark, blocks, minutes, runs, top, monkeypatch):
    monkeypatch.setattr(cooldown, "CHUNK", 7)
    draw = random.Random(minutes)
    rows = [("HHHHHHABC"[i % 9], f"s{i:04}", draw.choice([None] + [START + dt.timedelta(minutes=draw.randrange(minutes))] * 40), draw.choice([None, *[float(draw.randrange(top))] * 20]), draw.choice([None, *(f"r{draw.randrange(runs)}" for _ in range(9))]), draw.random() < 0.02) for i in range(1500)]
    df = spark.createDataFrame(rows, "ticker string, signal_id string, signal_time timestamp, strength double, analysis_run_id string, manual boolean")
    out = cooldown.cooldown(df)
    assert {r.signal_id for r in out.collect()} == loop(rows) and out.columns == df.columns
    narrow = df.select("ticker", "signal_id", "signal_time", "strength")
    assert {r.signal_id for r in cooldown.cooldown(narrow).collect()} == loop([(*r[:4], None, False) for r in rows])
    assert len({r._part for r in ranges.placed(df.filter("ticker = 'H'"), ["ticker"], ["signal_time", "signal_id"]).select("_part").collect()}) > 4


def test_cooldown_of_nothing(spark):
    assert cooldown.cooldown(spark.createDataFrame([(None, "a", START, 1.0)], "ticker string, signal_id string, signal_time timestamp, strength double")).collect() == []


def test_quantiles_by_selection(spark, monkeypatch):
    monkeypatch.setattr(stats, "FEW", 20)
    monkeypatch.setattr(stats, "BINS", 8)
    rng = np.random.default_rng(3)
    n = 3000
    columns = {
        "even": rng.uniform(-5, 5, n), "tail": np.exp(rng.normal(0, 60, n)), "below": -np.exp(rng.normal(0, 60, n)), "ties": rng.integers(-2, 3, n).astype(float), "one": np.full(n, 7.25),
        "close": 1 + rng.integers(0, 50, n) * 2.0**-52, "odd": np.where(rng.random(n) < 0.2, np.inf, np.where(rng.random(n) < 0.2, -np.inf, rng.normal(0, 1, n))), "zeros": np.where(rng.random(n) < 0.9, 0.0, rng.normal(0, 1e-300, n)),
    }
    data = [tuple(float(columns[c][i]) if draw else None for c in columns) for i, draw in enumerate(rng.random(n) < 0.9)]
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in columns))
    shares = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = stats.quantiles(df, list(columns), shares)
    for k, c in enumerate(columns):
        v = np.sort([r[k] for r in data if r[k] is not None])
        for s in shares:
            at = s * (len(v) - 1)
            part = at - math.floor(at)
            want = v[math.floor(at)] * (1 - part) + v[math.ceil(at)] * part if part else v[int(at)]
            assert got[c][s] == want or (math.isnan(got[c][s]) and math.isnan(want)), (c, s)
    assert stats.quantiles(df.filter("false"), ["even"], shares) == {"even": {}}
    row = stats.quartiles(df.filter("false"), ["even"]).first()
    assert tuple(row) == ("even", None, None, None, None, None)
    for q in (stats.quartiles(df, ["even"]), stats.descriptive(df, ["even"])):
        plan = q._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile" not in plan and "median(" not in plan


def test_benchmark_ring(spark, blocks):
    sha = lambda x: hashlib.sha1(x.encode()).hexdigest()
    for size in (0, 1, 2, 5, 60):
        catalog = [f"T{i}" for i in range(size)]
        ring = sorted(catalog, key=sha)
        events = [(f"e{i}", "T1" if i % 3 else "other") for i in range(40)]
        e = spark.createDataFrame(events, "signal_id string, ticker string")
        got = {}
        for r in signals.random_benchmark(e, spark.createDataFrame([(t,) for t in catalog + catalog], "ticker string"), 4).collect():
            got.setdefault(r.signal_id, []).append((r.sample_index, r.benchmark_ticker))
        for name, own in events:
            start = sum(sha(t) < sha(name) for t in ring)
            want = [t for t in (ring[start:] + ring[:start]) if t != own][:4]
            assert sorted(got.get(name, [])) == list(enumerate(want, 1))


@pytest.mark.parametrize("tickers", [4096, 7])
def test_benchmark_draws_from_the_whole_catalog(spark, blocks, monkeypatch, tickers):
    monkeypatch.setattr(signals, "TICKERS", tickers)
    monkeypatch.setattr(signals, "PAIRS", 50)
    sha = lambda x: hashlib.sha1(x.encode()).hexdigest()
    for size in (0, 1, 2, 5, 60):
        catalog = [f"T{i}é" for i in range(size)]
        events = [(f"e{i}", [None, "T1é", "other"][i % 3]) for i in range(40)]
        e = spark.createDataFrame(events + events[:9], "signal_id string, ticker string")
        got = {}
        for r in signals.drawn_benchmark(e, spark.createDataFrame([(t,) for t in [*catalog, *catalog, "", None]], "ticker string"), 4).collect():
            got.setdefault((r.signal_id, r.ticker), []).append((r.sample_index, r.benchmark_ticker))
        for name, own in events:
            want = sorted((t for t in catalog if t != own), key=lambda t: sha(name + t))[:4]
            assert sorted(got.get((name, own), [])) == list(enumerate(want, 1))
        assert size != 60 or len({frozenset(t for _, t in v) for v in got.values()}) == 40  # an arc would have neighbours in common


def test_benchmark_query_draws_for_each_event(spark):
    bars = [r.p_brand for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").join(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"), F.expr("p_partkey = l_partkey")).select("p_brand").distinct().collect()]
    sample = QUERIES["random_benchmark"](spark, "/root/testdata/sf0.001").collect()
    got = {}
    for r in sample:
        got.setdefault(r.signal_id, {})[r.sample_index] = r.benchmark_ticker
    assert len(got) == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    for name, at in got.items():
        want = sorted(bars, key=lambda t: hashlib.sha1((name + t).encode()).hexdigest())[:12]
        assert [at[k] for k in sorted(at)] == want


def test_asof_spreads_a_ticker(spark, blocks):
    draw = random.Random(9)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    bars = [(t, day(n), float(n)) for t in ("H", "L") for n in sorted(draw.sample(range(100), 30))]
    events = [(i, draw.choice("HHHHHHHHL"), draw.choice([None] + [day(draw.randrange(110))] * 20)) for i in range(600)]
    p = spark.createDataFrame(bars, "ticker string, date date, close double")
    e = spark.createDataFrame(events, "id long, ticker string, day date")
    for r in prices.asof_forward(e, p, "day", ["close"]).collect():
        want = min((b[1:] for b in bars if r.day is not None and b[0] == r.ticker and b[1] >= r.day), default=(None, None))
        assert (r.price_date, r.close) == want
    assert prices.calendar_returns(e, p, "id", "day", (7,)).count() == 600


def test_market_outcomes_of_one_event(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    bars = [("T", day(n), 10.0 + n, None if n % 2 else 20.0 + n, 100.0 * (n % 5 + 1)) for n in range(60)] + [("B", day(n), 50.0, 50.0 + n, 1.0) for n in range(60)]
    p = spark.createDataFrame(bars, "ticker string, date date, close double, adjusted_close double, volume double")
    e = spark.createDataFrame([("a", "T", day(26)), ("b", "T", day(0)), ("c", "X", day(3)), ("d", "T", None)], "id string, ticker string, day date")
    got = {r.id: r for r in prices.market_outcomes(e, p, "id", "day", "B").collect()}
    ref = lambda n: 10.0 + n if n % 2 else 20.0 + n
    base = sum(100.0 * (n % 5 + 1) for n in range(6, 26)) / 20
    a = got["a"]
    assert a.price_at_signal == ref(26) and a.return_7d == round(ref(33) / ref(26) - 1, 4) and a.excess_return_7d == round(a.return_7d - round(83 / 76 - 1, 4), 4)
    assert a.max_gain_7d == round(ref(32) / ref(26) - 1, 4) and a.max_drawdown_7d == round(ref(27) / ref(26) - 1, 4)
    assert a.volume_spike_3d == round(500 / base, 4) and a.abnormal_volume_7d == round(sum(100.0 * (n % 5 + 1) for n in range(27, 34)) / 7 / base, 4)
    assert got["b"].volume_spike_3d is None and got["b"].return_30d is not None
    assert got["c"].price_at_signal is None and got["d"].price_at_signal is None and got["c"].benchmark_return_7d is not None
