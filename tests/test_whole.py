"""Operators against brute force on small tables, and queries over all rows."""

import datetime as dt
import random

import numpy as np
import pytest
from test_queries import SF

from chatterflow.operators import cooldown, stats
from chatterflow.plans import adapters as A
from chatterflow.plans.queries import QUERIES

def test_union_covers_every_mention(spark):
    first = {}
    for r in A.mentions(spark, SF).collect():
        new = (r.item_type != "post", r.item_id, r.item_type)
        first[r.thread_id, r.ticker] = min(first.get((r.thread_id, r.ticker), new), new)
    got = [((r.thread_id, r.ticker), (r.item_id, r.kind)) for r in QUERIES["union_dedupe"](spark, SF).collect()]
    assert len(got) == len(first) and dict(got) == {k: v[1:] for k, v in first.items()}


def test_cooldown_streams_and_equals_a_loop(spark):
    draw = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    listed = [("TU"[i % 9 == 0], f"s{i}", start + dt.timedelta(minutes=draw.randrange(90_000)), float(draw.randrange(60))) for i in range(25_000)]
    events = spark.createDataFrame(listed, "ticker string, signal_id string, signal_time timestamp, strength double")
    want, last = set(), {}
    for ticker, name, at, strength in sorted(listed, key=lambda r: (r[0], r[2], r[1])):
        t, s = last.get(ticker, (None, None))
        if t is None or at - t > dt.timedelta(hours=24) or strength >= s + 12:
            last[ticker] = at, strength
            want.add(name)
    df = cooldown.cooldown(events)
    assert {r.signal_id for r in df.collect()} == want and df.columns == events.columns
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("ranks", [1 << 12, 4])
def test_kendall_equals_all_pairs(spark, monkeypatch, ranks):
    monkeypatch.setattr(stats, "RANKS", ranks)
    draw = random.Random(5)
    grid = {(s, o): [(float(draw.randrange(20)), float(draw.randrange(30))) for _ in range(n)] for s, o, n in (("a", "b", 150), ("a", "c", 90), ("d", "b", 1), ("d", "c", 2))}
    df = spark.createDataFrame([(*k, *v) for k, vs in grid.items() for v in vs], "signal string, outcome string, x double, y double")
    sign = lambda v: (v > 0) - (v < 0)
    found = stats.kendall_grid(df)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    for r in found.collect():
        v = grid[r.signal, r.outcome]
        both = [(sign(b[0] - a[0]), sign(b[1] - a[1])) for i, a in enumerate(v) for b in v[i + 1 :]]
        bottom = (sum(x != 0 for x, _ in both) * sum(y != 0 for _, y in both)) ** 0.5
        want = sum(x * y for x, y in both) / bottom if bottom else None
        assert r.sample_size == len(v) and r.correlation == (pytest.approx(want, abs=1e-6) if bottom else None)


def test_rolling_over_all_tickers_crosses_blocks(spark, monkeypatch):
    monkeypatch.setattr(stats, "RANKS", 16)
    draw = random.Random(6)
    rows = [(dt.date(2024, 1, 1 + i // 9), f"t{i % 9}", float(draw.randrange(50)), float(draw.randrange(50)) if i % 7 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "bucket_start date, ticker string, x double, y double")
    got = {(r.bucket_start, r.ticker): (r.rows_in_window, r.rolling_correlation) for r in stats.rolling_correlation(df, "x", "y", ["bucket_start", "ticker"], 10).collect()}
    full = [r for r in sorted(rows) if r[3] is not None]
    assert len(got) == len(full)
    for i, r in enumerate(full):
        w = full[max(0, i - 9) : i + 1]
        n, r_ = got[r[0], r[1]]
        assert n == len(w)
        assert r_ is None if n < 8 else r_ == pytest.approx(np.corrcoef([v[2] for v in w], [v[3] for v in w])[0, 1], abs=1e-5)


def test_manual_and_same_run_in_the_cooldown(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [("T", "a", at(0), 10.0, "r1", False), ("T", "b", at(30), 90.0, "r1", True), ("T", "c", at(31), 1.0, "r2", True), ("T", "d", at(55), 5.0, "r3", False), ("T", "e", at(55.5), 5.0, "r4", False)]
    df = spark.createDataFrame(rows, "ticker string, signal_id string, signal_time timestamp, strength double, analysis_run_id string, manual boolean")
    assert [r.signal_id for r in cooldown.cooldown(df).orderBy("signal_id").collect()] == ["a", "c", "e"]
