"""Attention after a signal: mentions, threads, authors, sources and share of voice in its scope (DF11, JN17-19, SC18, SC22).

Where measurement runs complete within ``days`` after an event, only their mentions count, for the ticker and for all tickers;
else every mention does. Nothing is paired. A mention made at m by a run completed at c counts in a window of n days for the
events in [max(m - n, c - days), min(m, c)), or in [m - n, m) where every mention does. So two times make one interval, and
what an event sees is a running sum of interval edges. A thread, author or source counts once: all its intervals that end
later reach back over the end of this one, so this one adds what lies before the earliest of their starts. All running values are of
:mod:`.ranges`, in which neither a ticker nor a day is a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import scores as S
from ..sources.storage import written
from .ranges import running

DAY = 86_400_000_000
#: What is counted once, and the column that names it.
KINDS = {"threads": "thread_id", "authors": "author_hash", "sources": "source_name"}


def _counted(points: DataFrame, edges: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """The points with the sums of their key's edges up to them. edges: keys, at and the measures, one row for each key and at."""
    both = edges.withColumn("_e", F.lit(0)).unionByName(points.withColumn("_e", F.lit(1)), allowMissingColumns=True)
    return running(both, keys, ["at", "_e", "signal_id"], {c: ("sum", c) for c in measures}).filter("_e = 1").drop("_e")


def in_scope(points: DataFrame, runs: DataFrame, days: int) -> DataFrame:
    """Adds the number of measurement runs completed in (at, at + days], their summed coverage and the scope that follows."""
    done, sign = F.unix_micros("completed_at"), lambda s: F.lit(s).cast("long").alias("s")
    ends = F.array(F.struct((done - days * DAY).alias("at"), sign(1)), F.struct(done.alias("at"), sign(-1)))
    rows = runs.filter("completed_at is not null").select(F.explode(ends).alias("e"), F.coalesce("coverage_reliability", F.lit(0.0)).cast("decimal(18,9)").alias("c"))
    edges = rows.groupBy("e.at").agg(F.sum("e.s").alias("runs"), F.sum(F.col("e.s") * F.col("c")).cast("decimal(38,9)").alias("coverage"))
    found = _counted(points, edges, [], ["runs", "coverage"])
    return found.withColumn("scope", F.when(F.col("runs") > 0, "measurement").otherwise("corpus"))


def _intervals(mentions: DataFrame, runs: DataFrame, windows: tuple[int, ...], days: int) -> DataFrame:
    """For each mention and scope: z, where it ends to count, and a_n, from where on it counts in a window of n days, or null."""
    m, c = F.col("m"), F.col("c")
    rows = mentions.filter("created_time is not null").select("analysis_run_id", F.upper("ticker").alias("ticker"), F.unix_micros("created_time").alias("m"), *KINDS.values())
    done = runs.filter("completed_at is not null").select("analysis_run_id", F.unix_micros("completed_at").alias("c"))
    end = F.least(m, c)
    starts = {n: F.greatest(m - n * DAY, c - days * DAY) for n in windows}
    every = F.struct(F.lit("corpus").alias("scope"), m.alias("z"), *((m - n * DAY).alias(f"a_{n}") for n in windows))
    measured = F.struct(F.lit("measurement").alias("scope"), end.alias("z"), *(F.when(a < end, a).alias(f"a_{n}") for n, a in starts.items()))
    spans = F.array_compact(F.array(every, F.when(c.isNotNull() & (starts[max(windows)] < end), measured)))
    return rows.join(done, "analysis_run_id", "left").select("ticker", *KINDS.values(), F.explode(spans).alias("s")).select("ticker", *KINDS.values(), "s.*")


def _edges(rows: DataFrame, windows: tuple[int, ...], ends: dict[int, Column]) -> DataFrame:
    """scope, ticker, kind, n, at and +1 or -1 for both ends of each interval [a_n, end) that isn't empty."""
    edge = lambda at, n, s: F.struct(at.alias("at"), F.lit(n).alias("n"), F.lit(s).alias("s"))
    there = {n: F.col(f"a_{n}") < ends[n] for n in windows}
    both = F.array_compact(F.array(*(F.when(there[n], edge(at, n, s)) for n in windows for at, s in ((F.col(f"a_{n}"), 1), (ends[n], -1)))))
    return rows.select("scope", "ticker", "kind", F.explode(both).alias("e")).select("scope", "ticker", "kind", "e.*")


def attention(events: DataFrame, mentions: DataFrame, runs: DataFrame, windows: tuple[int, ...] = lex.ATTENTION_WINDOWS, days: int = 30) -> DataFrame:
    """What follows each event with a ticker and a time, for each window.

    mentions: analysis_run_id, ticker, created_time, thread_id, author_hash, source_name. runs: analysis_run_id, completed_at and
    coverage_reliability of canonical completed measurement runs. share_n is in percent with three digits, null where nothing was
    said at all. The reliability is that of the runs' mean coverage; without runs it is Medium where at any later time two
    sources and two threads mention the ticker, else Low.
    """
    points = events.filter("signal_time is not null and ticker <> ''").select("signal_id", F.upper("ticker").alias("ticker"), "signal_time", F.unix_micros("signal_time").alias("at"))
    runs = written(runs.select("analysis_run_id", "completed_at", "coverage_reliability"))
    points = in_scope(points, runs, days)
    rows = written(_intervals(mentions, runs, windows, days))
    a = [f"a_{n}" for n in windows]

    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in KINDS.items()))
    values = rows.select("scope", "ticker", "z", *a, F.explode(each).alias("v")).select("scope", "ticker", "z", *a, "v.*").filter("value is not null")
    one = ["scope", "ticker", "kind", "value"]
    values = values.groupBy(*one, "z").agg(*(F.min(c).alias(c) for c in a))
    first = running(values.withColumn("_1", F.lit(1)), one, [F.desc("z")], {f"_{c}": ("min", c) for c in a} | {"_later": ("sum", "_1")}, before=True)
    # as window 0, at any later time: a value counts up to its last mention, which no later one precedes here
    last = (F.col("_later") == 0) & (F.col("scope") == "corpus") & (F.col("kind") != "authors")
    first = first.withColumn("a_0", F.when(last, F.lit(-(1 << 63)).cast("long")))

    said = _edges(rows.withColumn("kind", F.lit("mentions")), windows, dict.fromkeys(windows, F.col("z")))
    edges = said.unionByName(_edges(first, (0, *windows), {0: F.col("z")} | {n: F.least("z", f"_a_{n}") for n in windows}))
    names = {f"{k}_{n}d": (k, n) for n in windows for k in ("mentions", *KINDS)} | {"threads_later": ("threads", 0), "sources_later": ("sources", 0)}
    of = lambda k, n: F.sum(F.when((F.col("kind") == k) & (F.col("n") == n), F.col("s")).otherwise(0))
    own = edges.groupBy("scope", "ticker", "at").agg(*(of(*x).alias(c) for c, x in names.items()))
    universe = said.groupBy("scope", "at").agg(*(of("mentions", n).alias(f"universe_{n}d") for n in windows))
    out = _counted(points, own, ["scope", "ticker"], list(names))
    out = _counted(out, universe, ["scope"], [f"universe_{n}d" for n in windows])

    share = {n: F.round(F.try_divide(F.col(f"mentions_{n}d") * 100, F.col(f"universe_{n}d")), 3) for n in windows}
    out = out.withColumns({f"share_{n}d": s for n, s in share.items()})
    spread = lambda n: S.attention_spread(*(F.col(f"{k}_{n}d") for k in ("mentions", *KINDS)), F.coalesce(f"share_{n}d", F.lit(0.0)))
    mean = F.when(F.col("runs") > 0, F.round(F.col("coverage").cast("double") / F.col("runs"), 9))
    heard = (F.col("sources_later") >= 2) & (F.col("threads_later") >= 2)
    label = F.when(mean.isNotNull(), S.reliability_name(mean)).when(heard, "Medium").otherwise("Low")
    out = out.withColumns({f"spread_{n}d": spread(n) for n in windows}).withColumn("attention_reliability", label)
    counts = [f"{k}_{n}d" for n in windows for k in ("mentions", *KINDS, "universe", "share", "spread")]
    return out.select("signal_id", "ticker", "signal_time", "scope", *counts, "attention_reliability")
