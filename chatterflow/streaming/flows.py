"""Structured Streaming forms (§2.13): first-wins dedupe, week buckets, sessions, cooldown state, outcomes that are filled later.

Polls and their upsert sink are in :mod:`.polls`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import lexicons as lex


def deduped(items: DataFrame, late: str = "7 days") -> DataFrame:
    """Items seen in an earlier poll are dropped; state is kept as long as the watermark asks."""
    return items.withWatermark("created_time", late).dropDuplicatesWithinWatermark(["item_id"])


def weekly(mentions: DataFrame, late: str | None = "7 days") -> DataFrame:
    """Mentions per ticker and Monday week. The windows of seven days are shifted by four, for the epoch was a Thursday.

    ``late``: None where the stream has a watermark already.
    """
    weeks = F.window("created_time", "7 days", "7 days", "4 days")
    marked = mentions.withWatermark("created_time", late) if late else mentions
    return (
        marked.groupBy(weeks, "ticker")
        .agg(F.count(F.lit(1)).alias("total_mentions"), F.count_if(F.col("sentiment") == "bullish").alias("bullish_mentions"))
        .select("ticker", F.col("window.start").cast("date").alias("bucket_start"), "total_mentions", "bullish_mentions")
    )


def sessions(mentions: DataFrame, gap: str = "6 hours", late: str = "7 days") -> DataFrame:
    """Bursts of mentions of a ticker without a pause longer than ``gap``."""
    s = F.session_window("created_time", gap)
    return mentions.withWatermark("created_time", late).groupBy(s, "ticker").agg(F.count(F.lit(1)).alias("total_mentions")).select("ticker", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "total_mentions")


def cooldown(events: DataFrame, hours: int = lex.GATES["cooldown_hours"], delta: float = lex.GATES["cooldown_delta"], late: str | None = "1 hour") -> DataFrame:
    """DF8 on a stream: a ticker's last accepted event and those that wait are the state. events: ticker, signal_id, signal_time, strength.

    An event waits until the watermark, ``late`` behind the newest event, has passed it, so events are decided in order of
    time and id whatever the order they come in, as on a table. ``late``: None decides each micro-batch by itself.
    """

    def accept(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, last, *waiting = state.get if state.exists else (None, None, [], [], [])
        rows = [*zip(*waiting, strict=True)]
        for b in batches:
            rows += zip((b["signal_time"].astype("int64") // 1000 if b["signal_time"].dtype == "datetime64[ns]" else b["signal_time"].astype("datetime64[us]").astype("int64")).tolist(), b["signal_id"], b["strength"].astype(float), strict=True)
        passed = state.getCurrentWatermarkMs() * 1000 if late else None
        rest, out = [], []
        for t, name, strength in sorted(rows):
            if late and t >= passed:
                rest.append((t, name, strength))
            elif at is None or t - at > hours * 3_600_000_000 or strength >= last + delta:
                at, last = t, strength
                out.append((*key, name, pd.Timestamp(t, unit="us"), strength))
        if at is not None or rest:
            state.update((at, last, *([list(x) for x in zip(*rest, strict=True)] or ([], [], []))))
        if rest:
            state.setTimeoutTimestamp(max(rest[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["ticker", "signal_id", "signal_time", "strength"])

    kept = "at long, strength double, times array<long>, ids array<string>, strengths array<double>"
    marked = events.withWatermark("signal_time", late) if late else events
    return marked.groupBy("ticker").applyInPandasWithState(
        accept, "ticker string, signal_id string, signal_time timestamp, strength double", kept, "append", GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    )


def bars_ahead(events: DataFrame, bars: DataFrame, days: int = 30, slack: int = 7, late: str = "2 days") -> DataFrame:
    """Each event with the bars of its ticker from its day to ``days`` + ``slack`` days later, as both come in (WIN8-13, DF9).

    events: signal_id, ticker, signal_time; bars: ticker, bar_time (the start of its day), close. An outer join of two streams:
    an event waits until the watermark of the bars has passed its last day, and then comes once without a bar if there was
    none; a bar waits as long as events may still need it. State is what lies in between. ``late``: how late either may come.
    """
    e = events.withWatermark("signal_time", late).select("signal_id", F.col("ticker").alias("_ticker"), "signal_time")
    b = bars.withWatermark("bar_time", late).select("ticker", "bar_time", "close")
    inside = F.expr(f"bar_time > signal_time - INTERVAL 1 DAY AND bar_time <= signal_time + INTERVAL {days + slack} DAYS")
    met = e.join(b, (F.col("_ticker") == F.col("ticker")) & inside, "left_outer")
    return met.select("signal_id", F.col("_ticker").alias("ticker"), "signal_time", "bar_time", "close")


def returns_so_far(rows: DataFrame, horizons: tuple[int, ...] = lex.DAY_HORIZONS, slack: int = 7) -> DataFrame:
    """From the rows of :func:`bars_ahead` that have come: the return of each horizon, null as long as its bar isn't there.

    The bar of a horizon is the first one on or up to ``slack`` days after its day.
    """
    ahead = F.datediff("bar_time", F.col("signal_time").cast("date"))
    first = lambda h: F.min_by("close", F.when(ahead.between(h, h + slack), F.col("bar_time")))
    found = rows.groupBy("signal_id", "ticker", "signal_time").agg(*(first(h).alias(f"c{h}") for h in (0, *horizons)))
    return found.select("signal_id", "ticker", "signal_time", *(F.round(F.try_divide(F.col(f"c{h}"), F.col("c0")) - 1, 6).alias(f"return_{h}d") for h in horizons))
