"""Corpus scope: dedupe across runs, canonical names, filters, threads, selections, comparisons, grids (DF6, TOP*, FLT*, AGG10-12, JN9, JN20)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import scores as S
from ..sources.storage import written
from .ranges import numbered


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in an order that should end in a unique column (SET6, TOP7)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def latest_mentions(mentions: DataFrame) -> DataFrame:
    """TOP7: of an item's mentions of a ticker over all runs, that of the newest run."""
    return first_by(mentions, ["item_id", "ticker"], F.desc("run_completed"), F.desc("created_time"), F.desc("confidence"), "analysis_run_id")


def with_usual_company(mentions: DataFrame) -> DataFrame:
    """AGG10: the ticker's most frequent known name, the smallest of equals. One narrow row per ticker and name is ordered."""
    named = mentions.groupBy("ticker", "company_name").agg(F.count(F.lit(1)).alias("n"))
    usual = named.groupBy("ticker").agg(F.min_by("company_name", F.struct((F.col("company_name") == "Unknown").alias("u"), (-F.col("n")).alias("n"), "company_name")).alias("usual"))
    return mentions.join(usual, "ticker", "left").withColumn("company_name", F.coalesce("usual", "company_name")).drop("usual")


def review_filter(
    df: DataFrame, preset: str = "balanced", tickers: Iterable[str] = (), sources: Iterable[str] = (), watchlist: Iterable[str] = ()
) -> DataFrame:
    """FLT2, FLT3: conjunction of a preset and optional memberships; an empty list filters nothing."""
    sentiments, confidence, depth, alpha, hype, switches = lex.REVIEW_PRESETS[preset]
    test = F.col("sentiment").isin(*sentiments) & (F.col("confidence") >= confidence) & (F.col("depth_score") >= depth)
    test = test & (F.col("alpha_signal_score") >= alpha) & (F.col("hype_score") <= hype)
    if "hide_hype" in switches:
        test = test & ~((F.col("hype_score") >= 7) | ((F.col("evidence_quality") == "low") & (F.col("claim_specificity_score") <= 3)))
    for switch, column in (("deeper", "needs_deeper_analysis"), ("low_signal", "low_mentions_high_signal"), ("new", "new_ticker_detected")):
        if switch in switches:
            test = test & F.col(column)
    for column, values in (("ticker", [*tickers]), ("source_name", [*sources]), ("ticker", [*watchlist])):
        if values:
            test = test & F.col(column).isin(*values)
    return df.filter(test)


def trailing_window(df: DataFrame, days: int, key: str = "ticker", ts: str = "created_time") -> DataFrame:
    """FLT4: rows within so many days of their key's latest. The latest are aggregated first, so no key is ordered."""
    latest = df.groupBy(key).agg(F.max(ts).alias("_latest"))
    return df.join(latest, key).filter(F.col(ts) >= F.col("_latest") - F.make_dt_interval(F.lit(days))).drop("_latest")


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """FLT9, FLT13: rows that contain the text in any of the columns, whatever the case."""
    return df.filter(F.lower(F.concat_ws(" ", *columns)).contains(text.lower().strip()))


def thread_summary(mentions: DataFrame) -> DataFrame:
    """AGG11, AGG27."""
    sentiments = mentions.groupBy("thread_id", "sentiment").agg(F.count(F.lit(1)).alias("n"))
    usual = sentiments.groupBy("thread_id").agg(F.min_by("sentiment", F.struct((-F.col("n")).alias("n"), "sentiment")).alias("usual_sentiment"))
    out = mentions.groupBy("thread_id").agg(
        F.count(F.lit(1)).alias("mentions"), F.countDistinct("author_hash").alias("unique_authors"), F.round(F.avg("alpha_signal_score"), 2).alias("average_alpha"),
        F.max("alpha_signal_score").alias("best_alpha"), F.max_by("item_id", F.struct("alpha_signal_score", "item_id")).alias("best_item"),
        F.array_join(F.array_sort(F.collect_set("ticker")), ", ").alias("tickers"),
    )
    return out.join(usual, "thread_id")


def representative(mentions: DataFrame, size: int = 10) -> DataFrame:
    """TOP5: per ticker four best, three newest, two bullish, two bearish, two hyped, then best again up to ``size``.

    Each quota is a first-n of its own, which Spark cuts before the shuffle: of a ticker no task meets more than n rows from each
    other task, however many it has. The few that are left are ranked once more. A ticker has an item once.
    """
    best, every = (F.desc("alpha_signal_score"), F.desc("confidence"), "item_id"), F.lit(True)
    quotas = [
        (every, best, 4), (every, (F.desc("created_time"), "item_id"), 3), (F.col("sentiment") == "bullish", best, 2), (F.col("sentiment") == "bearish", best, 2),
        (F.col("hype_score") >= 7, (F.desc("hype_score"), "item_id"), 2), (every, best, size),
    ]
    first, out = Window.partitionBy("ticker"), None
    for i, (test, order, n) in enumerate(quotas):
        rows = mentions.filter(test).withColumn("_n", F.row_number().over(first.orderBy(*order))).filter(F.col("_n") <= n)
        rows = rows.withColumn("_stage", F.lit(i * 10_000) + F.col("_n")).drop("_n")
        out = rows if out is None else out.unionByName(rows)
    once = first_by(out, ["ticker", "item_id"], "_stage")
    return once.withColumn("place", F.row_number().over(first.orderBy("_stage", "item_id")).cast("long")).filter(F.col("place") <= size).drop("_stage")


def spikes(buckets: DataFrame, mentions: DataFrame, top: int = 5) -> DataFrame:
    """TOP6: the weeks with most mentions, each with its strongest mention."""
    head = buckets.orderBy(F.desc("total_mentions"), "bucket_start", "ticker", "company_name").limit(top)
    driver = mentions.groupBy("ticker", "company_name", "time_bucket").agg(F.max_by("item_id", F.struct("alpha_signal_score", "item_id")).alias("driver_item"), F.max("alpha_signal_score").alias("driver_alpha"))
    # ``top`` rows: their side of the join is bounded by the parameter
    head = head.select("ticker", "company_name", F.col("bucket_start").alias("time_bucket"), "total_mentions")
    return driver.join(F.broadcast(head), ["ticker", "company_name", "time_bucket"])


def compare(now: DataFrame, before: DataFrame, metrics: list[str], key: str = "ticker") -> DataFrame:
    """JN9: full outer join of two summaries, nulls as zero, with deltas."""
    a = now.select(key, *(F.col(m).alias(f"{m}_now") for m in metrics))
    b = before.select(key, *(F.col(m).alias(f"{m}_before") for m in metrics))
    out = a.join(b, key, "full_outer")
    for m in metrics:
        x, y = (F.coalesce(F.col(f"{m}_{w}"), F.lit(0)) for w in ("now", "before"))
        out = out.withColumn(f"{m}_now", x).withColumn(f"{m}_before", y).withColumn(f"{m}_delta", F.col(f"{m}_now") - F.col(f"{m}_before"))
    return out


#: Times that stand in one row of a calendar.
CHUNK = 4096


def dense(buckets: DataFrame, keys: str, time: str, values: list[str]) -> DataFrame:
    """JN20: every key at every time, missing values as zero.

    The times (weeks, days), however many, form a calendar of numbered chunks; each key meets every chunk by its number.
    """
    numbered_ = numbered(buckets.select(time).distinct(), [], [time], "_n")
    chunks = written(numbered_.groupBy(F.floor((F.col("_n") - 1) / CHUNK).alias("_chunk")).agg(F.array_sort(F.collect_list(time)).alias("_times")))
    last = chunks.count() - 1
    each = buckets.select(keys).distinct().withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(last, 0)).cast("long"))))
    grid = each.join(chunks, "_chunk").select(keys, F.explode("_times").alias(time))
    return grid.join(buckets.groupBy(keys, time).agg(*(F.sum(v).alias(v) for v in values)), [keys, time], "left").fillna(0, values)


def dedupe_union(frames: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """SET1: UNION ALL, then the first of equal keys, earlier frames first."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("_frame", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return first_by(out, keys, "_frame", order).drop("_frame")


def wide(df: DataFrame, index: str, column: str, value: str, names: list[str], first: str | None = None) -> DataFrame:
    """SNK11, AGG23: by index and column the mean of a value, or the one of the row that is first by ``first``.

    ``names``: the columns' values, so that no extra job looks for them.
    """
    cell = F.min_by(value, first) if first else F.round(F.avg(value), 4)
    return df.groupBy(index).pivot(column, names).agg(cell)


def reset_corpus_scores(summary: DataFrame) -> DataFrame:
    """SC26: corpus scope has no trend, so acceleration doesn't count."""
    reduced = F.round(S.clamp(F.col("emerging_ticker_score") - F.col("acceleration_score") * 0.45), 2)
    return summary.withColumns({"emerging_ticker_score": reduced, "acceleration_score": F.lit(0.0), "trend_reliability": F.lit("Corpus evidence")})


def consensus(mentions: DataFrame) -> DataFrame:
    """DF5: the deterministic consensus per ticker, and the signature of the evidence that it rests on (ARR2).

    The signature follows from the number of mentions, the newest one and the sum of their rows' hashes, so it changes with any
    row, rows that repeat included, and not with their order. With a column ``claims`` also the first five bull and bear claims,
    each once.
    """
    row = F.sha1(F.concat_ws("|", F.col("item_id").cast("string"), "sentiment", F.col("alpha_signal_score").cast("string")))
    number = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    out = mentions.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("mentions"), F.count_if(F.col("sentiment") == "bullish").alias("bullish"), F.count_if(F.col("sentiment") == "bearish").alias("bearish"),
        F.avg("hype_score").alias("hype"), F.avg("evidence_quality_numeric").alias("evidence"), F.bool_or(F.col("classifier_mode") == "fallback").alias("any_fallback"), F.max("created_time").alias("newest"),
        F.sum(number).cast("string").alias("_sum"),
    )
    newest = F.coalesce(F.unix_micros("newest").cast("string"), F.lit(""))
    out = out.withColumn("signature", F.substring(F.sha1(F.concat_ws("|", "ticker", F.col("mentions").cast("string"), newest, "_sum")), 1, 20)).drop("_sum")
    bull, bear = F.col("bullish"), F.col("bearish")
    stance = F.when(bull + bear == 0, "neutral").when(bull > bear * 1.35, "bullish").when(bear > bull * 1.35, "bearish").otherwise("mixed")
    # The flags.
    flags = F.array_compact(
        F.array(F.when(F.col("mentions") < 3, "thin ticker evidence"), F.when(F.col("hype") >= 6, "elevated hype language"), F.when(F.col("any_fallback"), "some fallback-classified evidence"))
    )
    sure = F.when((F.col("mentions") >= 8) & (F.col("evidence") >= 5), "medium").otherwise("low")
    out = out.withColumns({"stance": stance, "confidence": sure, "flags": F.array_join(flags, ", ")})
    if "claims" not in mentions.columns:
        return out
    rows = mentions.filter(F.col("sentiment").isin("bullish", "bearish")).select("ticker", "sentiment", F.explode("claims").alias("claim")).distinct()
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("ticker", "sentiment").orderBy("claim"))).filter("_n <= 5")
    lists = first.groupBy("ticker").agg(*(F.array_sort(F.collect_list(F.when(F.col("sentiment") == s, F.col("claim")))).alias(f"{n}_case") for s, n in (("bullish", "bull"), ("bearish", "bear"))))
    return out.join(lists, "ticker", "left")


#: What a summary may be sorted by, first key and second key; the first is descending but for hype.
SORTS = {
    "Best emerging": ("emerging_ticker_score", "average_alpha_signal_score"), "Highest acceleration": ("acceleration_score", "emerging_ticker_score"),
    "Highest alpha": ("average_alpha_signal_score", "emerging_ticker_score"), "Lowest hype": ("average_hype_score", "average_alpha_signal_score"),
    "Most mentioned": ("total_mentions", "emerging_ticker_score"),
}


def top_summaries(summary: DataFrame, preset: str, n: int) -> DataFrame:
    """TOP1, TOP3, TOP14: the first ``n`` rows by a preset, in order, with their place."""
    first, second = SORTS[preset]
    order = [F.asc(first) if preset == "Lowest hype" else F.desc(first), F.desc(second), "ticker"]
    # n rows at most reach the window
    return summary.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def headline(summary: DataFrame) -> DataFrame:
    """TOP15: the ticker with the highest acceleration, or the best emerging one where none accelerates."""
    # The labels.
    pick = lambda a, b: F.max_by(F.struct("ticker", F.col(a).cast("double").alias("value")), F.struct(a, b, "ticker"))
    best = summary.agg(pick("acceleration_score", "emerging_ticker_score").alias("a"), pick("emerging_ticker_score", "average_alpha_signal_score").alias("e"))
    fast = F.col("a.value") > 0
    return best.select(F.when(fast, F.col("a.ticker")).otherwise(F.col("e.ticker")).alias("ticker"), F.when(fast, F.col("a.value")).otherwise(F.col("e.value")).alias("value"), F.when(fast, "Top acceleration").otherwise("Top signal").alias("label"))


def with_chips(summary: DataFrame, watchlist: Iterable[str] = ()) -> DataFrame:
    """SC25, FLT14: status labels of a ticker, and whether it is watched."""
    # The labels.
    chips = F.array_compact(
        F.array(
            F.nullif(F.coalesce("trend_reliability", F.lit("")), F.lit("")), F.when(F.col("low_mentions_high_signal"), "Low-hype lead"),
            F.when(F.col("new_ticker_detected"), "New ticker"), F.when(F.col("average_hype_score") >= 7, "High hype"),
        )
    )
    return summary.withColumns({"chips": F.array_join(chips, "|"), "watched": F.col("ticker").isin(*watchlist)})


def new_items(items: DataFrame, seen: DataFrame) -> DataFrame:
    """FLT10."""
    return items.join(seen.select("item_id"), "item_id", "left_anti")
