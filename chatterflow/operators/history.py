"""Runs, their history and the corpus over all of them (JN1-3, JN25, FLT1, FLT5-6, FLT12, FLT15, PRJ4, TOP13, JN6, DT7, AGG9, AGG12, AGG21, AGG26, WIN19-20, WIN22, DF6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from . import corpus, mentions as M


def run_time() -> Column:
    """DT7: when a run was completed, or else started; blanks count as missing."""
    first = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    return F.coalesce(first("completed_at"), first("started_at")).cast("timestamp")


def completed(runs: DataFrame, mode: str = "live", measured: bool = False) -> DataFrame:
    """FLT1, FLT12, FLT15: completed runs of a data mode; ``measured``: canonical measurement runs only."""
    out = runs.filter((F.col("status") == "completed") & (F.col("data_mode") == mode))
    return out.filter((F.lower("run_type") == "measurement") & F.coalesce("canonical_trend_run", F.lit(False))) if measured else out


def completed_mentions(mentions: DataFrame, runs: DataFrame, classifications: DataFrame, mode: str = "live") -> DataFrame:
    """JN1: mentions of known tickers in completed runs, with their run's columns and, if there is one, their classification.

    The last join is by the pair of keys, one row per pair on its right side, so a run that holds a third of all items is spread.
    """
    of_run = completed(runs, mode).select("analysis_run_id", F.col("started_at").alias("run_started_at"), F.col("completed_at").alias("run_completed_at"), "run_type", "canonical_trend_run")
    known = mentions.filter("ticker <> 'UNKNOWN'").join(of_run, "analysis_run_id")
    named = classifications.select("analysis_run_id", "item_id", *(c for c in ("classifier_mode", "model_name", "analyzed_at") if c in classifications.columns))
    return known.drop(*(c for c in named.columns[2:])).join(named, ["analysis_run_id", "item_id"], "left")


def historical_summaries(summaries: DataFrame, runs: DataFrame, mode: str = "live") -> DataFrame:
    """JN2, JN3: summaries of completed runs, with ``source_set``, the run's sources in order, to compare alike runs by."""
    of_run = completed(runs, mode).select("analysis_run_id", run_time().alias("run_time"), "run_type", "canonical_trend_run", F.array_sort("source_ids").alias("source_set"))
    return summaries.filter("ticker <> 'UNKNOWN'").join(of_run, "analysis_run_id")


def latest_points(history: DataFrame, metric: str, n: int = 12) -> DataFrame:
    """WIN19, WIN20: the last ``n`` runs of each ticker with the metric, and the run before each."""
    w = Window.partitionBy("ticker").orderBy("run_time", "analysis_run_id")
    rows = history.filter(F.col("run_time").isNotNull() & F.col(metric).isNotNull()).select("ticker", "analysis_run_id", "run_time", metric)
    rows = rows.withColumn("previous_run_id", F.lag("analysis_run_id").over(w))
    back = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("run_time"), F.desc("analysis_run_id"))).cast("long")
    return rows.withColumn("back", back).filter(F.col("back") <= n)


def deterministic_shift(history: DataFrame) -> DataFrame:
    """WIN22: how a ticker's last run differs from the one before, as a sentence."""
    w = Window.partitionBy("ticker").orderBy("run_time", "analysis_run_id")
    metrics = {"total_mentions": 0, "net_sentiment_score": 2, "average_hype_score": 1}
    back = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("run_time"), F.desc("analysis_run_id")))
    change = {c: F.coalesce(F.col(c), F.lit(0)).cast("double") - F.coalesce(F.lag(c).over(w), F.lit(0)) for c in metrics}
    rows = history.withColumns({f"d_{c}": x for c, x in change.items()} | {"_before": F.count(F.lit(1)).over(w), "_back": back}).filter("_back = 1")

    def signed(c: str, digits: int) -> Column:
        return F.concat(F.when(F.round(f"d_{c}", digits) > 0, "+").otherwise(""), F.format_string(f"%.{digits}f", F.round(f"d_{c}", digits) + F.lit(0.0)))

    # The sentences.
    alone = F.lit("Only one completed run contains this ticker, so there is no clean before/after yet.")
    moved = F.concat(
        F.lit("Latest run moved "), signed("total_mentions", 0), F.lit(" mentions, "), signed("net_sentiment_score", 2),
        F.lit(" net sentiment, and "), signed("average_hype_score", 1), F.lit(" hype versus the previous completed run."),
    )
    return rows.select("ticker", F.when(F.col("_before") < 2, alone).otherwise(moved).alias("shift"))


def source_activity(items: DataFrame, mentions: DataFrame) -> DataFrame:
    """AGG9: per run and source the analysed items, their mentions, and the newest item's time.

    Mentions are counted per item before they meet the items, so that no item is multiplied.
    """
    keys = ["analysis_run_id", "item_id"]
    per = mentions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    one = items.groupBy(*keys, "source_name").agg(F.max("created_time").alias("created_time"))
    return one.join(per, keys, "left").groupBy("analysis_run_id", "source_name").agg(
        F.count(F.lit(1)).alias("items_analyzed"), F.sum(F.coalesce("n", F.lit(0))).alias("ticker_mentions"), F.max("created_time").alias("newest_item_time")
    )


def explorer_stats(mentions: DataFrame) -> DataFrame:
    """AGG12: the measures that describe a ticker over all its mentions, and the run completed last."""
    mode = F.lower(F.coalesce("classifier_mode", F.lit("unknown")))
    return mentions.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("mentions"), F.countDistinct("item_id").alias("items"), F.countDistinct("author_hash").alias("authors"), F.countDistinct("thread_id").alias("threads"),
        F.countDistinct("source_name").alias("sources"), *(F.count_if(F.col("sentiment") == s).alias(f"{s}_mentions") for s in ("bullish", "bearish", "neutral")),
        F.round(F.avg("hype_score"), 2).alias("average_hype"), F.round(F.avg("evidence_quality_numeric"), 2).alias("average_evidence_quality"), F.round(F.avg("alpha_signal_score"), 2).alias("average_alpha"),
        F.count_if(mode == "fallback").alias("fallback_mentions"), F.count_if(mode == "ollama").alias("model_mentions"),
        F.min("created_time").alias("first_seen"), F.max("created_time").alias("last_seen"), F.max_by("analysis_run_id", F.struct("run_completed", "analysis_run_id")).alias("latest_run_id"),
    )


def bucket_sentiment(buckets: DataFrame, mentions: DataFrame) -> DataFrame:
    """AGG21, JN25: weekly buckets with the average sentiment of their ticker and week."""
    average = mentions.groupBy("ticker", F.col("time_bucket").alias("bucket_start")).agg(F.round(F.avg("sentiment_numeric"), 6).alias("net_sentiment_score"))
    return buckets.join(average, ["ticker", "bucket_start"], "left")


def ticker_claims(mentions: DataFrame, n: int = 8) -> DataFrame:
    """AGG26: the first claims to verify of each ticker in the alphabet. Distinct pairs come first, so repeats cost nothing."""
    claims = mentions.select("ticker", F.explode("claims").alias("claim")).filter(F.trim("claim") != "").distinct()
    return claims.withColumn("_n", F.row_number().over(Window.partitionBy("ticker").orderBy("claim"))).filter(F.col("_n") <= n).groupBy("ticker").agg(
        F.array_join(F.array_sort(F.collect_list("claim")), "|").alias("claims")
    )


def corpus_frames(mentions: DataFrame, runs: DataFrame, classifications: DataFrame) -> dict[str, DataFrame]:
    """DF6: the corpus over all completed runs: ``mentions``, ``summary``, ``buckets`` and ``run_summary``.

    Load, keep an item's mention of the newest run, name companies alike, summarise, reset what only a single run can tell, put
    the flags back on the mentions, and bucket.
    """
    raw = completed_mentions(mentions, runs, classifications)
    rows = raw.withColumn("run_completed", F.to_timestamp("run_completed_at")).withColumn("classifier_mode", F.coalesce("classifier_mode", F.lit("unknown")))
    rows = corpus.with_usual_company(corpus.latest_mentions(rows))
    rows = rows.withColumn("trust_status", S.trust(F.col("classifier_mode"), F.col("confidence"), F.col("evidence_quality"), F.col("hype_score")))
    summary = corpus.reset_corpus_scores(M.ticker_summary(rows)).withColumns({"coverage_adjusted_acceleration_score": F.lit(0.0), "coverage_reliability": F.lit(0.0)})
    flagged = M.with_flags(rows, summary)
    counts = rows.agg(
        F.countDistinct("item_id").alias("items_collected"), F.countDistinct("analysis_run_id").alias("runs_included"), F.count(F.lit(1)).alias("kept_rows"),
        F.min("created_date").alias("first_seen_date"), F.max("created_date").alias("most_recent_seen_date"),
    )
    return {"mentions": flagged, "summary": summary, "buckets": M.time_buckets(flagged), "run_summary": M.run_summary(flagged, summary), "counts": counts, "raw": raw}


#: Days that a label of a range stands for.
RANGES = {"Last 7 days": 7, "Last 30 days": 30, "Last 90 days": 90, "Last 6 months": 183, "Last 1 year": 365}


def date_bounds(rows: DataFrame, day: str, label: str, by: list[str]) -> DataFrame:
    """FLT5: first and last day of a labelled range, within the days that each key has."""
    out = rows.groupBy(*by).agg(F.min(day).alias("_first"), F.max(day).alias("_last"))
    start = F.col("_first") if label == "All available" else F.greatest(F.date_sub("_last", RANGES.get(label, 30)), F.col("_first"))
    return out.select(*by, start.alias("start_day"), F.col("_last").alias("end_day"))


def run_windows(runs: DataFrame, anchor: str = "started_at") -> DataFrame:
    """FLT6: the window since the run completed before over the same sources, or else the last seven days to the anchor's midnight."""
    w = Window.partitionBy(F.array_join(F.array_sort("source_ids"), ",")).orderBy("started_at", "analysis_run_id")
    before = F.last(F.when(F.col("status") == "completed", F.col("completed_at")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    at, second = F.date_trunc("second", anchor), F.make_dt_interval(secs=F.lit(1))
    rows = runs.withColumn("_b", before)
    since = F.when(F.col("_b") >= F.col(anchor), F.date_trunc("day", anchor)).otherwise(F.date_trunc("second", F.col("_b") + second))
    end = F.date_trunc("day", anchor) + F.make_dt_interval(F.lit(1)) - second
    week = F.date_trunc("day", end - F.make_dt_interval(F.lit(6)))
    return rows.select("analysis_run_id", F.coalesce(since, week).alias("window_start"), F.when(F.col("_b").isNull(), end).otherwise(at).alias("window_end"))


def run_labels(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """PRJ4: a run's source names, those unknown by number, and a short label. ``sources``: source_id, source_name."""
    ids = runs.select("analysis_run_id", F.posexplode_outer(F.array_sort("source_ids")).alias("_p", "source_id"))
    named = ids.join(sources, "source_id", "left").withColumn("name", F.coalesce("source_name", F.concat(F.lit("source:"), F.col("source_id").cast("string"))))
    lists = named.groupBy("analysis_run_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("source_id").isNotNull(), F.struct("_p", "name")))), lambda r: r["name"]).alias("names"))
    label = F.when(F.size("names") == 0, "No sources").when(F.size("names") == 1, F.col("names")[0]).otherwise(F.concat(F.col("names")[0], F.lit(" +"), (F.size("names") - 1).cast("string")))
    return lists.select("analysis_run_id", F.when(F.size("names") > 0, F.array_join("names", ", ")).otherwise("No sources").alias("source_names"), label.alias("source_label"))


def timeline(runs: DataFrame, n: int = 12) -> DataFrame:
    """TOP13: the newest completed runs with the length of their window."""
    seconds = F.greatest(F.unix_seconds("completed_at") - F.unix_seconds("started_at"), F.lit(0))
    days, hours = F.round(seconds / 86400).cast("long"), F.greatest(F.round(seconds / 3600), F.lit(1)).cast("long")
    period = F.when(seconds >= 86400, F.concat(days.cast("string"), F.lit("d"))).otherwise(F.concat(hours.cast("string"), F.lit("h")))
    return completed(runs).orderBy(F.desc("completed_at"), "analysis_run_id").limit(n).select("analysis_run_id", F.col("completed_at").cast("date").alias("day"), period.alias("period"))


def with_quality(mentions: DataFrame, quality: DataFrame) -> DataFrame:
    """JN6: mentions with the classifier's mode of their item, unknown where it has none, and what that makes them worth."""
    out = mentions.drop("classifier_mode").join(quality.select("item_id", "classifier_mode"), "item_id", "left").withColumn("classifier_mode", F.coalesce("classifier_mode", F.lit("unknown")))
    return out.withColumn("trust_status", S.trust(F.col("classifier_mode"), F.col("confidence"), F.col("evidence_quality"), F.col("hype_score")))
