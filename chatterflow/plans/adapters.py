"""The engine's model over the driver's tables: mentions, items, runs and bars from ``events`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prices as P


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a mention: two letters of its type and a part of its number name the ticker, the user is the author."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("ts", F.col("ts").cast("timestamp"))
    return e.selectExpr(
        "event_id AS item_id", "concat(upper(substr(event_type, 1, 2)), cast(k % 20 AS string)) AS ticker",
        "CASE WHEN event_id % 7 = 0 THEN 'Unknown' ELSE event_type END AS company_name", "cast(user_id AS string) AS author_hash", "cast(k AS string) AS thread_id",
        "concat('s', cast(user_id % 5 AS string)) AS source_name", "concat('r', cast(k % 3 AS string)) AS subreddit",
        "CASE WHEN event_id % 3 = 0 THEN 'post' ELSE 'comment' END AS item_type",
        "CASE WHEN value < 15 THEN 'bearish' WHEN value < 35 THEN 'neutral' WHEN value < 120 THEN 'bullish' ELSE 'irrelevant' END AS sentiment",
        "CASE WHEN value < 15 THEN -1.0D WHEN value < 35 THEN 0.0D WHEN value < 120 THEN 1.0D END AS sentiment_numeric",
        "(event_id % 128) / 128D AS confidence", "((event_id * 37) % 400) / 4D AS alpha_signal_score",
        "greatest(((event_id * 37) % 400) / 4D - (event_id % 11) * 4.5D, 0D) AS hype_adjusted_signal_score",
        "cast(event_id % 11 AS int) AS hype_score", "cast((event_id * 3) % 11 AS int) AS depth_score", "cast((event_id * 5) % 11 AS int) AS claim_specificity_score",
        "CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS evidence_quality", "cast(event_id % 3 + 1 AS int) AS evidence_quality_numeric",
        "cast(event_id % 4 AS int) AS repetition_score", "CASE WHEN event_id % 2 = 0 THEN 'fallback' ELSE 'model' END AS classifier_mode",
        "event_id % 13 = 0 AS needs_deeper_analysis", "event_id % 17 = 0 AS low_mentions_high_signal", "event_id % 19 = 0 AS new_ticker_detected",
        "ts AS created_time", "cast(ts AS date) AS created_date", "cast(date_trunc('week', ts) AS date) AS time_bucket",
        "concat('run_', cast(cast(date_trunc('week', ts) AS date) AS string)) AS analysis_run_id", "cast(date_trunc('week', ts) AS date) AS run_completed",
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each event type."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return P.daily_bars(e, F.upper("event_type"), F.col("ts"), F.col("value"), F.col("event_id"))


def adjusted_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars, of which two in three have an adjusted close."""
    adjusted = F.when(F.col("volume") % 3 != 0, F.round(F.col("close") * 0.97, 4))
    return bars(spark, sf_dir).withColumn("adjusted_close", adjusted)


def long_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars over years, with gaps: brands by ship date."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_brand").alias("ticker"), F.col("l_shipdate").cast("date").alias("date")).agg(
        F.round(F.max("l_extendedprice"), 2).alias("high"), F.round(F.min("l_extendedprice"), 2).alias("low"), F.min_by("l_extendedprice", F.struct("l_orderkey", "l_linenumber")).alias("open"),
        F.max_by("l_extendedprice", F.struct("l_orderkey", "l_linenumber")).alias("close"), F.sum("l_quantity").alias("volume"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is an item of its source."""
    d = table(spark, sf_dir, "documents")
    return d.selectExpr(
        "doc_id AS item_id", "text AS body_text", "'' AS thread_title", "source AS source_name", "lang AS subreddit", "cast(doc_id % 50 AS string) AS thread_id",
        "cast(doc_id % 97 AS string) AS author", "doc_id % 300 AS score",
    )


def signal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frozen signal for every event, of its type's ticker."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.selectExpr(
        "concat('signal_', cast(event_id AS string)) AS signal_id", "upper(event_type) AS ticker", "ts AS signal_time", "cast(ts AS date) AS signal_day", "((event_id * 37) % 1000) / 10D AS strength"
    )


def entity_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog line for every document: its first word is the symbol, the next ones are the name and two aliases."""
    # only the seven words that are used are cut out
    words = F.regexp_extract_all(F.regexp_extract("text", r"(?U)^(?:\W*+\w++){1,7}", 0), F.lit(r"(?U)\w+"), F.lit(0))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), words.alias("w")).filter("size(w) > 0")
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    return d.select("line", part(1, 1).alias("ticker"), part(2, 2).alias("company_name"), F.concat_ws("|", part(4, 1), part(5, 3)).alias("aliases"))


def _week() -> str:
    return "datediff(time_bucket, DATE'2024-01-01') div 7"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for every week: every fifth failed, every fourth is a discovery, every seventh isn't canonical."""
    weeks = mentions(spark, sf_dir).groupBy("analysis_run_id", "time_bucket").agg(F.collect_set(F.substring("source_name", 2, 9).cast("int")).alias("source_ids"))
    return weeks.selectExpr(
        "analysis_run_id", "source_ids", "cast(time_bucket AS timestamp) AS started_at", "cast(time_bucket AS timestamp) + INTERVAL 6 DAYS AS completed_at", "'live' AS data_mode",
        f"CASE WHEN {_week()} % 5 = 4 THEN 'failed' ELSE 'completed' END AS status", f"CASE WHEN {_week()} % 4 = 2 THEN 'discovery' ELSE 'measurement' END AS run_type",
        f"{_week()} % 7 <> 6 AS canonical_trend_run",
    )


def source_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a collector would note of each run and source."""
    keys = mentions(spark, sf_dir).select("analysis_run_id", "source_name", "time_bucket").distinct()
    return keys.selectExpr(
        "analysis_run_id", "source_name", "CASE WHEN source_name = 's4' THEN 'thread_url' ELSE 'subreddit' END AS source_kind", "source_name <> 's3' AS canonical",
        f"source_name = 's2' AND {_week()} % 2 = 1 AS rate_limited", f"source_name = 's1' AND {_week()} % 2 = 1 AS feed_capped",
    )


def classifications(spark: SparkSession, sf_dir: str, item: str = "item_id") -> DataFrame:
    """A classification for every run and item with a mention of some depth."""
    mode = F.when(F.col("classifier_mode") == "model", "ollama").otherwise("fallback")
    m = mentions(spark, sf_dir).filter("depth_score >= 2").select("analysis_run_id", F.col(item).alias("item_id"), mode.alias("mode"))
    return m.groupBy("analysis_run_id", "item_id").agg(F.min("mode").alias("classifier_mode"))


def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every run and ticker."""
    return mentions(spark, sf_dir).groupBy("analysis_run_id", "ticker").agg(
        F.count(F.lit(1)).alias("total_mentions"), F.countDistinct("thread_id").alias("unique_threads"), F.countDistinct("author_hash").alias("unique_authors"),
        F.round(F.avg("hype_score"), 2).alias("average_hype_score"), F.round(F.avg("repetition_score"), 2).alias("repetition_score"), F.round(F.avg("sentiment_numeric"), 4).alias("net_sentiment_score"),
        F.round(F.avg("depth_score") * 5, 2).alias("acceleration_score"), F.round(F.avg("alpha_signal_score"), 2).alias("emerging_ticker_score"),
    )
