"""Signal buckets per ticker and period, and their price outcomes (AGG5, AGG6, DT3, WIN4-7, ST11, ST13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from . import prices as P

PERIODS = {"Daily": "day", "Weekly": "week", "Monthly": "month"}


def bucket_start(ts: Column, period: str, run_completed: Column | None = None) -> Column:
    if period in PERIODS:
        return F.date_trunc(PERIODS[period], ts).cast("date")
    return F.coalesce(run_completed, ts).cast("date")


def mean(name: str) -> Column:
    return F.coalesce(F.round(F.avg(name), 4), F.lit(0.0))


def distinct(name: str) -> Column:
    """Empty strings don't count."""
    return F.countDistinct(F.nullif(F.col(name), F.lit("")))


def signal_buckets(mentions: DataFrame, period: str = "Weekly", min_mentions: int = 1) -> DataFrame:
    keys = ["ticker", "bucket_start"] + ([] if period in PERIODS else ["analysis_run_id"])
    run = F.col("run_completed") if period not in PERIODS else None
    rows = mentions.filter(~F.col("ticker").isin("", "UNKNOWN")).withColumn("bucket_start", bucket_start(F.col("created_time"), period, run)).filter("bucket_start is not null")
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("mentions"), F.count_if(F.col("item_type") == "post").alias("post_count"), F.count_if(F.col("item_type") == "comment").alias("comment_count"),
        distinct("subreddit").alias("unique_subreddit_count"), distinct("author_hash").alias("unique_author_count"), distinct("thread_id").alias("unique_thread_count"),
        mean("hype_score").alias("average_hype_score"), mean("evidence_quality_numeric").alias("average_evidence_score"), mean("claim_specificity_score").alias("average_specificity_score"),
        mean("sentiment_numeric").alias("average_sentiment_score"), mean("alpha_signal_score").alias("average_alpha_signal_score"),
        F.count_if(F.col("sentiment") == "bullish").alias("bullish_mention_count"), F.count_if(F.col("sentiment") == "bearish").alias("bearish_mention_count"),
        F.max(F.coalesce(F.col("low_mentions_high_signal"), F.lit(False)).cast("int")).alias("low_mentions_high_signal_flag"),
    )
    # bucket totals are aggregated apart and joined: a window over a bucket would gather all its tickers
    total = out.groupBy("bucket_start").agg(F.sum("mentions").alias("_total"))
    out = out.join(total, "bucket_start").withColumn("mention_share_of_voice", F.round(F.col("mentions") / F.col("_total") * 100, 4)).drop("_total")
    out = out.withColumn("bull_bear_ratio", S.bull_bear(F.col("bullish_mention_count"), F.col("bearish_mention_count")))
    w = Window.partitionBy("ticker").orderBy(*[k for k in keys if k != "ticker"])
    before, shift = F.lag("mentions").over(w), F.abs(F.col("average_sentiment_score") - F.lag("average_sentiment_score").over(w))
    out = out.withColumns(
        {
            "mention_acceleration": F.coalesce(F.col("mentions") - before, F.lit(0)), "percentage_mention_acceleration": F.when(before > 0, F.round((F.col("mentions") - before) / before * 100, 6)),
            "narrative_shift_score": F.coalesce(F.round(shift, 6), F.lit(0.0)),
        }
    )
    return out.filter(F.col("mentions") >= max(min_mentions, 1))


def with_price_outcomes(buckets: DataFrame, prices: DataFrame, benchmark: str | None = None) -> DataFrame:
    """ST11: horizons are computed on the bars first, so the as-of join carries ready outcomes."""
    enriched = P.with_outcomes(prices)
    outcomes = [c for c in enriched.columns if c.rpartition("_")[0].startswith(("raw_return", "absolute_return", "price_direction", "volume_change", "volatility", "drawdown", "prior", "gap"))]
    out = P.asof_forward(buckets, enriched, "bucket_start", ["reference_close", *outcomes])
    out = out.withColumn("price_available", F.col("reference_close").isNotNull() & (F.col("reference_close") != 0))
    if benchmark is None:
        return out
    returns = [c for c in outcomes if c.startswith("raw_return")]
    market = enriched.filter(F.col("ticker") == benchmark).select(F.lit(1).alias("_one"), "date", *returns).withColumn("ticker", F.lit("_")).drop("_one")
    days = buckets.select("bucket_start").distinct().withColumn("ticker", F.lit("_"))
    at = P.asof_forward(days, market, "bucket_start", returns).select("bucket_start", *(F.col(c).alias(c.replace("raw", "market")) for c in returns))
    out = out.join(at, "bucket_start", "left")
    return out.withColumns({c.replace("raw", "abnormal"): F.round(F.col(c) - F.col(c.replace("raw", "market")), 6) for c in returns})


def diagnostics(dataset: DataFrame) -> DataFrame:
    """AGG14."""
    return dataset.agg(
        F.count(F.lit(1)).alias("bucket_rows"), F.countDistinct("ticker").alias("ticker_count"), F.count_if("price_available").alias("price_available_rows"),
        F.count_if(~F.col("price_available")).alias("missing_price_rows"), F.round(F.count_if("price_available") / F.count(F.lit(1)), 4).alias("completeness"),
        F.min("bucket_start").alias("date_start"), F.max("bucket_start").alias("date_end"),
    )
