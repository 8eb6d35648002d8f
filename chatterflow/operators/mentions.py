"""The mention fact table and its aggregates: explode, dedupe, ticker summary, week buckets, run summary (ARR8, SNK3, AGG1-4, JN5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import scores as S
from ..functions import text as T


def week(ts: Column) -> Column:
    """Monday of the week, UTC (DT2)."""
    return F.date_trunc("week", ts).cast("date")


def pairs(tickers: Column, companies: Column) -> Column:
    """Distinct (ticker, company) structs, first seen first; a known company replaces Unknown (SET8)."""
    rows = F.transform(
        F.coalesce(tickers, F.array().cast("array<string>")),
        lambda t, i: F.struct(
            F.upper(F.trim(t)).alias("ticker"),
            F.coalesce(F.nullif(F.trim(F.get(companies, i)), F.lit("")), F.lit("Unknown")).alias("company_name"),
        ),
    )
    named = F.filter(rows, lambda r: r["ticker"] != "")
    known = lambda t: F.filter(named, lambda r: (r["ticker"] == t) & (r["company_name"] != "Unknown"))
    return F.transform(
        F.array_distinct(F.transform(named, lambda r: r["ticker"])),
        lambda t: F.struct(t.alias("ticker"), F.coalesce(F.get(known(t), F.lit(0))["company_name"], F.lit("Unknown")).alias("company_name")),
    )


def explode(classified: DataFrame) -> DataFrame:
    """One row per item and ticker; items without one give none (ARR8)."""
    body = T.empty_if_null(F.col("body_text"))
    wide = classified.withColumn("_pair", F.explode(pairs(F.col("tickers"), F.col("company_names")))).drop("tickers", "company_names")
    return wide.withColumns(
        {
            "ticker": F.col("_pair.ticker"), "company_name": F.col("_pair.company_name"),
            "author_hash": F.coalesce("author_hash", T.author_hash(F.col("author"))),
            "created_date": F.col("created_time").cast("date"), "time_bucket": week(F.col("created_time")),
            "sentiment_numeric": S.sentiment_number(F.col("sentiment")), "evidence_quality_numeric": S.quality_number(F.col("evidence_quality")),
            "text_length": F.length(body).cast("long"), "word_count": T.word_count(body), "contains_link": T.has_link(body), "contains_numbers": T.has_digit(body),
            "contains_financial_terms": T.any_of(F.lower(body), lex.FINANCE_TERMS), "red_flag_count": F.size("red_flags"),
        }
    ).drop("_pair")


def dedupe(mentions: DataFrame, order: str) -> DataFrame:
    """One row per item and upper-cased ticker: the first by ``order``, one with a known company before others (SNK3)."""
    first = Window.partitionBy("item_id", "ticker").orderBy((F.col("company_name") == "Unknown").cast("int"), order)
    return mentions.withColumn("ticker", F.upper("ticker")).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("total_mentions"), *(F.count_if(F.col("sentiment") == s).alias(f"{s}_mentions") for s in lex.DECIDED)]


def _means() -> list[Column]:
    return [
        F.round(F.avg("alpha_signal_score"), 2).alias("average_alpha_signal_score"),
        F.round(F.avg("hype_adjusted_signal_score"), 2).alias("average_hype_adjusted_signal_score"),
        F.round(F.avg("depth_score"), 2).alias("average_depth_score"),
        F.round(F.avg("hype_score"), 2).alias("average_hype_score"),
        F.round(F.avg("claim_specificity_score"), 2).alias("average_claim_specificity_score"),
        F.round(F.avg("evidence_quality_numeric"), 2).alias("average_evidence_quality_numeric"),
        F.round(F.avg("repetition_score"), 2).alias("repetition_score"),
    ]


def _distinct(*names: str) -> list[Column]:
    return [F.countDistinct(n).alias(f"n_{n}") for n in names]


_SCORE_INPUTS = ("average_alpha_signal_score", "average_evidence_quality_numeric", "average_claim_specificity_score", "average_hype_score", "repetition_score")


def _emerging() -> Column:
    alpha, evidence, claim, hype, rep = (F.col(c) for c in _SCORE_INPUTS)
    return S.emerging(
        F.col("acceleration_score"), F.col("source_diversity_score"), alpha, evidence, claim, hype, rep, F.col("mega_popularity_penalty"),
        F.col("low_mentions_high_signal"), F.col("new_ticker_detected"), F.col("mention_change"), F.col("total_mentions"), F.col("n_source_name"),
    )


def bucket_stats(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """AGG3: per key and week."""
    return mentions.groupBy(*keys, "time_bucket").agg(
        F.count(F.lit(1)).alias("total_mentions"), F.count_if(F.col("sentiment") == "bullish").alias("bullish_mentions"),
        F.countDistinct("author_hash").alias("unique_authors"), F.countDistinct("thread_id").alias("unique_threads"),
    )


def ticker_summary(mentions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """AGG1, in the order of its keys' scores: counts, ratios, means, the last observed week against the one before, and scores."""
    keys = keys or ["ticker", "company_name"]
    weeks = Window.partitionBy(*keys).orderBy("time_bucket")
    last = Window.partitionBy(*keys).orderBy(F.desc("time_bucket"))
    moving = bucket_stats(mentions, keys)
    for name in ("total_mentions", "bullish_mentions", "unique_authors", "unique_threads"):
        moving = moving.withColumn(f"prev_{name}", F.coalesce(F.lag(name).over(weeks), F.lit(0)))
    moving = (
        moving.withColumn("rolling_mention_average", F.round(F.avg("total_mentions").over(weeks.rowsBetween(-2, 0)), 2))
        .withColumn("_n", F.row_number().over(last)).filter("_n = 1")
        .select(
            *(F.col(k).alias(f"_{k}") for k in keys), F.col("total_mentions").alias("mentions_this_period"), F.col("prev_total_mentions").alias("mentions_previous_period"),
            (F.col("total_mentions") - F.col("prev_total_mentions")).alias("mention_change"),
            S.growth(F.col("total_mentions"), F.col("prev_total_mentions")).alias("mention_growth_rate"),
            (F.col("bullish_mentions") - F.col("prev_bullish_mentions")).alias("bullish_change"),
            S.growth(F.col("bullish_mentions"), F.col("prev_bullish_mentions")).alias("bullish_growth_rate"),
            (F.col("unique_authors") - F.col("prev_unique_authors")).alias("unique_author_growth"),
            (F.col("unique_threads") - F.col("prev_unique_threads")).alias("unique_thread_growth"), "rolling_mention_average",
        )
    )
    total = mentions.groupBy(*keys).agg(
        *_counts(), F.round(F.avg("sentiment_numeric"), 4).alias("net_sentiment_score"), F.round(F.avg("confidence"), 4).alias("average_confidence"), *_means(),
        *_distinct("source_name", "subreddit"), F.countDistinct("author_hash").alias("unique_authors"), F.countDistinct("thread_id").alias("unique_threads"),
        F.min("created_date").alias("first_seen_date"), F.max("created_date").alias("most_recent_seen_date"),
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = total.join(moving, same).drop(*(f"_{k}" for k in keys))
    out = out.withColumns(
        {
            "bullish_ratio": F.round(F.col("bullish_mentions") / F.col("total_mentions"), 4), "bearish_ratio": F.round(F.col("bearish_mentions") / F.col("total_mentions"), 4),
            "source_diversity_score": S.diversity(F.col("n_source_name"), F.col("n_subreddit")),
            "controversy_score": S.controversy(F.col("bullish_mentions"), F.col("bearish_mentions")),
            "mega_popularity_penalty": S.popularity_penalty(F.col("ticker"), F.col("total_mentions")),
            "new_ticker_detected": (F.col("mentions_this_period") > 0) & (F.col("mentions_previous_period") == 0),
            "low_mentions_high_signal": (F.col("total_mentions") < 10) & (F.col("average_alpha_signal_score") >= 75) & (F.col("average_hype_score") < 4),
        }
    )
    out = out.withColumn(
        "acceleration_score",
        S.acceleration(
            F.col("mentions_this_period"), F.col("mentions_previous_period"), F.col("mention_growth_rate"), F.col("unique_author_growth"), F.col("unique_thread_growth"),
            F.col("average_hype_score"), F.col("repetition_score"), F.col("new_ticker_detected"),
        ),
    )
    return out.withColumn("emerging_ticker_score", _emerging()).withColumnRenamed("n_source_name", "unique_sources").drop("n_subreddit")


def time_buckets(mentions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """AGG2: per key and week, with the previous observed week. Distinct counts stand in for growth here, as specified."""
    keys = keys or ["ticker", "company_name"]
    weeks = Window.partitionBy(*keys).orderBy("time_bucket")
    out = mentions.groupBy(*keys, "time_bucket").agg(
        *_counts(), *_means(), *_distinct("source_name", "subreddit"), F.countDistinct("author_hash").alias("unique_authors"), F.countDistinct("thread_id").alias("unique_threads")
    )
    out = out.withColumn("previous_mentions", F.coalesce(F.lag("total_mentions").over(weeks), F.lit(0)))
    out = out.withColumns(
        {
            "bucket_start": F.col("time_bucket"), "bucket_end": F.date_add("time_bucket", 6),
            "mention_change": F.col("total_mentions") - F.col("previous_mentions"), "mention_growth_rate": S.growth(F.col("total_mentions"), F.col("previous_mentions")),
            "source_diversity_score": S.diversity(F.col("n_source_name"), F.col("n_subreddit")),
            "mega_popularity_penalty": S.popularity_penalty(F.col("ticker"), F.col("total_mentions")),
            "new_ticker_detected": F.col("previous_mentions") == 0,
            "low_mentions_high_signal": (F.col("total_mentions") < 10) & (F.col("average_alpha_signal_score") >= 75) & (F.col("average_hype_score") < 4),
        }
    )
    out = out.withColumn(
        "acceleration_score",
        S.acceleration(
            F.col("total_mentions"), F.col("previous_mentions"), F.col("mention_growth_rate"), F.col("unique_authors"), F.col("unique_threads"),
            F.col("average_hype_score"), F.col("repetition_score"), F.col("new_ticker_detected"),
        ),
    )
    out = out.withColumn("emerging_ticker_score", _emerging())
    return out.drop("n_source_name", "n_subreddit", "time_bucket", "mega_popularity_penalty", "mention_change", "repetition_score", "previous_mentions")


def with_flags(mentions: DataFrame, summary: DataFrame) -> DataFrame:
    """JN5: the tickers' scores and flags on their mentions, from one row per ticker."""
    per = summary.groupBy("ticker").agg(
        F.max("source_diversity_score").alias("source_diversity_score"), F.max("controversy_score").alias("controversy_score"),
        F.bool_or("low_mentions_high_signal").alias("low_mentions_high_signal"), F.bool_or("new_ticker_detected").alias("new_ticker_detected"),
    )
    names = [c for c in per.columns if c != "ticker"]
    return mentions.drop(*names).join(per, "ticker", "left")


def run_summary(mentions: DataFrame, summary: DataFrame, top: int = 5) -> DataFrame:
    """AGG4 in one row. An item counts by its most confident mention."""
    item = mentions.groupBy("item_id").agg(F.max_by(F.struct("sentiment", "depth_score"), F.struct("confidence", "ticker")).alias("m"))
    items = item.agg(
        F.count(F.lit(1)).alias("items_analyzed"), *(F.count_if(F.col("m.sentiment") == s).alias(f"{s}_items") for s in lex.ALL_SENTIMENTS),
        F.count_if(F.col("m.depth_score") >= 7).alias("high_depth_posts_found"),
    )
    rows = mentions.agg(F.count(F.lit(1)).alias("ticker_mentions"), F.countDistinct("ticker").alias("tickers_found"))
    flags = summary.agg(F.count_if("low_mentions_high_signal").alias("low_mentions_high_signal_count"), F.count_if("new_ticker_detected").alias("newly_detected_tickers_count"))

    def best(order: str, value: str, name: str) -> DataFrame:
        head = summary.orderBy(F.desc(order), "ticker").limit(top).select("ticker", F.col(order).alias("_o"), F.col(value).alias("_v"))
        listed = F.array_sort(F.collect_list(F.struct((-F.col("_o")).alias("o"), "ticker", F.col("_v").alias("v"))))
        return head.agg(F.array_join(F.transform(listed, lambda r: F.concat_ws(":", r["ticker"], r["v"].cast("string"))), ",").alias(name))

    out = items
    # one row each: these joins put single rows side by side
    for part in (rows, flags, best("emerging_ticker_score", "total_mentions", "top_mentioned_tickers"), best("acceleration_score", "mentions_this_period", "top_accelerating_tickers")):
        out = out.join(F.broadcast(part))
    return out
