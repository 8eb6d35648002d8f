"""Source coverage and coverage-adjusted trends (AGG7, AGG22, SC14-16, JN8, JN10-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S


def source_coverage(items: DataFrame, keys: list[str], window_days: float, post_cap: int = 100, facts: DataFrame | None = None) -> DataFrame:
    """AGG22 with SC16: one row per run and source. ``items``: keys, item_type, thread_id, author_hash, created_time, window_start.

    ``facts``: by key source_kind, canonical, rate_limited, feed_capped and, where it failed, collection_error, as the collector
    noted them; where there are none, the source is a canonical subreddit without limits.
    """
    out = items.groupBy(*keys).agg(
        F.count_if(F.col("item_type") == "post").alias("posts_returned"), F.count_if(F.col("item_type") == "comment").alias("comments_returned"),
        F.countDistinct("thread_id").alias("unique_threads"), F.countDistinct("author_hash").alias("unique_authors"),
        F.min("created_time").alias("oldest_seen"), F.max("created_time").alias("newest_seen"), F.min("window_start").alias("window_start"),
    )
    seconds = F.unix_micros("oldest_seen") - F.unix_micros("window_start")
    missed = F.greatest(seconds / 1e6, F.lit(0.0)) / (window_days * 86400)
    capped = F.col("posts_returned") >= post_cap
    known = {"source_kind": F.lit("subreddit"), "canonical": F.lit(True), "rate_limited": F.lit(False), "feed_capped": F.lit(False)}
    error = F.nullif(F.col("collection_error"), F.lit("")) if facts is not None and "collection_error" in facts.columns else F.lit(None).cast("string")
    if facts is not None:
        out = out.join(facts.select(*keys, *known, *(["collection_error"] if "collection_error" in facts.columns else [])), keys, "left")
    out = out.withColumns({c: F.coalesce(F.col(c), default) if facts is not None else default for c, default in known.items()})
    given = (*(F.col(c) for c in known), capped, F.col("posts_returned"), missed)
    value = F.when(error.isNotNull(), 0.0).otherwise(S.coverage_reliability(*given))
    reasons = F.when(error.isNotNull(), F.array(error)).otherwise(S.coverage_reasons(*given))
    return out.withColumns({"hit_post_cap": capped, "coverage_reliability": value, "reliability_label": S.reliability_name(value), "reasons": reasons})


def summarize(coverage: DataFrame, keys: list[str]) -> DataFrame:
    """AGG7: sums, the mean reliability weighted by posts (one at least), and the first five reasons, in the order of sources."""
    weight = F.greatest("posts_returned", F.lit(1))
    sums = coverage.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sources"), F.sum("posts_returned").alias("posts"), F.sum("unique_threads").alias("threads"), F.sum("unique_authors").alias("authors"),
        F.count_if("hit_post_cap").alias("capped_sources"), F.count_if("feed_capped").alias("feed_capped_sources"), F.round(F.sum(F.col("coverage_reliability") * weight) / F.sum(weight), 3).alias("coverage_reliability"),
    )
    # of a reason that many sources have only the first place goes on
    each = coverage.select(*keys, "source_name", F.posexplode("reasons").alias("_n", "reason")).groupBy(*keys, "reason").agg(F.min(F.struct("source_name", "_n")).alias("_first"))
    listed = F.slice(F.array_sort(F.collect_list(F.struct("_first", "reason"))), 1, 5)
    return sums.join(each.groupBy(*keys).agg(F.transform(listed, lambda r: r["reason"]).alias("reasons")), keys, "left")


def adjusted_trend(summary: DataFrame, coverage: DataFrame, runs: DataFrame, run: str = "analysis_run_id") -> DataFrame:
    """SC15: growth of a ticker's rates against its row in the matched earlier run, for all runs at once.

    Rates are per hundred posts, threads (at least as many as posts) and authors of the run. ``summary``: run, ticker,
    total_mentions, unique_threads, unique_authors, average_hype_score, repetition_score, acceleration_score and
    emerging_ticker_score. ``coverage``: run, posts, threads, authors, coverage_reliability, feed_capped_sources, reasons. ``runs``:
    run, previous_run_id (null without a baseline), measured. The adjusted score takes the place of acceleration_score, and of
    coverage_reliability the one that it was weighted with; of the run's own reasons the first two are named, four in all.
    """
    posts, threads = F.col("posts"), F.greatest("threads", "posts", F.lit(1))
    rate = lambda x, y: F.round(F.col(x) / y * 100, 3)
    rates = {
        "mention_rate": rate("total_mentions", F.greatest(posts, F.lit(1))), "thread_rate": rate("unique_threads", threads), "author_rate": rate("unique_authors", F.greatest("authors", F.lit(1))),
    }
    now = summary.join(coverage.select(run, "posts", "threads", "authors", "coverage_reliability", "feed_capped_sources", "reasons"), run).withColumns(rates)
    # a run's own coverage, seen from the runs that it is the baseline of
    base = coverage.select(F.col(run).alias("previous_run_id"), F.col("posts").alias("previous_posts"), F.col("coverage_reliability").alias("previous_reliability"), F.col("feed_capped_sources").alias("previous_capped"))
    old = now.select(F.col(run).alias("previous_run_id"), "ticker", F.col("total_mentions").alias("previous_mentions"), *(F.col(k).alias(f"previous_{k}") for k in rates))
    out = now.join(runs.select(run, "previous_run_id", "measured"), run).join(base, "previous_run_id", "left").join(old, ["previous_run_id", "ticker"], "left")
    known = F.col("previous_mentions").isNotNull()
    out = out.fillna(0.0, [f"previous_{k}" for k in rates]).fillna(0, ["previous_posts"])
    lost = known & (F.col("previous_posts") > 0) & (F.col("previous_mention_rate") <= 0)
    out = out.withColumn("previous_mention_rate", F.when(lost, F.col("previous_mentions") / F.col("previous_posts") * 100).otherwise(F.col("previous_mention_rate")))
    growth = {k: S.bounded_growth(F.col(k), F.col(f"previous_{k}")) for k in rates}
    raw = S.clamp((growth["mention_rate"] * 0.45 + growth["thread_rate"] * 0.3 + growth["author_rate"] * 0.25) * 35)
    least = F.least("coverage_reliability", "previous_reliability")
    small = (F.col("previous_posts") < 30) | (posts < 30)
    reliability = F.when(small, F.least(least, F.lit(0.3))).otherwise(least)
    hype = F.greatest(F.lit(0.45), 1 - F.greatest(F.col("average_hype_score") - 4, F.lit(0.0)) * 0.07)
    repetition = F.greatest(F.lit(0.55), 1 - F.col("repetition_score") * 0.04)
    # The reasons.
    discovery = "Discovery scrape is excluded from proper acceleration; use it for ticker discovery and evidence review."
    alone = "No previous measurement scrape exists for this exact source set yet."
    also = F.array_compact(
        F.array(
            F.when(small, "Current or previous measurement sample is below 30 posts."), F.when(~known, "Ticker was not present in the previous matched measurement run."),
            F.when(F.col("previous_capped") > 0, "Previous measurement had at least one RSS-capped source."), F.when(F.col("feed_capped_sources") > 0, "Current measurement had at least one RSS-capped source."),
        )
    )
    reasons = F.slice(F.array_distinct(F.concat(F.slice(F.coalesce("reasons", F.array()), 1, 2), also)), 1, 4)
    fits = F.col("measured") & F.col("previous_run_id").isNotNull()
    score = F.when(fits, F.round(S.clamp(raw * reliability * hype * repetition), 2)).otherwise(0.0)
    return out.withColumns(
        {
            "coverage_adjusted_acceleration_score": score,
            "trend_reliability": F.when(~F.col("measured"), "Discovery").when(F.col("previous_run_id").isNull(), "Needs baseline").otherwise(S.reliability_name(reliability)),
            "trend_reliability_reason": F.when(~F.col("measured"), discovery).when(F.col("previous_run_id").isNull(), alone).otherwise(F.array_join(reasons, "; ")),
            "emerging_ticker_score": F.round(S.clamp(F.col("emerging_ticker_score") - F.col("acceleration_score") * 0.45 + score * 0.45), 2),
            "acceleration_score": score, "coverage_reliability": F.when(fits, F.round(reliability, 3)).otherwise(F.col("coverage_reliability")),
        }
    ).drop("reasons")


def previous_run(runs: DataFrame, run: str = "run_id") -> DataFrame:
    """JN10: for each run, the latest one that started earlier over the same set of sources, whatever their order.

    One row per set and start is ordered; of runs that started together the greatest id stands for them. Where runs have
    ``eligible``, only such runs are looked up.
    """
    keyed = runs.select(run, "started_at", F.array_join(F.array_sort("source_ids"), "\x1f").alias("_set"), *(["eligible"] if "eligible" in runs.columns else []))
    able = F.when(F.col("eligible"), F.col(run)) if "eligible" in runs.columns else F.col(run)
    w = Window.partitionBy("_set").orderBy("started_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("_set", "started_at").agg(F.max(able).alias("_id")).withColumn("previous_run_id", F.last("_id", ignorenulls=True).over(w))
    return keyed.join(starts, ["_set", "started_at"], "left").select(run, "previous_run_id")


def source_health(sources: DataFrame, coverage: DataFrame, activity: DataFrame) -> DataFrame:
    """JN8, SC23: selected sources with their coverage and activity."""
    out = sources.join(coverage, "source_name", "left").join(activity, "source_name", "left")
    filled = out.fillna(0, ["posts_returned", "comments_returned", "mentions", "tickers"])
    items = F.col("posts_returned") + F.col("comments_returned")
    # The states.
    status = F.when(F.col("coverage_reliability").isNull(), "No scrape").when(items == 0, "No items").when(F.col("tickers") == 0, "No tickers").otherwise("Active")
    return filled.withColumn("status", status)
