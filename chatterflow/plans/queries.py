"""One query per operator over the driver's tables; :mod:`.oracles` has their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import scores as S
from ..functions import text as T
from ..operators import buckets as B
from ..operators import attention, catalog, classify, cooldown, corpus, coverage, history, mentions, prices, signals, stats
from ..schema import conform_items
from ..sources import feeds, storage
from . import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Phrases of the documents that stand for the stock phrases of repetition.
PHRASES = ("licensed under", "of the", "que la")
#: A small catalog of symbols that occur in the documents, with two ambiguous ones.
CATALOG = ("AND", "CI", "DE", "DER", "EN", "ER", "IN", "LA", "OF", "THE", "TO", "WAS")
AMBIGUOUS = ("TO", "WAS")
#: Aliases, lower-cased, and their tickers.
ALIASES = {"licensed under": "LIC", "with that": "WTH", "of the": "OFT"}
#: Words of the documents that stand for finance, bullish, bearish and hype terms.
FINANCE, BULLISH, BEARISH, HYPE = ("tion", "heit", "mente", "eau"), ("than", "ver", "que"), ("idiot", "sch", "ción"), ("clown", "trash", "!!")


#: Columns that are days, shown as text so that any reader compares them alike.
DAYS: dict[str, tuple[str, ...]] = {
    "mention_explode": ("time_bucket",), "ticker_summary": ("first_seen_date", "most_recent_seen_date"), "time_buckets": ("bucket_start", "bucket_end"), "trailing_window": ("first_day",),
    "spike_notes": ("time_bucket",), "dense_grid": ("time_bucket",), "daily_bars": ("date",), "long_bars": ("date",), "asof_forward": ("day", "price_date"), "asof_calendar": ("day",),
    "horizon_outcomes": ("date",), "volume_baseline": ("date",), "path_metrics": ("day",), "fetch_plan": ("first_day", "last_day"), "correlation_dataset": ("bucket_start", "price_date"),
    "dataset_diagnostics": ("date_start", "date_end"), "rolling_corr": ("bucket_start",), "zscore_overlay": ("bucket_start",), "market_outcomes": ("signal_day",),
    "bucket_sentiment": ("bucket_start",), "rolling_corr_by_ticker": ("bucket_start",), "benchmark_outcomes": ("signal_day",), "corpus_counts": ("first_seen_date", "most_recent_seen_date"), "date_bounds": ("start_day", "end_day"), "run_timeline": ("day",), "correlation_fetch_plan": ("first_day", "last_day"),
    **{f"signal_buckets_{p}": ("bucket_start",) for p in ("daily", "weekly", "monthly", "run")},
}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    days = DAYS.get(f.__name__, ())
    QUERIES[f.__name__] = lambda spark, sf: f(spark, sf).withColumns({c: F.col(c).cast("string") for c in days}) if days else f(spark, sf)
    return f


def with_symbols(items: DataFrame) -> DataFrame:
    found = T.symbols(F.col("body_text"), CATALOG, AMBIGUOUS)
    return items.withColumn("tickers", found).withColumn("company_names", F.transform(found, lambda t: F.lit("Unknown")))


@query
def symbol_extract(spark, sf):
    """STR1, STR2."""
    return with_symbols(A.items(spark, sf)).select("item_id", F.array_join("tickers", ",").alias("symbols"))


@query
def alias_extract(spark, sf):
    """STR3, JN22."""
    return A.items(spark, sf).select("item_id", F.array_join(T.aliases(F.col("body_text"), ALIASES), ",").alias("tickers"))


@query
def entity_extract(spark, sf):
    """STR1-5, JN22: with a catalog that grows as the documents do."""
    found = catalog.found(A.items(spark, sf), A.entity_catalog(spark, sf))
    return found.select("item_id", F.array_join("tickers", ",").alias("tickers"), F.array_join("company_names", ",").alias("company_names"))


@query
def item_features(spark, sf):
    """STR6, STR7, STR10."""
    body = F.col("body_text")
    return A.items(spark, sf).select(
        "item_id", F.length(body).cast("long").alias("text_length"), T.word_count(body).alias("word_count"), T.has_link(body).alias("contains_link"), T.has_digit(body).alias("contains_numbers"),
        T.any_of(F.lower(body), FINANCE).alias("contains_financial_terms"), T.author_hash(F.col("author")).alias("author_hash"),
    )


@query
def claim_specificity(spark, sf):
    """SC3."""
    return A.items(spark, sf).select("item_id", S.specificity(F.col("body_text"), FINANCE).alias("claim_specificity_score"))


@query
def repetition_score(spark, sf):
    """SC4."""
    return A.items(spark, sf).select("item_id", S.repetition(F.col("body_text"), PHRASES).alias("repetition_score"))


@query
def fallback_classify(spark, sf):
    """DF2."""
    return classify.fallback(with_symbols(A.items(spark, sf)), BULLISH, BEARISH, HYPE, FINANCE).select(
        "item_id", "sentiment", "confidence", "evidence_quality", "depth_score", "hype_score", "needs_deeper_analysis", F.array_join("red_flags", ", ").alias("red_flags"), "bull_case", "bear_case"
    )


@query
def alpha_score(spark, sf):
    """SC1, SC2, on the fallback's view of the documents."""
    c = classify.fallback(with_symbols(A.items(spark, sf)), BULLISH, BEARISH, HYPE, FINANCE).withColumn("_low", F.lower(F.concat_ws(" ", "thread_title", "body_text")))
    alpha = S.alpha(
        F.col("thread_title"), F.col("body_text"), F.col("score"), F.col("depth_score"), F.col("evidence_quality"), F.col("confidence"), F.col("claim_specificity_score"), F.col("hype_score"),
        F.col("bear_case"), F.size("red_flags"), F.lit(""), HYPE, FINANCE, BEARISH, ("clown",), lowered=F.col("_low"),
    )
    return c.select("item_id", alpha.alias("alpha_signal_score"), S.hype_adjusted(alpha, F.col("hype_score"), F.lit(1)).alias("hype_adjusted_signal_score"))


@query
def model_answers(spark, sf):
    """DF3, DF1, ARR4-6, NUM3-5: landed answers in good and bad form, the fallback where none can be read."""
    items = with_symbols(A.items(spark, sf))
    good = '{"sentiment":" Bullish ","confidence":1.7,"tickers":["the","zz","OF"],"depth_score":"7","red_flags":" one flag ","bull_case":true,"summary":" short ","needs_deeper_analysis":"yes","evidence_quality":"HIGH"}'
    full = '{"sentiment":"odd","tickers":"in","hype_score":99,"claim_specificity_score":3,"claims_to_verify":["a"," b ",""],"bear_case":" falls ","needs_deeper_analysis":1,"confidence":"x"}'
    kind = F.col("item_id") % 7
    first = F.when(kind == 1, good).when(kind == 2, f"Sure: {full} ok").when(kind == 5, full).when(kind == 6, "[1]").otherwise('{"sentiment":')
    answers = items.filter(kind > 0).select("item_id", F.lit(0).alias("attempt"), first.alias("content")).unionByName(items.filter(kind == 4).select("item_id", F.lit(1).alias("attempt"), F.lit(good).alias("content")))
    out = classify.answered(items, answers, FINANCE, PHRASES, bullish=BULLISH, bearish=BEARISH, hype=HYPE)
    lists = {c: F.array_join(c, "|") for c in ("tickers", "company_names", "red_flags", "claims_to_verify")}
    return out.withColumns(lists).select("item_id", "classifier_mode", "sentiment", F.round("confidence", 4).alias("confidence"), "evidence_quality", F.col("depth_score").cast("int").alias("depth_score"), F.col("hype_score").cast("int").alias("hype_score"), "claim_specificity_score", "needs_deeper_analysis", "bull_case", "bear_case", *lists)


@query
def mention_explode(spark, sf):
    """ARR8: documents by symbol."""
    c = classify.fallback(with_symbols(A.items(spark, sf)), BULLISH, BEARISH, HYPE, FINANCE).withColumns({"created_time": F.lit("2024-01-03").cast("timestamp"), "author_hash": F.lit(None).cast("string")})
    return mentions.explode(c).select("item_id", "ticker", "company_name", "author_hash", "sentiment_numeric", F.col("evidence_quality_numeric"), "text_length", "time_bucket")


@query
def html_to_text(spark, sf):
    """STR8."""
    return A.table(spark, sf, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query
def json_extract(spark, sf):
    """ARR3, PRJ3."""
    return A.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query
def json_tables(spark, sf):
    """SRC14, ARR3, SNK13: props, of which every tenth is cut and every eleventh absent, decoded, read and written again."""
    e = A.table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 10 == 0, F.left("props", F.length("props") - 1)).otherwise(F.col("props"))
    d = J.decoded(e.select("event_id", raw.alias("props_json"), F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("event_id") % 4).alias("score")), {"props_json": "{}"})
    kept = F.try_variant_get("props_json", "$", "string")
    return d.select("event_id", J.value(F.col("props_json"), "$.k", "long").alias("k"), F.when(F.schema_of_variant("props_json") == "STRING", kept).alias("unparsed"), J.encoded(d).alias("row"))


@query
def excerpt(spark, sf):
    """STR13."""
    return A.items(spark, sf).select("item_id", T.excerpt(F.col("body_text"), 60).alias("excerpt"))


@query
def claims(spark, sf):
    """STR17, STR18, over conversation turns."""
    c = A.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", "role", F.array_join(T.claims_to_verify(F.col("text")), "|").alias("claims"), F.array_join(T.risks(F.col("text")), "|").alias("risks"), F.array_join(T.catalysts(F.col("text")), "|").alias("catalysts"))


@query
def value_labels(spark, sf):
    """STR14, STR15: symbols and numbers of orders as they are shown."""
    o = A.table(spark, sf, "orders")
    raw = F.concat(F.lit(" $"), F.lower(F.substring("o_orderpriority", 3, 3)), F.lit(" "))
    symbol = F.when(F.col("o_orderkey") % 5 == 0, "SQ").otherwise(T.ticker(raw))
    share = F.when(F.col("o_orderkey") % 9 == 0, None).otherwise((F.col("o_orderkey") % 2000 + 0.25) / 100000)
    return o.select("o_orderkey", T.market_symbol(symbol).alias("symbol"), T.p_label(share).alias("p"), T.delta_label(F.when(F.col("o_orderkey") % 9 > 0, F.col("o_custkey") % 100 - 50), 0).alias("delta"))


@query
def mention_dedupe(spark, sf):
    """SNK3: by thread and ticker, as items with several mentions."""
    m = A.mentions(spark, sf).withColumn("seq", F.col("item_id")).withColumn("item_id", F.col("thread_id"))
    return mentions.dedupe(m, "seq").select("item_id", "ticker", "company_name", "seq")


@query
def ticker_summary(spark, sf):
    """AGG1: which entities accelerate, and on what evidence."""
    return mentions.ticker_summary(A.mentions(spark, sf))


@query
def time_buckets(spark, sf):
    """AGG2."""
    return mentions.time_buckets(A.mentions(spark, sf))


@query
def run_summary(spark, sf):
    """AGG4."""
    m = A.mentions(spark, sf)
    return mentions.run_summary(m, mentions.ticker_summary(m, ["ticker"]))


@query
def flag_backjoin(spark, sf):
    """JN5."""
    m = A.mentions(spark, sf)
    return mentions.with_flags(m, mentions.ticker_summary(m, ["ticker"])).select("item_id", "ticker", "source_diversity_score", "controversy_score", "low_mentions_high_signal", "new_ticker_detected")


@query
def corpus_dedupe(spark, sf):
    """TOP7, over threads as items."""
    m = A.mentions(spark, sf).withColumn("mention_id", F.col("item_id")).withColumn("item_id", F.col("thread_id"))
    return corpus.latest_mentions(m).select("item_id", "ticker", "mention_id")


@query
def company_mode(spark, sf):
    """AGG10."""
    return corpus.with_usual_company(A.mentions(spark, sf)).groupBy("ticker", "company_name").agg(F.count(F.lit(1)).alias("n"))


def _review(preset: str):
    def run(spark, sf):
        return corpus.review_filter(A.mentions(spark, sf), preset).select("item_id", "ticker", "alpha_signal_score")

    run.__name__ = f"review_{preset}"
    return query(run)


for _preset in ("balanced", "high_signal", "low_hype_leads", "new_tickers", "needs_verification"):
    _review(_preset)


@query
def trailing_window(spark, sf):
    """FLT4."""
    return corpus.trailing_window(A.mentions(spark, sf), 7).groupBy("ticker").agg(F.count(F.lit(1)).alias("mentions"), F.min("created_date").alias("first_day"))


@query
def quick_search(spark, sf):
    """FLT9, FLT13."""
    return corpus.search(A.items(spark, sf), "Licensed under", ["source_name", "body_text"]).select("item_id", "source_name")


@query
def thread_summary(spark, sf):
    """AGG11, AGG27."""
    return corpus.thread_summary(A.mentions(spark, sf))


@query
def representative_sample(spark, sf):
    """TOP5."""
    return corpus.representative(A.mentions(spark, sf)).select("ticker", "item_id", "place")


@query
def spike_notes(spark, sf):
    """TOP6."""
    m = A.mentions(spark, sf)
    return corpus.spikes(mentions.time_buckets(m), m)


@query
def trust_label(spark, sf):
    """SC17, AGG18."""
    label = S.trust(F.col("classifier_mode"), F.col("confidence"), F.col("evidence_quality"), F.col("hype_score"))
    return A.mentions(spark, sf).groupBy(label.alias("trust")).agg(F.count(F.lit(1)).alias("n"))


@query
def watchlist_semi(spark, sf):
    """JN19, SET4: mentions of completed measurement runs, of tickers that also have a bullish mention by source s0."""
    m = A.mentions(spark, sf)
    liked = m.filter("source_name = 's0' AND sentiment = 'bullish' AND depth_score >= 9").select("ticker")
    measured = history.completed(A.runs(spark, sf), measured=True).select("analysis_run_id")
    return m.join(measured, "analysis_run_id", "left_semi").join(liked, "ticker", "left_semi").groupBy("ticker").agg(F.count(F.lit(1)).alias("mentions"))


@query
def new_items(spark, sf):
    """FLT10, SET3."""
    m = A.mentions(spark, sf)
    return corpus.new_items(m.select("item_id", "ticker"), m.filter("time_bucket < DATE'2024-01-15'"))


@query
def union_dedupe(spark, sf):
    """SET1: posts and comments, which are all mentions; a post wins over comments, then the first."""
    m = A.mentions(spark, sf)
    kinds = [m.filter(F.col("item_type") == kind).select("thread_id", "ticker", "item_id").withColumn("kind", F.lit(kind)) for kind in ("post", "comment")]
    return corpus.dedupe_union(kinds, ["thread_id", "ticker"], "item_id")


@query
def wide_pivot(spark, sf):
    """SNK11."""
    return corpus.wide(A.mentions(spark, sf), "ticker", "source_name", "alpha_signal_score", [f"s{i}" for i in range(5)])


@query
def first_cells(spark, sf):
    """AGG23: the first mention's score in each cell."""
    return corpus.wide(A.mentions(spark, sf), "ticker", "source_name", "alpha_signal_score", [f"s{i}" for i in range(5)], "item_id")


@query
def unpivot_pair(spark, sf):
    """AGG24."""
    m = A.mentions(spark, sf).select("item_id", F.col("hype_score").cast("double").alias("hype_score"), F.col("alpha_signal_score"))
    return m.unpivot(["item_id"], ["hype_score", "alpha_signal_score"], "variable", "value")


@query
def histogram(spark, sf):
    """AGG25."""
    bin_ = F.least(F.floor(F.col("alpha_signal_score") / 5), F.lit(19)).cast("long")
    return A.mentions(spark, sf).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query
def run_compare(spark, sf):
    """JN9: the summaries of two weeks."""
    m = A.mentions(spark, sf)
    per = lambda day: m.filter(F.col("time_bucket") == F.lit(day).cast("date")).groupBy("ticker").agg(F.count(F.lit(1)).alias("mentions"), F.round(F.avg("hype_score"), 2).alias("hype"))
    return corpus.compare(per("2024-01-08"), per("2024-01-01"), ["mentions", "hype"])


@query
def dense_grid(spark, sf):
    """JN20, over tickers by source and community."""
    rows = A.mentions(spark, sf).groupBy(F.concat_ws("/", "ticker", "source_name", "subreddit").alias("ticker"), "time_bucket").agg(F.count(F.lit(1)).alias("mentions"))
    return corpus.dense(rows, "ticker", "time_bucket", ["mentions"])


@query
def consensus(spark, sf):
    """DF5, ARR2: with the source and the kind of a mention as its claims."""
    claims = F.array(F.concat_ws(" in ", "item_type", "subreddit"), F.concat_ws(" of ", "item_type", "source_name"))
    found = corpus.consensus(A.mentions(spark, sf).withColumn("claims", claims))
    return found.select("ticker", "mentions", "stance", "confidence", "flags", F.round("evidence", 4).alias("evidence"), "signature", *(F.array_join(c, "|").alias(c) for c in ("bull_case", "bear_case")))


@query
def corpus_reset(spark, sf):
    """SC26."""
    return corpus.reset_corpus_scores(mentions.ticker_summary(A.mentions(spark, sf), ["ticker"])).select("ticker", "emerging_ticker_score", "acceleration_score", "trend_reliability")


def _coverage(spark, sf) -> DataFrame:
    rows = A.mentions(spark, sf).withColumn("window_start", F.col("time_bucket").cast("timestamp"))
    return coverage.source_coverage(rows, ["analysis_run_id", "source_name"], 7, post_cap=120, facts=A.source_facts(spark, sf))


@query
def coverage_rows(spark, sf):
    """AGG22, SC16."""
    return _coverage(spark, sf).select("analysis_run_id", "source_name", "posts_returned", "comments_returned", "unique_threads", "unique_authors", "hit_post_cap", "coverage_reliability", "reliability_label")


@query
def coverage_weighted(spark, sf):
    """AGG7."""
    return coverage.summarize(_coverage(spark, sf), ["analysis_run_id"]).withColumn("reasons", F.array_join("reasons", "; "))


@query
def rate_growth(spark, sf):
    """SC14, SC15, JN11: every run's tickers against the measurement run before it."""
    runs = history.completed(A.runs(spark, sf)).withColumn("eligible", F.expr("run_type = 'measurement' AND canonical_trend_run"))
    known = runs.join(coverage.previous_run(runs, "analysis_run_id"), "analysis_run_id").withColumn("measured", F.col("eligible"))
    out = coverage.adjusted_trend(A.run_summaries(spark, sf), coverage.summarize(_coverage(spark, sf), ["analysis_run_id"]), known)
    return out.select(
        "analysis_run_id", "ticker", "mention_rate", "thread_rate", "author_rate", "previous_mention_rate", "coverage_adjusted_acceleration_score", "trend_reliability", "trend_reliability_reason", "emerging_ticker_score",
        "acceleration_score", "coverage_reliability",
    )


@query
def previous_run(spark, sf):
    """JN10: days as runs; the set of event types with more than a fifth of the day's events as their sources."""
    e = A.table(spark, sf, "events").withColumn("day", F.col("ts").cast("date"))
    # five types at most
    of_day = e.groupBy("day", "event_type").count().groupBy("day").agg(F.sum("count").alias("n"), F.collect_list(F.struct("event_type", "count")).alias("kinds"))
    kinds = of_day.select("day", F.transform(F.filter("kinds", lambda k: k["count"] * 5 > F.col("n")), lambda k: k["event_type"]).alias("source_ids"))
    runs = kinds.select(F.col("day").cast("string").alias("run_id"), F.col("day").alias("started_at"), "source_ids")
    return coverage.previous_run(runs)


@query
def source_health(spark, sf):
    """JN8, JN4, SC23."""
    m = A.mentions(spark, sf)
    sources = A.table(spark, sf, "nation").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("source_name"))
    # the feature: the health of the sources in one run
    cov = _coverage(spark, sf).filter("analysis_run_id = 'run_2024-01-08'").select("source_name", "posts_returned", "comments_returned", "coverage_reliability")
    activity = m.filter("analysis_run_id = 'run_2024-01-08'").groupBy("source_name").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("ticker").alias("tickers"))
    return coverage.source_health(sources, cov, activity)


@query
def source_set_hash(spark, sf):
    """ARR1."""
    sets = A.table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("ids"))
    return sets.select("n_regionkey", F.substring(F.sha1(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")), 1, 16).alias("hash"))


@query
def daily_bars(spark, sf):
    return A.bars(spark, sf)


@query
def long_bars(spark, sf):
    return A.long_bars(spark, sf)


def _probes(spark, sf) -> DataFrame:
    """A day for every order, for the brand that its number names."""
    o = A.table(spark, sf, "orders")
    return o.selectExpr("o_orderkey AS probe", "concat('Brand#', cast(1 + o_orderkey % 5 AS string), cast(1 + (o_orderkey div 5) % 5 AS string)) AS ticker", "cast(o_orderdate AS date) AS day")


@query
def asof_forward(spark, sf):
    """JN12."""
    return prices.asof_forward(_probes(spark, sf), A.long_bars(spark, sf), "day", ["close"])


@query
def asof_calendar(spark, sf):
    """JN13."""
    return prices.calendar_returns(_probes(spark, sf), A.long_bars(spark, sf), "probe", "day")


@query
def horizon_outcomes(spark, sf):
    """WIN8-13: ready outcomes on each bar."""
    out = prices.with_outcomes(A.bars(spark, sf))
    return out.select(
        "ticker", "date", "raw_return_same_day", "gap_return_1d", "prior_return_5d", "prior_volatility_10d",
        *(F.col(f"{m}_{h}").cast("double").alias(f"{m}_{h}") for m in ("raw_return", "price_direction", "volume_change", "drawdown") for h in ("1d", "5d", "1m")), "volatility_5d",
    )


@query
def volume_baseline(spark, sf):
    """WIN14."""
    return prices.with_outcomes(A.long_bars(spark, sf), {}).select("ticker", "date", "baseline_volume")


@query
def path_metrics(spark, sf):
    """JN15, JN16."""
    return prices.path_metrics(_probes(spark, sf), A.long_bars(spark, sf), "probe", "day")


@query
def fetch_plan(spark, sf):
    """SRC16, SRC17."""
    plan = prices.fetch_plan(_probes(spark, sf), "day")
    return prices.cache_is_sufficient(plan, A.long_bars(spark, sf), F.lit("2001-09-01").cast("date")).select("ticker", "first_day", "last_day", "sufficient")


@query
def price_placeholders(spark, sf):
    """SNK8."""
    bars = A.long_bars(spark, sf).withColumn("price_available", F.lit(True)).select("ticker", "date", "close", "price_available")
    return prices.with_placeholders(bars, _probes(spark, sf).withColumnRenamed("day", "date")).groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("price_available")).alias("missing"))


def _signals(period: str):
    def run(spark, sf):
        return B.signal_buckets(A.mentions(spark, sf), period, 2)

    run.__name__ = f"signal_buckets_{period.split()[-1].lower()}"
    return query(run)


for _period in ("Daily", "Weekly", "Monthly", "Per analysis run"):
    _signals(_period)


def _dataset(spark, sf) -> DataFrame:
    """Daily buckets of the event types, with outcomes against VIEW as the benchmark."""
    m = A.mentions(spark, sf).withColumn("_t", F.substring("ticker", 1, 2))
    names = {"VI": "VIEW", "SI": "SIGNUP", "ER": "ERROR", "CL": "CLICK", "PU": "PURCHASE"}
    ticker: Column = F.lit(None).cast("string")
    for short, name in names.items():
        ticker = F.when(F.col("_t") == short, name).otherwise(ticker)
    return B.with_price_outcomes(B.signal_buckets(m.withColumn("ticker", ticker), "Daily"), A.bars(spark, sf), "VIEW")


GRID_SIGNALS, GRID_OUTCOMES = ["mentions", "mention_acceleration", "average_hype_score", "average_sentiment_score"], ["raw_return_1d", "raw_return_5d", "abnormal_return_5d"]


@query
def correlation_dataset(spark, sf):
    """ST11, ST13."""
    return _dataset(spark, sf).select("ticker", "bucket_start", "mentions", "price_date", "price_available", *GRID_OUTCOMES, "market_return_5d")


@query
def dataset_diagnostics(spark, sf):
    """AGG14."""
    return B.diagnostics(_dataset(spark, sf))


@query
def pearson_grid(spark, sf):
    """ST1, ST2, ST5, ST6, ST8."""
    return stats.pearson_grid(stats.long_pairs(_dataset(spark, sf), [], GRID_SIGNALS, GRID_OUTCOMES))


@query
def spearman_grid(spark, sf):
    """ST3, WIN17."""
    return stats.spearman_grid(storage.written(stats.long_pairs(_dataset(spark, sf), [], GRID_SIGNALS, GRID_OUTCOMES)))


@query
def kendall_tau_b(spark, sf):
    """ST4."""
    return stats.kendall_grid(storage.written(stats.long_pairs(_dataset(spark, sf), [], GRID_SIGNALS, GRID_OUTCOMES)))


@query
def lead_lag(spark, sf):
    """ST9."""
    return stats.pearson_grid(stats.long_pairs(_dataset(spark, sf), [], ["mentions"], [f"raw_return_{h}" for h in ("same_day", "1d", "3d", "5d", "10d", "20d", "1m")]))


@query
def correlation_warnings(spark, sf):
    """ST7."""
    return stats.warnings(storage.written(stats.long_pairs(_dataset(spark, sf), [], GRID_SIGNALS, GRID_OUTCOMES)))


@query
def interesting_rank(spark, sf):
    """SC20, FLT7, TOP2."""
    g = stats.pearson_grid(stats.long_pairs(_dataset(spark, sf), [], GRID_SIGNALS, GRID_OUTCOMES))
    score = S.interesting(F.col("correlation"), F.col("p_value"), F.col("sample_size"), F.col("missing_count"), ~F.col("outcome").contains("same_day"), F.col("outcome").contains("abnormal_return"))
    order = F.row_number().over(Window.orderBy(F.desc("interesting_score"), "signal", "outcome")).cast("long")  # a row for each cell of the grid
    return g.filter("sample_size >= 20").select("signal", "outcome", F.round(score, 4).alias("interesting_score")).withColumn("place", order).orderBy("place")


def _rolling(spark, sf) -> DataFrame:
    rows = _dataset(spark, sf).select("ticker", "bucket_start", "mentions", F.col("raw_return_1d").alias("y"))
    return stats.rolling_correlation(rows, "mentions", "y", ["bucket_start", "ticker"], 14)


@query
def rolling_corr(spark, sf):
    """WIN15: over all tickers by time."""
    return _rolling(spark, sf).select("ticker", "bucket_start", "rows_in_window", "rolling_correlation")


def _rolling_ranks(method: str, by: list[str]):
    def run(spark, sf):
        rows = _dataset(spark, sf).select("ticker", "bucket_start", "mentions", F.col("raw_return_1d").alias("y"))
        return stats.rolling_ranks(rows, "mentions", "y", ["bucket_start", "ticker"], method, 14, by).select("ticker", "bucket_start", "rows_in_window", "rolling_correlation")

    run.__name__ = f"rolling_{method}" + "_by_ticker" * bool(by)
    DAYS[run.__name__] = ("bucket_start",)
    return query(run)


for _method in ("spearman", "kendall"):
    for _by in ([], ["ticker"]):
        _rolling_ranks(_method, _by)


@query
def rolling_corr_by_ticker(spark, sf):
    """WIN15, a series for each ticker."""
    rows = _dataset(spark, sf).select("ticker", "bucket_start", "mentions", F.col("raw_return_1d").alias("y"))
    return stats.rolling_correlation(rows, "mentions", "y", ["bucket_start"], 14, ["ticker"]).select("ticker", "bucket_start", "rows_in_window", "rolling_correlation")


@query
def descriptive_stats(spark, sf):
    """AGG13."""
    return stats.descriptive(_dataset(spark, sf), ["mentions", "average_hype_score", "raw_return_5d"])


@query
def zscore_overlay(spark, sf):
    """AGG17."""
    daily = _dataset(spark, sf).groupBy("bucket_start").agg(F.avg("mentions").alias("x"), F.avg("raw_return_1d").alias("y"))
    return stats.z_scores(daily, ["x", "y"]).select("bucket_start", "x_z", "y_z")


@query
def ols_coefficients(spark, sf):
    """ST10 with one predictor, whose closed form SQL has too."""
    fit = stats.regression(_dataset(spark, sf), "raw_return_5d", ["mentions"])
    by = {t["term"]: t for t in fit["terms"]}
    row = (fit["n"], *(round(by[t][v], 6) for t in ("intercept", "mentions") for v in ("coefficient", "standard_error")), round(fit["r_squared"], 6))
    return spark.createDataFrame([row], "n long, intercept double, intercept_se double, slope double, slope_se double, r_squared double")


@query
def ols_several(spark, sf):
    """ST10 with two predictors."""
    fit = stats.regression(_dataset(spark, sf), "raw_return_5d", ["mentions", "average_hype_score"])
    rows = [(t["term"], *(round(t[v], 5) for v in ("coefficient", "standard_error")), round(fit["r_squared"], 6), fit["n"]) for t in fit["terms"]]
    return spark.createDataFrame(rows, "term string, coefficient double, standard_error double, r_squared double, n long")


@query
def top_evidence(spark, sf):
    """TOP4."""
    return signals.top_evidence(A.mentions(spark, sf)).select("ticker", "item_id", "place")


@query
def signal_gate(spark, sf):
    """DF7, WIN16, SC19."""
    m = A.mentions(spark, sf)
    s = mentions.ticker_summary(m, ["ticker"]).withColumns({"analysis_run_id": F.lit("run"), "coverage_reliability": F.lit(0.6), "trend_reliability": F.lit("Medium")})
    model = m.groupBy("ticker").agg(F.count_if(F.col("classifier_mode") != "fallback").alias("model_mentions"))
    frozen = s.filter("total_mentions < 20").select("analysis_run_id", "ticker")
    return signals.candidates(s.join(model, "ticker"), manual=("VI1", "CL2"), frozen=frozen).select("ticker", "signal_rank", "score_gate", "quality_gate", "strength", "freezes")


@query
def cooldown_fold(spark, sf):
    """DF8."""
    return cooldown.cooldown(A.signal_events(spark, sf)).select("ticker", "signal_id")


@query
def cooldown_by_run(spark, sf):
    """DF8: events of one hour are of one run, and the weakest are manual."""
    e = A.signal_events(spark, sf).withColumns({"analysis_run_id": F.date_trunc("hour", "signal_time").cast("string"), "manual": F.col("strength") < 1})
    return cooldown.cooldown(e).select("ticker", "signal_id")


def _measured_runs(spark, sf) -> DataFrame:
    cov = coverage.summarize(_coverage(spark, sf), ["analysis_run_id"]).select("analysis_run_id", "coverage_reliability")
    return history.completed(A.runs(spark, sf), measured=True).join(cov, "analysis_run_id", "left")


def _attention(spark, sf) -> DataFrame:
    t = A.table(spark, sf, "events").select(F.col("event_id").alias("item_id"), F.upper("event_type").alias("ticker"))
    return attention.attention(A.signal_events(spark, sf), A.mentions(spark, sf).drop("ticker").join(t, "item_id"), _measured_runs(spark, sf))


@query
def attention_outcomes(spark, sf):
    """DF11, JN17-19, SC18: in the scope of each event's later measurement runs, else of the corpus."""
    return _attention(spark, sf).drop("signal_time", "attention_reliability")


@query
def random_benchmark(spark, sf):
    """TOP11."""
    return signals.drawn_benchmark(A.signal_events(spark, sf), A.long_bars(spark, sf))


@query
def benchmark_means(spark, sf):
    """AGG8, DF10."""
    per = A.bars(spark, sf).groupBy("ticker").agg(F.round(F.avg("close"), 4).alias("r"))
    sample = signals.random_benchmark(A.signal_events(spark, sf), per, 3)
    return signals.benchmark_means(sample, per, ["r"])


@query
def market_outcomes(spark, sf):
    """DF9: against VIEW as the benchmark."""
    return prices.market_outcomes(A.signal_events(spark, sf), A.adjusted_bars(spark, sf), "signal_id", "signal_day", "VIEW")


@query
def signal_review(spark, sf):
    """JN7, AGG15."""
    e = A.signal_events(spark, sf)
    labels = e.filter("strength >= 30").select("signal_id", F.when(F.col("strength") >= 60, "good").otherwise("unlabeled").alias("label"))
    return signals.validation_status(e, labels)


@query
def upsert_merge(spark, sf):
    """SNK1: orders, of which every third comes again with a new price."""
    o = A.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    new = o.filter("o_orderkey % 3 = 0").withColumn("o_totalprice", F.round(F.col("o_totalprice") + 1, 2))
    return storage.upsert(o, new, ["o_orderkey"], keep=["o_custkey"])


@query
def status_counts(spark, sf):
    """AGG18."""
    return A.table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query
def table_counts(spark, sf):
    """AGG19: the rows of each table."""
    names = ("orders", "lineitem", "events", "documents", "pages", "conversations", "labels", "embeddings")
    counts = [A.table(spark, sf, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in names]
    return reduce(DataFrame.unionByName, counts)


@query
def completed_mentions(spark, sf):
    """JN1, FLT1, FLT12, DT7."""
    rows = history.completed_mentions(A.mentions(spark, sf), A.runs(spark, sf), A.classifications(spark, sf))
    return rows.select("item_id", "ticker", "analysis_run_id", "run_type", "canonical_trend_run", "classifier_mode")


def _history(spark, sf) -> DataFrame:
    return history.historical_summaries(A.run_summaries(spark, sf), A.runs(spark, sf))


@query
def historical_summaries(spark, sf):
    """JN2, JN3."""
    return _history(spark, sf).select("ticker", "analysis_run_id", "total_mentions", "run_type", F.array_join("source_set", ",").alias("source_set"))


@query
def measured_history(spark, sf):
    """FLT15: history of canonical measurement runs alone."""
    runs = history.completed(A.runs(spark, sf), measured=True)
    return history.historical_summaries(A.run_summaries(spark, sf), runs).groupBy("ticker").agg(F.count(F.lit(1)).alias("runs"), F.sum("total_mentions").alias("mentions"))


@query
def ticker_history(spark, sf):
    """WIN19, WIN20."""
    return history.latest_points(_history(spark, sf), "total_mentions", 3).select("ticker", "analysis_run_id", "previous_run_id", "total_mentions", "back")


@query
def ticker_shift(spark, sf):
    """WIN22."""
    return history.deterministic_shift(_history(spark, sf))


@query
def source_activity(spark, sf):
    """AGG9: threads as items."""
    m = A.mentions(spark, sf).withColumn("item_id", F.col("thread_id"))
    return history.source_activity(m, m).withColumn("newest_item_time", F.date_format("newest_item_time", "yyyy-MM-dd HH:mm:ss"))


@query
def explorer_stats(spark, sf):
    """AGG12."""
    out = history.explorer_stats(A.mentions(spark, sf))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_seen", "last_seen")})


@query
def bucket_sentiment(spark, sf):
    """AGG21, JN25."""
    m = A.mentions(spark, sf)
    return history.bucket_sentiment(mentions.time_buckets(m), m).select("ticker", "company_name", "bucket_start", "total_mentions", "net_sentiment_score")


@query
def ticker_claims(spark, sf):
    """AGG26, over documents by symbol."""
    rows = with_symbols(A.items(spark, sf)).select(F.explode("tickers").alias("ticker"), T.claims_to_verify(F.col("body_text")).alias("claims"))
    return history.ticker_claims(rows)


def _corpus(spark, sf) -> dict[str, DataFrame]:
    m = A.mentions(spark, sf).withColumn("item_id", F.col("thread_id")).drop("classifier_mode", "run_completed")
    return history.corpus_frames(m, A.runs(spark, sf), A.classifications(spark, sf, "thread_id"))


@query
def corpus_summary(spark, sf):
    """DF6."""
    names = ("ticker", "company_name", "total_mentions", "unique_authors", "emerging_ticker_score", "acceleration_score", "trend_reliability", "coverage_reliability")
    return _corpus(spark, sf)["summary"].select(*names)


@query
def corpus_counts(spark, sf):
    """DF6: the corpus in numbers."""
    return _corpus(spark, sf)["counts"]


@query
def corpus_flags(spark, sf):
    """DF6: mentions of the corpus with their ticker's flags and trust."""
    rows = _corpus(spark, sf)["mentions"]
    return rows.groupBy("ticker", "trust_status", "low_mentions_high_signal", "new_ticker_detected").agg(F.count(F.lit(1)).alias("n"))


@query
def benchmark_outcomes(spark, sf):
    """DF10."""
    return signals.benchmark_outcomes(A.signal_events(spark, sf), A.adjusted_bars(spark, sf), 3)


@query
def attention_reliability(spark, sf):
    """SC22, DF11."""
    return _attention(spark, sf).select("signal_id", "attention_reliability")


def _review_frame(spark, sf) -> DataFrame:
    e = A.signal_events(spark, sf)
    label = F.when(F.col("strength") >= 80, "Useful lead").when(F.col("strength") >= 60, "Worth deeper research").when(F.col("strength") >= 40, "Too early")
    labels = e.select("signal_id", label.alias("label")).filter("label is not null")
    bars = A.adjusted_bars(spark, sf)
    market = prices.market_outcomes(e, bars, "signal_id", "signal_day", "VIEW")
    means = signals.random_means(signals.benchmark_outcomes(e, bars, 3))
    return signals.review(e, labels, market, _attention(spark, sf), means)


@query
def review_frame(spark, sf):
    """JN7, AGG8: signals with labels, market, attention and random benchmark."""
    return _review_frame(spark, sf).select("signal_id", "ticker", "label", "return_7d", "excess_return_7d", "spread_14d", "attention_reliability", "random_sample_size", "random_mean_return_7d", "random_mean_return_30d", "random_mean_volume_spike_7d")


@query
def review_kpis(spark, sf):
    """AGG16."""
    return signals.review_kpis(_review_frame(spark, sf))


@query
def signal_inbox(spark, sf):
    """FLT8, TOP9: unlabelled signals of a ticker, the widest attention first."""
    return signals.inbox(_review_frame(spark, sf), label="", ticker="view", sort="attention").select("signal_id", "spread_14d")


@query
def recent_events(spark, sf):
    """TOP12."""
    return signals.recent_events(A.signal_events(spark, sf)).select("ticker", "signal_id", "back")


def _ticker_summary(spark, sf) -> DataFrame:
    return mentions.ticker_summary(A.mentions(spark, sf), ["ticker"])


@query
def summary_presets(spark, sf):
    """TOP1, TOP3, TOP14: the first eight tickers by each preset."""
    summary, out = _ticker_summary(spark, sf), None
    for preset in corpus.SORTS:
        rows = corpus.top_summaries(summary, preset, 8).select(F.lit(preset).alias("preset"), "place", "ticker")
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def summary_headline(spark, sf):
    """TOP15."""
    return corpus.headline(_ticker_summary(spark, sf))


@query
def summary_chips(spark, sf):
    """SC25, FLT14."""
    s = _ticker_summary(spark, sf).withColumn("trend_reliability", F.when(F.col("total_mentions") >= 20, "High"))
    return corpus.with_chips(s, ("VI1", "ER3")).select("ticker", "chips", "watched")


def _grid(spark, sf) -> DataFrame:
    return stats.pearson_grid(stats.long_pairs(_dataset(spark, sf), [], GRID_SIGNALS, GRID_OUTCOMES))


@query
def strongest_relationships(spark, sf):
    """TOP8."""
    return stats.strongest(_grid(spark, sf))


@query
def correlation_heatmap(spark, sf):
    """FLT7: the strongest positive cells of raw returns for the signals of attention."""
    return stats.heatmap(_grid(spark, sf), "positive", min_r=0.01, min_n=10, kind="raw", group="Attention").select("signal", "outcome", "correlation")


@query
def raw_or_abnormal(spark, sf):
    """JN21, ST14."""
    return stats.raw_or_abnormal(_grid(spark, sf), "raw_return_5d", "abnormal_return_5d")


@query
def abnormal_reading(spark, sf):
    """ST14."""
    return stats.abnormal_reading(stats.raw_or_abnormal(_grid(spark, sf), "raw_return_5d", "abnormal_return_5d"))


@query
def rolling_reading(spark, sf):
    """ST15."""
    return stats.rolling_reading(_rolling(spark, sf), ["bucket_start", "ticker"])


@query
def trend_lines(spark, sf):
    """ST18."""
    return stats.trend_lines(stats.long_pairs(_dataset(spark, sf), [], GRID_SIGNALS, GRID_OUTCOMES))


@query
def box_quartiles(spark, sf):
    """AGG25."""
    return stats.quartiles(_dataset(spark, sf), ["mentions", "average_hype_score", "raw_return_5d"])


@query
def evidence_labels(spark, sf):
    """SC21: what each cell's p-value says."""
    return _grid(spark, sf).select("signal", "outcome", S.evidence(F.col("p_value")).alias("evidence"))


@query
def coercions(spark, sf):
    """SC5, NUM4, DT4: loose values of orders."""
    o = A.table(spark, sf, "orders").withColumn("loose", F.substring("o_orderpriority", 1, 1))
    at = S.lenient_time(F.when(F.col("o_orderkey") % 3 == 0, F.lit("no day")).otherwise(F.substring(F.col("o_orderdate").cast("string"), 1, 10)))
    given = F.when(F.col("o_orderstatus") == "P", "none").when(F.col("o_orderstatus") == "F", F.concat("loose", F.lit(".7"))).otherwise(F.concat("loose", F.lit("7")))
    return o.select("o_orderkey", S.coerce_bool(F.col("loose")).alias("flag"), S.coerce_score(given, F.lit(4).cast("long")).alias("score"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query
def date_bounds(spark, sf):
    """FLT5."""
    return history.date_bounds(A.mentions(spark, sf), "created_date", "Last 7 days", ["ticker"])


@query
def run_windows(spark, sf):
    """FLT6."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return history.run_windows(A.runs(spark, sf)).select("analysis_run_id", text("window_start"), text("window_end"))


@query
def run_labels(spark, sf):
    """PRJ4: of five sources three are named."""
    names = A.table(spark, sf, "region").select(F.col("r_regionkey").cast("int").alias("source_id"), F.lower("r_name").alias("source_name")).filter("source_id < 3")
    return history.run_labels(A.runs(spark, sf), names)


@query
def run_timeline(spark, sf):
    """TOP13."""
    return history.timeline(A.runs(spark, sf))


@query
def quality_columns(spark, sf):
    """JN6."""
    quality = A.classifications(spark, sf).groupBy("item_id").agg(F.min("classifier_mode").alias("classifier_mode"))
    return history.with_quality(A.mentions(spark, sf), quality).select("item_id", "ticker", "classifier_mode", "trust_status")


@query
def top_posts(spark, sf):
    """TOP16."""
    return signals.top_evidence(A.mentions(spark, sf), 8).select("ticker", "item_id", "place")


@query
def market_freshness(spark, sf):
    """SC24: by ticker, as of the end of January."""
    out = prices.calendar_returns(A.signal_events(spark, sf), A.bars(spark, sf), "signal_id", "signal_day", (7,))
    per = out.groupBy("ticker").agg(F.max(F.when(F.col("return_7d").isNotNull(), F.col("signal_day"))).cast("timestamp").alias("latest"), F.bool_or(F.col("return_7d").isNull()).alias("missing"))
    return per.select("ticker", S.market_freshness(F.col("latest"), F.col("missing"), F.lit("2024-01-26").cast("timestamp")).alias("status"))


@query
def feed_window(spark, sf):
    """SRC1-4, SRC9: what requests of two weeks would show: 40 posts of each source, 3 comments of each thread, each item once."""
    kind = F.when(F.col("source_name") == "s4", "thread_url").otherwise("subreddit")
    items = A.mentions(spark, sf).select(F.concat_ws("|", "thread_id", "author_hash").alias("item_id"), "source_name", "thread_id", "item_type", "created_time", kind.alias("source_type"))
    return feeds.collect(items, "2024-01-05", "2024-01-19", 40, 3).select("item_id", "source_name", "item_type", F.date_format("created_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created"))


@query
def matched_sources(spark, sf):
    """SRC10: a thread's own source wins over its community's."""
    m = A.mentions(spark, sf).select("item_id", "thread_id", "subreddit")
    threads = m.select("thread_id").distinct().filter("cast(thread_id AS long) % 10 = 0").select(F.lit("thread_url").alias("source_type"), F.col("thread_id").alias("normalized_value"), (F.col("thread_id").cast("long") + 1000).alias("source_id"))
    names = m.select("subreddit").distinct().filter("subreddit <> 'r2'").select(F.lit("subreddit").alias("source_type"), F.col("subreddit").alias("normalized_value"), F.substring("subreddit", 2, 9).cast("long").alias("source_id"))
    return feeds.matched_source(m, threads.unionByName(names)).select("item_id", "source_id")


@query
def catalog_symbols(spark, sf):
    """SRC12: the market symbols of a catalog."""
    return feeds.universe(A.entity_catalog(spark, sf).select(F.upper("ticker").alias("ticker")))


@query
def catalog_clashes(spark, sf):
    """AGG20: aliases of several tickers."""
    listed = F.filter(F.transform(F.split("aliases", r"\|"), lambda a: F.lower(F.trim(a))), lambda a: a != "")
    return feeds.duplicate_aliases(A.entity_catalog(spark, sf).select(F.upper("ticker").alias("ticker"), listed.alias("aliases")))


@query
def pair_merge(spark, sf):
    """SET8, ARR7: two words of a document thrice as tickers, with a company for some."""
    w = F.col("w")
    c = A.table(spark, sf, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0)).alias("w")).filter("size(w) >= 6")
    found = mentions.pairs(F.array(w[0], F.concat(F.lit(" "), F.lower(w[1])), F.lit(" "), F.upper(w[0]), w[1]), F.array(F.when(F.col("doc_id") % 3 == 0, w[2]), F.lit(" "), w[3], w[4], F.when(F.col("doc_id") % 2 == 0, w[5]).otherwise("")))
    return c.select("doc_id", F.array_join(F.transform(found, lambda p: F.concat_ws("=", p["ticker"], p["company_name"])), "|").alias("pairs"))


@query
def source_inputs(spark, sf):
    """STR9, STR11, STR12: what users type as sources and authors."""
    p = A.table(spark, sf, "pages")
    typed = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://x.example/r/Topic_"), F.col("page_id").cast("string"), F.lit("/comments/ab"), F.col("page_id").cast("string"), F.lit("/t")))
    typed = typed.when(F.col("page_id") % 4 == 1, F.concat(F.lit(" r/Topic"), F.col("page_id").cast("string"))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("Topic"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    name = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" /u/n"), F.col("page_id").cast("string"))).when(F.col("page_id") % 3 == 1, " ").otherwise(F.concat(F.lit("u/n"), F.col("page_id").cast("string")))
    return p.select("page_id", T.source_kind(typed).alias("kind"), T.community(F.trim(typed)).alias("community"), T.thread_id(typed).alias("thread"), T.author(name).alias("author"))


@query
def deeper_analysis(spark, sf):
    """DF4, FLT11: the deeper view of the documents that are worth it."""
    quality = F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), (F.col("item_id") % 3 + 1).cast("int"))
    summary = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("summary "), F.col("item_id").cast("string"))).otherwise("")
    c = A.items(spark, sf).withColumns({"depth_score": F.col("item_id") % 11, "evidence_quality": quality, "needs_deeper_analysis": F.col("item_id") % 13 == 0, "summary": summary})
    d = classify.deeper(c.filter(classify.eligible_for_deeper(c))).select("item_id", "deeper_analysis.*")
    return d.select("item_id", "stronger_summary", *(F.array_join(x, "|").alias(x) for x in ("key_claims", "possible_catalysts", "possible_risks")))


@query
def conformed_items(spark, sf):
    """PRJ2, SRC8, DT1: rows with loose types, absent columns and blank ids."""
    d = A.table(spark, sf, "documents")
    at = F.when(F.col("doc_id") % 4 == 0, "soon").otherwise(F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T05:06:07Z")))
    score = F.when(F.col("doc_id") % 5 == 0, "many").otherwise((F.col("doc_id") % 90).cast("string"))
    rows = d.select(F.when(F.col("doc_id") % 9 == 0, " ").otherwise(F.col("doc_id").cast("string")).alias("item_id"), F.col("source").alias("source_name"), score.alias("score"), at.alias("created_time"), F.lit(1).alias("unknown"))
    out = conform_items(rows)
    return out.select("item_id", "source_name", "score", "item_type", "body_text", "comment_depth", "author", F.date_format("created_time", "yyyy-MM-dd HH:mm:ss").alias("created"), F.lit(len(out.columns)).alias("columns"))


@query
def insert_missing(spark, sf):
    """SET7, SNK4: frozen orders stay as they are, new ones are added."""
    o = A.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    frozen = o.join(A.table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    return storage.insert_missing(frozen, o.withColumn("o_totalprice", F.col("o_totalprice") * 2), ["o_orderkey"])


@query
def json_rows(spark, sf):
    """SNK10: rows as JSON lines with explicit nulls."""
    o = A.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("status"), F.array("o_orderpriority").alias("tags"))
    return o.select("o_orderkey", J.encoded(o).alias("line"))


@query
def correlation_fetch_plan(spark, sf):
    """SRC18: bars that the correlation dataset needs, with the benchmark's."""
    e = A.signal_events(spark, sf).select("ticker", "signal_day")
    every = e.unionByName(e.withColumn("ticker", F.lit("SPY")))
    return prices.fetch_plan(every, "signal_day", 20, 55)
