"""Frozen signal events: gates, evidence, random benchmarks, review (DF7, DF10, TOP4, TOP9, TOP11-12, FLT8, JN7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import scores as S
from ..functions import text as T
from ..sources.storage import written
from . import prices as P
from .ranges import numbered, running


def candidates(summary: DataFrame, run: str = "analysis_run_id", gates: dict = lex.GATES, manual: tuple[str, ...] = (), frozen: DataFrame | None = None) -> DataFrame:
    """DF7: rank within the run and the two gates. ``summary`` has coverage_reliability, trend_reliability and model_mentions.

    ``manual``: tickers asked for by hand pass without the gates; ``frozen``: (run, ticker) pairs that have an event already.
    """
    rank = F.row_number().over(Window.partitionBy(run).orderBy(F.desc("emerging_ticker_score"), F.desc("average_alpha_signal_score"), "ticker"))
    out = summary.withColumn("signal_rank", rank.cast("long"))
    score = (F.col("signal_rank") <= gates["top_rank"]) | (F.col("emerging_ticker_score") >= gates["emerging"]) | (F.col("acceleration_score") >= gates["acceleration"])
    quality = (
        (F.col("coverage_reliability") >= gates["coverage"]) & F.col("trend_reliability").isin("Medium", "High") & (F.col("total_mentions") >= gates["mentions"])
        & (F.col("unique_authors") >= gates["authors"]) & (F.col("unique_threads") >= gates["threads"]) & (F.col("model_mentions") >= 1)
    )
    strength = S.signal_strength(F.col("emerging_ticker_score"), F.col("acceleration_score"), F.col("average_alpha_signal_score"), F.col("average_hype_score"))
    out = out.withColumns({"score_gate": score, "quality_gate": quality, "strength": strength, "manual": F.col("ticker").isin(*manual)})
    out = out.withColumn("freezes", (F.col("manual") | (F.col("score_gate") & F.col("quality_gate"))) & ~F.col("ticker").isin("", "UNKNOWN"))
    if frozen is None:
        return out
    there = frozen.select(run, "ticker").distinct().withColumn("_there", F.lit(True))
    return out.join(there, [run, "ticker"], "left").withColumn("freezes", F.col("freezes") & F.col("_there").isNull()).drop("_there")


def top_evidence(mentions: DataFrame, n: int = 3) -> DataFrame:
    """TOP4."""
    order = (F.desc_nulls_last("alpha_signal_score"), F.desc_nulls_last("confidence"), F.desc_nulls_last("created_time"), "item_id")
    best = mentions.withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy(*order)).cast("long")).filter(F.col("place") <= n)
    return best.withColumn("excerpt", T.excerpt(F.col("body_text"))) if "body_text" in mentions.columns else best


#: Tickers of a block of the catalog, and pairs of an event and a ticker that a block of events has with it.
TICKERS, PAIRS = 4096, 1 << 18


def drawn_benchmark(events: DataFrame, universe: DataFrame, n: int = lex.GATES["benchmark_sample"]) -> DataFrame:
    """TOP11: for each event the ``n`` other tickers with the smallest SHA-1 of (signal_id, ticker), a fixed random draw of its own.

    Every event is hashed with every ticker of the catalog. Both are dealt into blocks; a block of events meets a block of the
    catalog, which is one array, by equality, and an event keeps its ``n`` smallest of it. Where the catalog has several
    blocks, an event's smallest of each are merged. sample_index counts them from 1 in the order of the hashes.
    """
    tickers = written(universe.select("ticker").filter("ticker <> ''").distinct())
    drawing = written(events.select("signal_id", "ticker").distinct())
    size = tickers.count()
    parts = max(-(-size // TICKERS), 1)
    chunks = max(-(-drawing.count() * min(size, TICKERS) // PAIRS), 1)
    catalog = tickers.groupBy(F.pmod(F.xxhash64("ticker"), F.lit(parts)).alias("_of")).agg(F.collect_list("ticker").alias("_all"))
    each = lambda k: F.explode(F.expr(f"sequence(0L, {k - 1}L)"))
    catalog = catalog.withColumn("_chunk", each(chunks))
    dealt = drawing.withColumn("_chunk", F.pmod(F.xxhash64("signal_id", "ticker"), F.lit(chunks))).withColumn("_of", each(parts))
    # more than 10,000 partitions help nobody; blocks share them then
    met = dealt.repartition(min(chunks * parts, 10_000), "_chunk", "_of").join(catalog, ["_chunk", "_of"])
    others = F.filter("_all", lambda t: t != F.coalesce("ticker", F.lit("")))
    first = lambda hashed: F.slice(F.sort_array(hashed), 1, n)
    sample = met.select("signal_id", "ticker", first(F.transform(others, lambda t: F.struct(F.sha1(F.concat("signal_id", t)).alias("h"), t.alias("t")))).alias("_met"))
    if parts > 1:
        sample = sample.groupBy("signal_id", "ticker").agg(first(F.flatten(F.collect_list("_met"))).alias("_met"))
    return sample.select("signal_id", "ticker", F.posexplode("_met").alias("_i", "_b")).select("signal_id", "ticker", F.col("_b.t").alias("benchmark_ticker"), (F.col("_i") + 1).cast("long").alias("sample_index"))


def random_benchmark(events: DataFrame, universe: DataFrame, n: int = lex.GATES["benchmark_sample"]) -> DataFrame:
    """For each event ``n`` other tickers, an arc of one ring: sample_index counts them from 1. Neighbours on the ring are drawn
    together by all events, so it is less than :func:`drawn_benchmark`; outcomes (DF10) are looked up for it.

    The catalog is a ring, in the order of the tickers' SHA-1. An event enters it at the SHA-1 of its id and takes the tickers
    that follow, passing over its own. Both are sorted together once; then an event meets n + 1 places of the ring by
    equality, so the work is that of events x n, whatever the size of the catalog.
    """
    tickers = universe.select("ticker").filter("ticker <> ''").distinct()
    ring = written(numbered(tickers.withColumn("_h", F.sha1("ticker")), [], ["_h", "ticker"], "_at"))
    size = ring.count()
    at = events.select("signal_id", "ticker").withColumns({"_h": F.sha1("signal_id"), "_mark": F.lit(0)})
    both = at.unionByName(ring.select("_h", F.lit(1).alias("_mark")), allowMissingColumns=True)
    entered = running(both, [], ["_h", "_mark", "signal_id"], {"_before": ("sum", "_mark")}).filter("_mark = 0")
    places = entered.select("signal_id", "ticker", "_before", F.explode(F.sequence(F.lit(0), F.lit(min(n, size - 1)))).alias("_step")) if size else entered.select("signal_id", "ticker", "_before", F.lit(0).alias("_step"))
    met = places.withColumn("_at", F.pmod(F.col("_before") + F.col("_step"), F.lit(max(size, 1))) + 1).join(ring.select("_at", F.col("ticker").alias("_other")), "_at")
    # n + 1 tickers at most
    sample = met.groupBy("signal_id", "ticker").agg(F.collect_list(F.struct("_step", "_other")).alias("_met"))
    own = F.filter(F.array_sort("_met"), lambda x: x["_other"] != F.coalesce("ticker", F.lit("")))
    return sample.select("signal_id", "ticker", F.posexplode(F.slice(own, 1, n)).alias("_i", "_b")).select("signal_id", "ticker", F.col("_b._other").alias("benchmark_ticker"), (F.col("_i") + 1).cast("long").alias("sample_index"))


def benchmark_means(sample: DataFrame, returns: DataFrame, columns: list[str]) -> DataFrame:
    """AGG8, DF10: mean outcome of each event's sample."""
    keys = [k for k in ("signal_id", "benchmark_ticker") if k in ("benchmark_ticker", *returns.columns)]
    met = sample.join(returns.withColumnRenamed("ticker", "benchmark_ticker"), keys)
    return met.groupBy("signal_id").agg(F.countDistinct("benchmark_ticker").alias("benchmark_count"), *(F.round(F.avg(c), 6).alias(f"benchmark_{c}") for c in columns))


def benchmark_outcomes(events: DataFrame, prices: DataFrame, n: int = lex.GATES["benchmark_sample"]) -> DataFrame:
    """DF10: what the market did for each of an event's random benchmark tickers from the event's day on.

    Outcomes depend on (ticker, day) alone, so each such pair meets the bars once, however many events share it.
    """
    sample = written(random_benchmark(events, prices, n).join(events.select("signal_id", "signal_day"), "signal_id"))
    days = written(sample.select(F.col("benchmark_ticker").alias("ticker"), "signal_day").distinct())
    facts = P.day_outcomes(days, prices, "signal_day", (7, 30), (7,), (7, 30)).withColumnRenamed("ticker", "benchmark_ticker")
    return sample.drop("ticker").join(facts, ["benchmark_ticker", "signal_day"], "left")


def random_means(outcomes: DataFrame) -> DataFrame:
    """AGG8: by event the number of benchmark tickers, their mean returns and volume spike."""
    columns = ("return_7d", "return_30d", "volume_spike_7d")
    return outcomes.groupBy("signal_id").agg(F.countDistinct("benchmark_ticker").alias("random_sample_size"), *(F.round(F.avg(c), 6).alias(f"random_mean_{c}") for c in columns))


def recent_events(events: DataFrame, n: int = 8) -> DataFrame:
    """TOP12."""
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("signal_time"), F.desc("signal_id"))).cast("long")
    return events.withColumn("back", rank).filter(F.col("back") <= n)


#: Labels that call a signal useful.
USEFUL = ("Useful lead", "Worth deeper research", "Avoided hype trap")


def review_kpis(review: DataFrame) -> DataFrame:
    """AGG16: signals, those labelled and called useful, and average outcomes, in one row."""
    label = F.coalesce("label", F.lit(""))
    return review.agg(
        F.count(F.lit(1)).alias("signals"), F.count_if(label != "").alias("labelled"), F.count_if(label.isin(*USEFUL)).alias("useful"),
        F.count("return_7d").alias("with_return"), F.round(F.avg("return_7d"), 6).alias("average_return_7d"), F.round(F.avg("spread_14d"), 4).alias("average_spread_14d"),
    )


def inbox(review: DataFrame, label: str | None = None, ticker: str = "", manual: bool | None = None, reliability: str | None = None, sort: str = "newest") -> DataFrame:
    """FLT8, TOP9: filters of the signal inbox and its order: unlabelled first, then as ``sort`` names, nulls last, newest first."""
    own = F.coalesce("label", F.lit(""))
    tests = [own == label] * (label is not None) + [F.col("ticker").contains(ticker.strip().upper())] * bool(ticker.strip())
    tests += [F.coalesce("manual", F.lit(False)) == manual] * (manual is not None) + [F.col("attention_reliability") == reliability] * (reliability is not None)
    for test in tests:
        review = review.filter(test)
    orders = {
        "newest": [], "emerging": [F.desc_nulls_last("strength")], "attention": [F.desc_nulls_last("spread_14d")], "excess": [F.desc_nulls_last("return_7d")], "hype": [F.asc_nulls_last("hype_score")],
    }
    return review.orderBy(F.desc(own == ""), *orders[sort], F.desc_nulls_last("signal_time"), "signal_id")


def review(events: DataFrame, labels: DataFrame, market: DataFrame, attention_: DataFrame, benchmark: DataFrame) -> DataFrame:
    """JN7: an event with its label and all outcomes; each right side has one row per event."""
    out = events
    for part in (labels, market, attention_, benchmark):
        clash = [c for c in part.columns if c in out.columns and c != "signal_id"]
        out = out.join(part.drop(*clash), "signal_id", "left")
    return out


def validation_status(events: DataFrame, labels: DataFrame) -> DataFrame:
    """AGG15."""
    marked = events.join(labels, "signal_id", "left")
    open_ = F.bool_or(F.col("label").isNull() | (F.col("label") == "unlabeled"))
    return marked.groupBy("ticker").agg(F.when(open_, "Needs validation").otherwise("Validated").alias("status"), F.count(F.lit(1)).alias("signals"))
