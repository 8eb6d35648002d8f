"""Temperature mixing of sources to target weights, in DataFrame functions only.

A source's weight is its share of the tokens to the power of an exponent between 1 (as they are) and 0 (all alike),
normalised. The exponent is bisected to the largest one whose weights reach the target entropy (a share of the logarithm of
the number of sources); where that would repeat some source more often than allowed, to the smallest one that doesn't.
Each job evaluates all the points of several bisection steps at once, over the written table of sources.

The weights are realised under a token budget. A source's documents fall into blocks by hash, as many as the square root of
their number, so that neither the blocks of a source nor the documents of a block are many. Each pass over a source takes its
blocks in an order of its own; all but the last pass take every block, the last takes whole blocks until one would exceed
the source's budget, and of that one documents in hashed order. Only sums per block and the documents of one block per
source are ordered, never a source.

Null sources form a source named ''. Documents without a token are drawn in full passes and cost nothing. Rows that repeat a
doc_id are one document with their tokens together, and are drawn together. Equal shares get equal weights. A very long text
that exceeds what is left of the budget ends its pass. An empty table gives an empty result. Extra columns pass through
:func:`mixed` and are ignored elsewhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written

#: Share of the largest possible entropy to reach, most passes over a source, and the budget as a share of all tokens.
TARGET_ENTROPY, MAX_PASSES, BUDGET = 0.95, 4.0, 1.0
#: Bisection steps in one job, and jobs; together they fix the exponent to 2**-30.
STEPS, JOBS = 6, 5


def n_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` as the measure of tokens."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+")) - F.when(trimmed.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens, one row per doc_id, written."""
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), n_words(F.col("text").cast("string")).alias("n_tokens"))
    return written(rows.groupBy("doc_id").agg(F.min("source").alias("source"), F.sum("n_tokens").alias("n_tokens")))


def exponent(sources: DataFrame, budget: float, target_entropy: float = TARGET_ENTROPY, max_passes: float = MAX_PASSES) -> float:
    """The bisected exponent, given (source, n_tokens) of sources with tokens, and the budget in tokens."""
    n, total = sources.agg(F.count(F.lit(1)), F.sum("n_tokens")).first()
    if n < 2:
        return 1.0
    shares = sources.select((F.col("n_tokens") / F.lit(float(total))).alias("p"))

    def evaluate(points: list[float]) -> dict[float, tuple[float, float]]:
        """(entropy, most passes over a source) at each exponent: one row per point comes back."""
        at = shares.select("p", F.explode(F.array(*map(F.lit, points))).alias("a"))
        rows = at.groupBy("a").agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.log("p")).alias("l"), F.max(F.pow("p", F.col("a") - 1)).alias("m"))
        return {r["a"]: (math.log(r["z"]) - r["a"] * r["l"] / r["z"], budget / total * r["m"] / r["z"]) for r in rows.collect()}

    def bisect(fits_low: bool, fits) -> float:
        """The last exponent that fits, where those that do lie at the low end, or else at the high end."""
        low, high = 0.0, 1.0
        for _ in range(JOBS):
            width = (high - low) / 2**STEPS
            found = evaluate([low + width * i for i in range(1, 2**STEPS)])
            base, first, last = low, 0, 2**STEPS
            while last - first > 1:
                middle = (first + last) // 2
                first, last = (middle, last) if fits(*found[base + width * middle]) == fits_low else (first, middle)
            low, high = base + width * first, base + width * last
        return low if fits_low else high

    ends = evaluate([0.0, 1.0])
    reaches = lambda entropy, passes: entropy >= target_entropy * math.log(n)
    spares = lambda entropy, passes: passes <= max_passes
    found = 1.0 if reaches(*ends[1.0]) else bisect(True, reaches)
    if spares(*evaluate([found])[found]):
        return found
    return bisect(False, spares)


def plan(table: DataFrame, budget: float = BUDGET, target_entropy: float = TARGET_ENTROPY, max_passes: float = MAX_PASSES) -> DataFrame:
    """By source: n_docs, n_tokens, n_blocks, weight and target_tokens; written."""
    sources = written(table.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens")))
    used = sources.filter("n_tokens > 0")
    total = used.agg(F.sum("n_tokens")).first()[0] or 0
    alpha = exponent(used, budget * total, target_entropy, max_passes) if total else 1.0
    power = F.when(F.col("n_tokens") > 0, F.pow(F.col("n_tokens") / F.lit(float(max(total, 1))), F.lit(alpha))).otherwise(0.0)
    z = used.agg(F.sum(power)).first()[0] or 1.0
    weighted = sources.withColumn("exponent", F.lit(alpha)).withColumn("weight", power / F.lit(float(z)))
    return written(
        weighted.withColumn("target_tokens", F.least(F.floor(F.col("weight") * F.lit(float(budget * total))), F.floor(F.lit(float(max_passes)) * F.col("n_tokens"))))
        .withColumn("n_blocks", F.ceil(F.sqrt("n_docs")))
    )


def draws(table: DataFrame, sources: DataFrame, seed: int = 17) -> DataFrame:
    """One row for each time that a document is drawn: doc_id, source, pass, block, block_rank, n_tokens."""
    known = sources.select("source", F.col("n_tokens").alias("source_tokens"), "target_tokens", "n_blocks")
    dealt = written(
        table.join(known.select("source", "n_blocks"), "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("n_blocks"))).drop("n_blocks")
    )
    blocks = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens")).join(known.filter("source_tokens > 0"), "source")
    full = F.floor(F.col("target_tokens") / F.col("source_tokens"))
    in_pass = Window.partitionBy("source", "pass").orderBy("order", "block")
    taken = (
        blocks.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), full)))
        .withColumn("order", F.xxhash64(F.lit(seed), "source", "pass", "block"))
        .withColumn("block_rank", F.row_number().over(in_pass).cast("long"))
        .withColumn("before", F.sum("block_tokens").over(in_pass.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_tokens"))
        .withColumn("left", F.when(F.col("pass") < full, F.col("source_tokens")).otherwise(F.col("target_tokens") - full * F.col("source_tokens")) - F.col("before"))
        .filter("left > 0")
        .select("source", "block", "pass", "block_rank", (F.col("block_tokens") <= F.col("left")).alias("whole"), "left")
    )
    taken = written(taken)
    rows = dealt.join(taken, ["source", "block"])
    some = (
        rows.filter("not whole")
        .withColumn("sum", F.sum("n_tokens").over(Window.partitionBy("source", "pass").orderBy(F.xxhash64(F.lit(seed), "pass", "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
        .filter("sum <= left").drop("sum")
    )
    return rows.filter("whole").unionByName(some).select("doc_id", "source", "pass", "block", "block_rank", "n_tokens")


def mix_sources(docs: DataFrame, budget: float = BUDGET, target_entropy: float = TARGET_ENTROPY, max_passes: float = MAX_PASSES) -> DataFrame:
    table = measured(docs)
    return draws(table, plan(table, budget, target_entropy, max_passes))


def mixed(docs: DataFrame, budget: float = BUDGET, target_entropy: float = TARGET_ENTROPY, max_passes: float = MAX_PASSES) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as it is drawn.

    The draws (ids only) are the build side of a hash join, so that texts are shuffled once and never sorted.
    """
    other, times = fresh("id"), fresh("times")
    drawn = written(mix_sources(docs, budget, target_entropy, max_passes).groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")))
    drawn = drawn.select(F.col("doc_id").alias(other), F.col("times").alias(times))
    rows = docs.join(drawn.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(other)))
    return rows.withColumn(other, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)
