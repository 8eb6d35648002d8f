"""Exact dedup by heavy-hitter split, in DataFrame functions only.

One scan turns each text into the SHA-256 of its normalised form and writes the narrow (row, doc_id, digest) table. A
Misra-Gries summary (``DataFrame.freqItems``) proposes every digest that may hold more than ``support`` of the rows; it
keeps at most 1/support counters, so the candidate list is bounded whatever the input. Candidates are verified by an exact
count with map-side partial aggregation, and the verified winners (digest, first row, size) are broadcast: rows of heavy
groups are resolved where they lie and never shuffled. All other digests, each below the support by the summary's
guarantee, are grouped by an ordinary shuffle. Texts of any length are normalised and hashed where they lie.

Null text counts as the empty text and empty texts form one group. Repeated rows (same doc_id and text) are copies like any
others: exactly one row of each group stays, one with the smallest doc_id. A null doc_id sorts after all others. An empty
table gives an empty result. Extra columns pass through :func:`exact_dedup` and are ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

#: A digest holding more than this share of the rows is resolved map-side; 1 / SUPPORT bounds the broadcast.
SUPPORT = 0.001


def normalised(text: Column) -> Column:
    """Each run of white space becomes one blank; runs that are one blank already are left to stand."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame) -> DataFrame:
    """row (a tie-break), doc_id and the 32-byte digest of the normalised text."""
    digest = F.unhex(F.sha2(normalised(F.col("text").cast("string")).cast("binary"), 256))
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", digest.alias("digest"))


def _first_row() -> Column:
    """The row that stays: the smallest doc_id, nulls last, then the smallest row."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))


def heavy_digests(table: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Verified heavy groups: digest, first, group_size; at most 1/support rows."""
    names = table.select(F.hex("digest").alias("name"))  # the summary tells strings apart by value, binaries by identity
    found = names.freqItems(["name"], support).select(F.explode("name_freqItems").alias("name")).select(F.unhex("name").alias("digest")).distinct()
    exact = table.join(F.broadcast(found), "digest").groupBy("digest").agg(_first_row().alias("first"), F.count(F.lit(1)).alias("group_size"))
    return exact.filter(F.col("group_size") > max(1.0, support * table.count()))


def exact_groups(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, digest, keep_id, group_size, kept."""
    table = written(digests(docs))
    heavy = F.broadcast(written(heavy_digests(table, support)))
    light = table.join(heavy, "digest", "left_anti")
    # counts come together before the shuffle; the join that brings them back can split a group
    rest = light.join(light.groupBy("digest").agg(_first_row().alias("first"), F.count(F.lit(1)).alias("group_size")), "digest")
    return (
        table.join(heavy, "digest")
        .unionByName(rest)
        .select("doc_id", "digest", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"))
    )


def exact_dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The decisions are narrow and are joined back by doc_id: the dropped ids are the build side of a hash join, so texts are
    shuffled once at most, unsorted, and not at all where the dropped ids are few enough for Spark to broadcast.
    A doc_id with several rows is decided by (doc_id, digest), its surplus equal rows by ``dropDuplicates`` on those alone.
    """
    groups = written(exact_groups(docs, support))
    ids = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("kept").alias("kept"))
    gone = written(ids.filter((F.col("rows") > 1) | ~F.col("kept") | F.col("doc_id").isNull()).select("doc_id", "rows"))
    other, of_text, of_kept = fresh("id"), fresh("digest"), fresh("digest")
    here = F.col("doc_id").eqNullSafe(F.col(other))
    simple = docs.join(gone.select(F.col("doc_id").alias(other)).hint("shuffle_hash"), here, "left_anti")
    several = gone.filter((F.col("rows") > 1) | F.col("doc_id").isNull()).select(F.col("doc_id").alias(other))
    if several.isEmpty():
        return simple
    digest = F.unhex(F.sha2(normalised(F.col("text").cast("string")).cast("binary"), 256))
    tagged = docs.join(several, here, "left_semi").withColumn(of_text, digest)
    stay = groups.filter("kept").select(F.col("doc_id").alias(other), F.col("digest").alias(of_kept))
    rest = tagged.join(stay, here & (F.col(of_text) == F.col(of_kept)), "left_semi").dropDuplicates(["doc_id", of_text]).drop(of_text)
    return simple.unionByName(rest)
