"""Running values over range-sorted rows: sums, least and last values, and ranks, in two levels.

Rows are dealt by ranges of (keys, order), so a key with half of the rows, or a day with all of them, is spread over as many
tasks as its rows fill. Each range is a block with a window of its own; what a key carries from its earlier blocks is one row
for each key and block, which a second, small window adds up. Nothing else is ordered or held.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written

#: What a running value may be: how a block computes it, and how it meets what earlier blocks carry.
KINDS = ("sum", "min", "last")


def placed(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The rows, written in the order of keys and ``order``; ``_row`` numbers them, ``_part`` is their block's number."""
    by = [*keys, *order]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id())
    return written(rows).withColumn("_part", F.shiftright("_row", 33))  # what stands above a partition's own numbers


def running(df: DataFrame, keys: list[str], order: list[Column | str], values: dict[str, tuple[str, str]], before: bool = False, arranged: bool = False) -> DataFrame:
    """Adds running values within ``keys`` in the order of ``order``: {new column: (sum, min or last, column)}.

    Nulls are passed over; a sum of nothing is 0, the others null. ``before`` leaves out the row itself. Rows of equal keys and
    order stand in any order, so callers name what tells them apart. ``arranged``: ``df`` comes from :func:`placed`.
    """
    rows = df if arranged else placed(df, keys, order)
    inside = Window.partitionBy("_part", *keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    own, whole, carried, out = {}, [], [], {}
    for i, (name, (kind, c)) in enumerate(values.items()):
        col = F.col(c)
        if kind == "sum":
            own[f"_i{i}"], total, up = F.sum(col).over(inside), F.sum(col), F.sum(f"_w{i}").over(earlier)
            both = F.coalesce(f"_i{i}", F.lit(0)) + F.coalesce(f"_c{i}", F.lit(0))
        elif kind == "min":
            own[f"_i{i}"], total, up, both = F.min(col).over(inside), F.min(col), F.min(f"_w{i}").over(earlier), F.least(f"_i{i}", f"_c{i}")
        else:
            own[f"_i{i}"], total = F.last(col, ignorenulls=True).over(inside), F.max_by(col, F.when(col.isNotNull(), F.col("_row")))
            up, both = F.last(f"_w{i}", ignorenulls=True).over(earlier), F.coalesce(f"_i{i}", f"_c{i}")
        whole.append(total.alias(f"_w{i}"))
        carried.append(up.alias(f"_c{i}"))
        out[name] = both
    # a row for each key and block
    blocks = rows.groupBy("_part", *keys).agg(*whole)
    blocks = blocks.select(F.col("_part").alias("_of"), *(F.col(k).alias(f"_k_{k}") for k in keys), *carried)
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_k_{k}")), keys, F.col("_part") == F.col("_of"))
    met = rows.withColumns(own).join(blocks, same, "left").withColumns(out)
    return met.drop("_of", *(f"_k_{k}" for k in keys), *own, *(f"_c{i}" for i in range(len(values))), "_row", "_part")


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    """Adds the place of each row within its keys, from 1."""
    return running(df.withColumn("_1", F.lit(1).cast("long")), keys, order, {name: ("sum", "_1")}).drop("_1")


def average_ranks(values: DataFrame, keys: list[str], value: str, weight: str, name: str) -> DataFrame:
    """WIN17: the average rank of each distinct value within its keys, from its number of rows in ``weight``."""
    summed = running(values, keys, [value], {"_upto": ("sum", weight)})
    return summed.withColumn(name, F.col("_upto") - F.col(weight) + (F.col(weight) + 1) / 2).drop("_upto")
