"""Merkle manifest of a dataset by checkpoint and recompute: a tree for each key, and one over the keys' roots.

Leaves are ranked within their key by one range sort. A tree is kept only at every ``STEP``-th level: each aligned block of
2**STEP nodes of a stored level is folded to its root, and only the roots are written as the next stored level, so the kept
nodes above the leaves are 1/255 of them. Proofs go down the stored levels: a block's stored nodes meet the path of their root
(a cogroup on the block), the missing interior nodes are regenerated, every node's siblings are emitted in front of that
path, and the interior is discarded. No task holds more than one block and one path, whatever a key's share of the rows, and
the driver sees the length of the longest key only. Lost executors cost a stage: every stored level is a table.

Defined results: null fields are written as ``-``, so a null and an empty text differ. Null keys come first, others by UTF-8
bytes; within a key null doc_ids come first and ties (a doc_id's several rows) follow their leaves, so that rows that repeat
entirely are interchangeable. A node without sibling has a null one in its path and is hashed alone. Texts of any length are
hashed where they lie. Other columns pass through. An empty table has no leaves, no root and no proofs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written

#: Levels between two stored ones.
STEP = 8
PATH = "array<struct<left: boolean, node: string>>"
NODES = "tree string, at long, n long, node string"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    """Lower-case hex SHA-256 of the fields behind one another."""
    return F.sha2(F.concat(*map(field, fields)).cast("binary"), 256)


def tree_of(key: Column) -> Column:
    """A name that is never null and sorts as the key does, null first."""
    return F.coalesce(F.concat(F.lit("1"), key.cast("string")), F.lit("0"))


def _parent(nodes: Sequence[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _interior(nodes: list[str], height: int) -> list[list[str]]:
    """The levels of a block from its stored nodes up to, but without, its root; the root is what the last pair makes."""
    levels = []
    for _ in range(height):
        levels.append(nodes)
        nodes = [_parent(nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return [*levels, nodes]


def _height(n: int, step: int) -> int:
    """Levels of a block in a tree with n nodes at the block's stored level: all of them where there are several blocks."""
    return min(step, (n - 1).bit_length())


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``at``, a row's place within its tree, and ``n``, the tree's size. ``nodes`` is read twice: a written table."""
    row = fresh("row")
    by = ["tree", *(F.asc_nulls_first(c) for c in order)]
    placed = written(nodes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(row, F.monotonically_increasing_id()))
    part = F.shiftright(row, 33)  # what monotonically_increasing_id has above the row's number
    runs = placed.groupBy("tree", part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"), F.min(row).alias("_first"))
    tree = Window.partitionBy("tree")  # a row for each of the range sort's partitions
    before = F.sum("_rows").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")
    runs = written(runs.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(tree).alias("n")))
    met = placed.withColumn("_part", part).join(runs, ["tree", "_part"])
    return met.withColumn("at", F.col(row) + F.col("_shift")).drop("_part", "_shift", row)


class Forest:
    """A tree for each key, kept at every ``step``-th level; ``levels[0]`` are the leaves with all their columns."""

    def __init__(self, leaves: DataFrame, order: list[str], step: int = STEP):
        """leaves: a written table with tree, node and whatever else; ``order`` ranks the leaves of a tree."""
        self.step = step
        self.levels = [ranked(leaves, order)]
        n = self.levels[0].agg(F.max("n")).first()[0] or 0
        while True:
            self.levels.append(written(self._above(self.levels[-1])))
            n = -(-n // (1 << step))
            if n <= 1:
                break

    def _above(self, level: DataFrame) -> DataFrame:
        step = self.step

        def fold(group: pa.Table) -> pa.Table:
            group = group.sort_by("at")
            n, at = group["n"][0].as_py(), group["at"][0].as_py() >> step
            root = _interior(group["node"].to_pylist(), _height(n, step))[-1][0]
            return pa.table({"tree": group["tree"][:1], "at": [at], "n": [-(-n // (1 << step))], "node": [root]})

        block = F.shiftright("at", step).alias("_block")
        return level.select("tree", "at", "n", "node").groupBy("tree", block).applyInArrow(fold, NODES)

    def roots(self) -> DataFrame:
        """tree and node, one row for each key."""
        return self.levels[-1].select("tree", "node")

    def proofs(self, above: DataFrame) -> DataFrame:
        """The leaves with ``path``, their siblings up to the top. ``above``: tree, path and more columns to pass down."""
        more = [c for c in above.columns if c not in ("tree", "path")]
        paths = above.withColumn("at", F.lit(0).cast("long"))
        for level in self.levels[-2:0:-1]:
            paths = written(self._below(level.select("tree", "at", "n", "node"), paths, more).drop("n", "node"))
        return self._below(self.levels[0], paths, more)

    def _below(self, level: DataFrame, paths: DataFrame, more: list[str]) -> DataFrame:
        """Every node of a stored level with the path of its block's root behind its own siblings."""
        step, names = self.step, level.columns
        kinds = level.schema.fields + paths.select("path", *more).schema.fields
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)

        def siblings(left: pa.Table, right: pa.Table) -> pa.Table:
            left = left.select(names).sort_by("at")
            levels = _interior(left["node"].to_pylist(), _height(left["n"][0].as_py(), step))
            rest = right["path"][0].as_py()
            found = []
            for i in range(left.num_rows):
                own = []
                for nodes in levels[:-1]:
                    other = i ^ 1
                    own.append({"left": other < i, "node": nodes[other] if other < len(nodes) else None})
                    i >>= 1
                found.append(own + rest)
            kind = pa.list_(pa.struct([("left", pa.bool_()), ("node", pa.string())]))
            left = left.append_column("path", pa.array(found, kind))
            for c in more:
                left = left.append_column(c, pa.repeat(right[c][0], left.num_rows))
            return left

        block = F.shiftright("at", step).alias("_block")
        here = level.groupBy("tree", block)
        return here.cogroup(paths.groupBy("tree", F.col("at").alias("_block"))).applyInArrow(_whole(siblings), schema)


def _whole(f):
    """Both sides have the block: every block of a level has one root in the level above, and every root is of one block."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or right.num_rows != 1:
            raise ValueError("a block without its root's path")
        return f(left, right)

    return both


def manifest(leaves: DataFrame, step: int = STEP) -> DataFrame:
    """Every leaf with its proof: doc_id, leaf, path, subroot, root and the other columns of ``leaves``.

    leaves: doc_id, key, leaf and whatever else is to pass through, but for columns that are named as those. ``path`` are the siblings from the leaf up to the root over
    all keys; ``left`` tells on which side the sibling stands.
    """
    rest = fresh("rest")  # other columns travel in one, so that their names don't matter
    others = [c for c in leaves.columns if c.lower() not in ("doc_id", "key", "leaf", "path", "subroot", "root")]
    packed = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(None).cast("int")
    table = written(leaves.select("doc_id", tree_of(F.col("key")).alias("tree"), F.col("leaf").alias("node"), packed.alias(rest)))
    forest = Forest(table, ["doc_id", "node"], step)
    subroots = forest.roots()
    top = Forest(written(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("_key"), "node")), ["_key"], step)
    # one row, the root
    root = top.roots().select("tree", F.array().cast(PATH).alias("path"), F.col("node").alias("root"))
    above = top.proofs(root).select(F.col("_key").alias("tree"), "path", F.col("node").alias("subroot"), "root")
    found = forest.proofs(written(above))
    return found.select("doc_id", F.col("node").alias("leaf"), "path", "subroot", "root", *(F.col(rest).getField(c).alias(c) for c in others))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    node = lambda acc, s: F.when(s.node.isNull(), acc).when(s.left, F.concat(s.node, acc)).otherwise(F.concat(acc, s.node))
    return F.aggregate(path, start, lambda acc, s: F.sha2(node(acc, s).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings behind one another."""
    return F.sha2(F.array_join(path.getField("node"), "").cast("binary"), 256)
