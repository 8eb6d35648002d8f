"""Polls since the last run (§2.13, FLT10, SNK1): what has landed is taken once, and a batch that comes again changes nothing.

A poll is a stream with ``Trigger.AvailableNow``: it reads what its checkpoint hasn't seen, and ends. Each micro-batch is written
as a delta of its own, named by the batch's id, and then entered in a ledger; only deltas in the ledger are read. A run that
dies in between leaves a delta without an entry, and the same batch under the same id overwrites it; one that dies after
the entry finds it and skips. So no upsert is lost or made twice, without a rewrite of the table. Compaction folds deltas into one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class UpsertTable:
    """A table of deltas below ``path``: of equal keys the row of the last batch counts, in it the greatest of ``order``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: str):
        self.spark, self.path, self.schema, self.keys, self.order = spark, path.rstrip("/"), schema, keys, order

    def _entries(self, rows: list[tuple[int, int]]) -> DataFrame:
        return self.spark.createDataFrame(rows, "batch long, upto long")

    def ledger(self) -> DataFrame:
        """batch, and for a compacted delta ``upto``, the last batch that it holds."""
        if not self._exists("ledger"):
            return self._entries([])
        return self.spark.read.schema("upto long, batch long").parquet(f"{self.path}/ledger")

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def has(self, batch: int) -> bool:
        return not self.ledger().filter((F.col("batch") == batch) | (F.col("upto") >= batch)).isEmpty()

    def write(self, rows: DataFrame, batch: int) -> None:
        """The delta alone; it counts once it is entered."""
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")

    def enter(self, batch: int, upto: int = -1) -> None:
        self._entries([(batch, upto)]).select("upto").write.mode("overwrite").parquet(f"{self.path}/ledger/batch={batch}")

    def upsert(self, rows: DataFrame, batch: int) -> None:
        """For ``foreachBatch``."""
        if not self.has(batch):
            self.write(rows, batch)
            self.enter(batch)

    def versions(self) -> DataFrame:
        """All rows of the deltas that count, with their batch."""
        entries = self.ledger().collect()  # a row for each poll since the last compaction
        folded = max((r["upto"] for r in entries), default=-1)
        live = [r["batch"] for r in entries if r["upto"] == folded >= 0 or (r["upto"] < 0 and r["batch"] > folded)]
        schema = T.StructType([*self.schema, T.StructField("batch", T.LongType())])
        if not live:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/deltas/batch={b}" for b in live]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/deltas").parquet(*paths)

    def read(self) -> DataFrame:
        """The table as of the last entered batch; partial aggregation keeps keys with many versions cheap."""
        rest = [c for c in self.schema.names if c not in self.keys]
        newest = F.max_by(F.struct(*rest), F.struct("batch", self.order)).alias("_r")
        return self.versions().groupBy(*self.keys).agg(newest).select(*self.keys, "_r.*").select(*self.schema.names)

    def compact(self) -> None:
        """One delta in place of all that count. It is named by a number below all batches, and entered last."""
        entries = self.ledger().collect()
        upto = max((max(r["batch"], r["upto"]) for r in entries), default=-1)
        if upto >= 0:
            name = min(-2, min(r["batch"] for r in entries) - 1)
            self.write(self.read(), name)
            self.enter(name, upto)


def poll(items: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Give everything that has landed since the last poll to ``sink``, and end. ``items``: a stream."""
    items.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
