"""Tables at rest: upsert, replace by run, append, exports (SNK1-SNK13)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir.

    Where the setting is absent (tests), the context's own checkpoint folder is used, or a temporary one is set; only a
    local master can do with that, since executors elsewhere would write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="chatterflow-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it again, with known sizes for later joins."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """SNK1: ``new`` rows replace ``old`` ones of equal keys; the columns in ``keep`` stay as they were.

    ``new`` has one row per key. Old rows without a successor pass an anti join, so nothing is ordered.
    """
    if keep:
        new = new.drop(*keep).join(old.select(*keys, *keep), keys, "left")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SET7."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def latest(versions: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Of several versions of a key, the last by ``by``; partial aggregation keeps hot keys cheap."""
    rest = [c for c in versions.columns if c not in keys]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_v")).select(*keys, "_v.*")


def replace_run(rows: DataFrame, path: str, run: str = "analysis_run_id") -> None:
    """SNK2: the runs in ``rows`` are replaced as whole partitions; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    """SNK4: frozen events are only ever added."""
    rows.write.mode("append").parquet(path)


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """SNK9, SNK10: CSV with header, or JSON lines with explicit nulls. Nested columns become JSON text in CSV."""
    if kind == "json":
        df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
        return
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, limit: int = 8) -> str:
    """SNK12: a report table of a few rows."""
    rows = df.limit(limit).collect()
    lines = [" | ".join(df.columns), " | ".join("---" for _ in df.columns), *(" | ".join("" if v is None else str(v) for v in r) for r in rows)]
    return "\n".join(f"| {x} |" for x in lines)


def first_seen(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")
