import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from texts, or (text, lang, source) triples; ids count from 0."""

    def make(rows, first=0):
        full = [(i + first, *((r, "en", "s") if not isinstance(r, tuple) else r)) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in full], DOC)

    return make


@pytest.fixture
def odd(docs):
    """Nulls, empty and long texts, repeated rows, and extra columns with names that operators use themselves."""
    texts = [(None, None, None), ("", "en", "s"), (" \t\n", "en", "s"), ("one", "en", None), ("word " * 30_000, "en", "s"), ("12 34 !!", "fr", "s"), ("l'été été", "fr", "t")]
    base = docs(texts)
    rows = base.unionByName(base)
    for name in ("row", "digest", "kept", "doc", "label", "bucket", "rank", "length", "block", "times", "blob", "piece", "_digest", "again_id", "stay_id", "_drawn", "_times", "_gone", "listed", "minor", "toxic"):
        rows = rows.withColumn(name, F.lit("x"))
    return rows
