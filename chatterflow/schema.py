"""Additive schema conformance: missing columns get typed defaults, known ones their type (PRJ2, SRC8, §1.4)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(),
    "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()),
}


def _struct(fields: str) -> T.StructType:
    """A schema from ``name type, ...``, without a session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in fields.split(", "))])


#: Raw posts and comments.
ITEM = _struct(
    "item_id string, source_id long, source_type string, source_name string, subreddit string, thread_id string, thread_title string, thread_url string, "
    "comment_id string, parent_id string, item_type string, body_text string, author string, author_hash string, score long, created_time timestamp, "
    "permalink string, comment_depth int"
)
ITEM_DEFAULTS: dict[str, Any] = {"source_type": "", "source_name": "", "subreddit": "", "thread_id": "", "thread_title": "", "item_type": "post", "body_text": "", "score": 0, "comment_depth": 0}
#: Daily bars.
PRICE = _struct("ticker string, date date, open double, high double, low double, close double, adjusted_close double, volume double, data_source string, price_available boolean")
#: What a classifier answers.
CLASSIFICATION = _struct(
    "sentiment string, confidence double, tickers array<string>, company_names array<string>, summary string, bull_case string, bear_case string, evidence_quality string, "
    "depth_score int, hype_score int, claim_specificity_score int, repetition_score int, needs_deeper_analysis boolean, red_flags array<string>, claims_to_verify array<string>"
)


def conform(df: DataFrame, schema: T.StructType, defaults: dict[str, Any] | None = None) -> DataFrame:
    """Exactly the schema's columns, cast, with defaults for missing columns and nulls."""
    defaults = defaults or {}
    columns = []
    for f in schema.fields:
        c = F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        columns.append(c.alias(f.name))
    return df.select(*columns)


def conform_items(df: DataFrame) -> DataFrame:
    """Items without an id are rejected."""
    return conform(df, ITEM, ITEM_DEFAULTS).filter(F.trim("item_id") != "")
