"""JSON columns of tables at rest: decoded to VARIANT, kept as text where they don't parse, and back (SRC14, ARR3, SNK13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strict(text: Column) -> Column:
    """The VARIANT of a text that is one JSON value and nothing more, else null.

    The parser stops behind the first value, so the text is parsed within an array and within an object: what follows the value
    breaks one of them, or is a second element.
    """
    array, object_ = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    alone = object_.isNotNull() & F.try_variant_get(array, "$[1]", "variant").isNull()
    return F.when(alone, F.try_variant_get(array, "$[0]", "variant"))


def decoded(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Each named column as a VARIANT; ``columns`` says what a null stands for ([] or {}).

    Text that isn't JSON is kept: the VARIANT is the text itself, as a string.
    """
    for c, empty in columns.items():
        text = F.coalesce(F.col(c), F.lit(empty))
        df = df.withColumn(c, F.coalesce(strict(text), text.cast("variant")))
    return df


def value(column: Column, path: str, kind: str) -> Column:
    """What stands at a path, cast, or null."""
    return F.try_variant_get(column, path, kind)


def encoded(df: DataFrame) -> Column:
    """The row as JSON text: NaN and infinities as null, VARIANTs as what they hold, nulls kept."""
    plain = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType | T.FloatType):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        plain.append(c.alias(f.name))
    return F.to_json(F.struct(*plain), {"ignoreNullFields": "false"})
