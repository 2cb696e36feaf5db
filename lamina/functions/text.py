"""Text rows for COPY ... FROM stdin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.model import RuleError


def escaped(value: Column) -> Column:
    """One field: backslash, line feed, carriage return and tab escaped; null is \\N."""
    v = F.replace(value.cast("string"), F.lit("\\"), F.lit("\\\\"))
    for raw, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        v = F.replace(v, F.lit(raw), F.lit(name))
    return F.coalesce(v, F.lit("\\N"))


def copy_rows(df: DataFrame, drop_binary: bool = False) -> DataFrame:
    """One column `line`: the row's fields joined by tabs. Binary columns are an error, or null with drop_binary."""
    fields = []
    for f in df.schema:
        if isinstance(f.dataType, T.BinaryType):
            if not drop_binary:
                raise RuleError("WRITE_BINARY_UNSUPPORTED", f"column {f.name} is binary")
            fields.append(F.lit("\\N"))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            fields.append(escaped(F.to_json(F.col(f"`{f.name}`"))))
        else:
            fields.append(escaped(F.col(f"`{f.name}`")))
    return df.select(F.concat_ws("\t", *fields).alias("line"))
