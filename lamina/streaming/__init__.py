"""The same projection over unbounded inputs (an extension: the transforms keep no state)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.model import RuleSet, Secrets
from lamina.operators.pseudonymize import pseudonymized


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    """A watermark on time; a timestamp without a zone is read in the session's."""
    if stream.schema[time].dataType.typeName() == "timestamp_ntz":
        stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    return stream.withWatermark(time, late)


def pseudonymized_stream(stream: DataFrame, table: str, rules: RuleSet, secrets: Secrets, key: list[str] | None = None, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rules applied to a stream; with key and time each key passes once within the watermark (its state is bounded by `late`)."""
    if key and time:
        stream = _timed(stream, time, late).dropDuplicatesWithinWatermark(key)
    return pseudonymized(stream, table, rules, secrets)


def windowed_counts(stream: DataFrame, time: str, width: str = "1 hour", late: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows in each tumbling window (and group), final once the watermark passes it."""
    return _timed(stream, time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))
