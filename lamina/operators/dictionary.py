"""Consistency across tables: semantic keys, and statistics of the values behind them.

Fakes are stateless, so no dictionary is kept; its entry counts are still a useful guardrail.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.model import RuleError, RuleSet, SemanticType, Strategy

MOST_ENTRIES = 1_000_000


def semantic_key(rules: RuleSet, table: str, column: str) -> str:
    """The first linked_columns entry that names the column, else table.column."""
    return next((x.semantic_key for x in rules.linked if (table, column) in x.columns), f"{table}.{column}")


def entries(frames: dict[str, DataFrame], rules: RuleSet) -> DataFrame:
    """(semantic_key, entries): distinct lowered values behind each key of a FAKE rule."""
    parts = []
    for r in rules.rules:
        if r.strategy == Strategy.FAKE and r.type != SemanticType.JSONB and r.table in frames:
            v = F.lower(F.col(r.column).cast("string"))
            parts.append(frames[r.table].select(F.lit(semantic_key(rules, r.table, r.column)).alias("semantic_key"), v.alias("v")).where("v is not null"))
    if not parts:
        any_frame = next(iter(frames.values()))
        return any_frame.sparkSession.createDataFrame([], "semantic_key string, entries long")
    return reduce(DataFrame.unionByName, parts).distinct().groupBy("semantic_key").agg(F.count("*").alias("entries"))


def top_contributors(counts: DataFrame, n: int = 10) -> DataFrame:
    return counts.orderBy(F.desc("entries"), "semantic_key").limit(n)


def usage(counts: DataFrame, most: int = MOST_ENTRIES) -> dict:
    total = counts.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]
    return {"entries": total, "limit": most, "percent": 100.0 * total / most}


def check_entries(counts: DataFrame, most: int = MOST_ENTRIES) -> None:
    """Fail beyond `most` entries, naming the largest contributors."""
    if (found := usage(counts, most)["entries"]) > most:
        top = ", ".join(f"{r.semantic_key}={r.entries}" for r in top_contributors(counts, 3).collect())
        raise RuleError("ANON_DICTIONARY_OVERFLOW", f"{found} entries exceed {most}; largest: {top}")
