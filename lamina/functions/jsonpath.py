"""Rewriting of JSON leaves with built-in variant expressions; untouched leaves keep their type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_MAP = "map<string,variant>"


def segments(path: str | None) -> list[str]:
    """$.a.b or a.b as its names; a blank path has none. Arrays and wildcards are not part of the grammar."""
    path = (path or "").strip()
    return [] if not path else (path[2:] if path.startswith("$.") else path).split(".")


def leaf_text(leaf: Column) -> Column:
    """A scalar leaf as text; objects and arrays as the empty text."""
    return F.when(F.schema_of_variant(leaf).rlike("^(OBJECT|ARRAY)"), F.lit("")).otherwise(F.try_variant_get(leaf, "$", "string"))


def _written_back(old: Column, new: Column, typed: bool) -> Column:
    """The new value with the old leaf's JSON type where it can be read as that, else as a string; null is JSON null."""
    null = F.parse_json(F.lit("null"))
    if typed:
        return F.when(new.isNull(), null).otherwise(new.cast("variant"))
    kind = F.schema_of_variant(old)
    whole, real, flag = new.try_cast("bigint"), new.try_cast("double"), F.when(F.lower(new).isin("true", "false"), F.lower(new) == "true")
    plain = new.rlike(r"^[+-]?[0-9]+$")
    return (
        F.when(new.isNull(), null)
        .when(kind.isin("TINYINT", "SMALLINT", "INT", "BIGINT") & plain & whole.isNotNull(), whole.cast("variant"))
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)") & real.isNotNull(), real.cast("variant"))
        .when((kind == "BOOLEAN") & flag.isNotNull(), flag.cast("variant"))
        .otherwise(new.cast("variant"))
    )


def _applied(m: Column, names: list[str], change: Callable[[Column], tuple[Column, bool]]) -> Column:
    """m with the leaf at names replaced; what is missing, JSON null or below a non-object stays as it is."""
    name, rest = names[0], names[1:]

    def entry(key: Column, x: Column) -> Column:
        if rest:
            inner = F.try_variant_get(x, "$", _MAP)
            new = F.when(inner.isNull(), x).otherwise(F.to_variant_object(_applied(inner, rest, change)))
        else:
            value, typed = change(leaf_text(x))
            new = F.when(F.is_variant_null(x), x).otherwise(_written_back(x, value, typed))
        return F.when(key == name, new).otherwise(x)

    return F.transform_values(m, entry)


def rewrite(document: Column, paths: list[tuple[str, Callable[[Column], tuple[Column, bool]]]]) -> Column:
    """A JSON text with the leaves at paths changed, one path after another; each change takes the leaf's text and gives (column, is it typed).

    Null stays null; malformed documents, roots that are no object and an empty list of paths leave the text as it is.
    A failing change fails the query.
    """
    paths = [(segments(p), change) for p, change in paths]
    paths = [(names, change) for names, change in paths if names]
    if not paths:
        return document
    text = document.cast("string")
    m = F.try_variant_get(F.try_parse_json(text), "$", _MAP)
    new = m
    for names, change in paths:
        new = _applied(new, names, change)
    return F.when(m.isNull(), text).otherwise(F.to_json(F.to_variant_object(new)))
