"""Subset extraction: filtered seeds, their children, and the parents that keep every reference whole.

What moves between rounds are distinct key columns only. A table's rows are read at the end: through a semi join where one set of keys
says which belong, beside its filter if it has one, and through a mark for each reason where several references may, so a row
reached in several ways appears once even where the table has no key.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.model import Catalog, ChildScope, ForeignKey, RuleSet
from lamina.operators.graph import topological
from lamina.operators.rules import resolved
from lamina.sources.scan import Source, discard, semi, written


@dataclass
class Reach:
    """Why rows of a table belong: a seed filter, keys of its own, or references to a parent's keys."""

    seed: bool = False
    filter: str | None = None
    keys: DataFrame | None = None  # primary keys
    children_of: list[tuple[ForeignKey, DataFrame]] = field(default_factory=list)
    origins: list[str] = field(default_factory=list)

    def label(self) -> str:
        return "direct" if self.seed else "+".join(o for o in ("fk-child", "fk-parent") if o in self.origins)


def _marked(df: DataFrame, columns: tuple[str, ...], keys: DataFrame, mark: str) -> DataFrame:
    """df with a flag: are its columns one of the distinct keys."""
    names = [f"{mark}_{i}" for i in range(len(columns))]
    keys = keys.toDF(*names).withColumn(mark, F.lit(True))
    condition = reduce(Column.__and__, [df[c] == keys[k] for c, k in zip(columns, names)])
    return df.join(keys, condition, "left").drop(*names)


class Extraction:
    """The subset that a rule set describes, as lazy DataFrames by table."""

    def __init__(self, source: Source, catalog: Catalog, rules: RuleSet, depth: int | None = None, scope: ChildScope = ChildScope.ALL, children: bool = True, parents: bool = True):
        self.source, self.catalog = source, catalog
        rules = resolved(rules, catalog)
        self.depth, self.scope = rules.fk_depth if depth is None else depth, scope
        self.scratch: list[str] = []
        self.reach: dict[str, Reach] = {t: Reach(True, f, origins=["direct"]) for t, f in rules.filters().items()}
        if children:
            self._children()
        if parents:
            self._parents()

    # --- rows ---------------------------------------------------------------

    def rows(self, table: str) -> DataFrame:
        """Rows of the subset in one table, each once."""
        r, df = self.reach[table], self.source.frames[table]
        if r.seed and not r.filter:
            return df
        reasons = [(self.catalog.table(table).primary_key, r.keys)] if r.keys is not None else []
        reasons += [(fk.from_columns, keys) for fk, keys in r.children_of]
        seeds = self.source.scan(table, r.filter) if r.seed else None
        if not reasons:
            return df.limit(0) if seeds is None else seeds
        # rows that the filter keeps belong anyway: the keys are asked for the others only
        others = df if seeds is None else self.source.scan(table, f"not coalesce(({r.filter}), false)")
        if len(reasons) == 1:
            found = semi(others, list(reasons[0][0]), reasons[0][1])
        else:
            taken = {c.lower() for c in df.columns}
            names = [n for n in (f"_reason{i}" for i in range(len(reasons) + len(taken))) if n not in taken][: len(reasons)]
            marked = others
            for name, (columns, keys) in zip(names, reasons):
                marked = _marked(marked, columns, keys, name)
            found = marked.where(" or ".join(f"{n} is not null" for n in names)).select(*df.columns)
        return found if seeds is None else seeds.union(found)

    def keys(self, table: str) -> DataFrame:
        return self.rows(table).select(*self.catalog.table(table).primary_key)

    def tables(self) -> list[str]:
        """Reached tables, parents first."""
        order = topological(self.catalog)
        return sorted(self.reach, key=lambda t: order.index(t) if t in order else len(order))

    def frames(self) -> dict[str, DataFrame]:
        return {t: self.rows(t) for t in self.tables()}

    # --- closure ------------------------------------------------------------

    def _children(self) -> None:
        """Rows that reference a reached row, round by round; only tables with a single key lead on."""
        edge = {t: self.keys(t) for t in self.reach if self.catalog.table(t).single_key}
        seen = dict(edge)
        configured = set(self.reach)
        for level in range(self.depth):
            found: dict[str, list[DataFrame]] = {}
            for parent, keys in edge.items():
                keys = keys.distinct()
                for fk in self.catalog.referencing(parent):
                    child = fk.from_table
                    if fk.composite or fk.to_columns != self.catalog.table(parent).primary_key or child not in self.source.frames:
                        continue
                    if self.scope == ChildScope.CONFIGURED and child in configured:
                        continue
                    target = self.catalog.table(child)
                    r = self.reach.setdefault(child, Reach())
                    if "fk-child" not in r.origins:
                        r.origins.append("fk-child")
                    if target.primary_key:
                        rows = semi(self.source.frames[child], list(fk.from_columns), keys)
                        found.setdefault(child, []).append(rows.select(*target.primary_key))
                    else:
                        r.children_of.append((fk, keys))
            edge = self._grown(found, seen, level)
            if self.scope == ChildScope.CONFIGURED:
                edge = {t: k for t, k in edge.items() if t in configured}
            if not edge:
                break

    def _parents(self) -> None:
        """Rows that reached rows reference, to the whole tuple of each key, until nothing is new or the depth ends."""
        edge = {t: self.rows(t) for t in self.reach}
        seen = {t: self.keys(t) for t in self.reach if self.catalog.table(t).primary_key}
        for level in range(self.depth):
            found: dict[str, list[DataFrame]] = {}
            for child, rows in edge.items():
                asked = [fk for fk in self.catalog.table(child).foreign_keys if fk.to_table in self.source.frames and self.catalog.table(fk.to_table).primary_key]
                references = self._references(rows, sorted({fk.from_columns for fk in asked}))
                for fk in asked:
                    parent, values = self.catalog.table(fk.to_table), references[fk.from_columns]
                    if fk.to_columns == parent.primary_key:
                        keys = values.toDF(*parent.primary_key)
                    else:
                        keys = semi(self.source.frames[fk.to_table], list(fk.to_columns), values).select(*parent.primary_key)
                    found.setdefault(fk.to_table, []).append(keys)
                    r = self.reach.setdefault(fk.to_table, Reach())
                    if "fk-parent" not in r.origins:
                        r.origins.append("fk-parent")
            edge = self._grown(found, seen, level)
            edge = {t: semi(self.source.frames[t], list(self.catalog.table(t).primary_key), k) for t, k in edge.items()}
            if not edge:
                break

    def _references(self, rows: DataFrame, keys: list[tuple[str, ...]]) -> dict[tuple[str, ...], DataFrame]:
        """Distinct whole values of each key of rows; several keys are taken in one pass over the rows, and written."""
        if len(keys) < 2:
            return {k: rows.select(*k).na.drop("any").distinct() for k in keys}
        columns = list(dict.fromkeys(c for k in keys for c in k))
        plain = rows.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)))
        sets = [[plain[f"k{columns.index(c)}"] for c in k] for k in keys]
        taken = plain.groupingSets(sets, *plain.columns).agg(F.grouping_id().alias("which"))
        taken = self._written(taken.select("which", *plain.columns))
        out = {}
        for k in keys:
            own = [columns.index(c) for c in k]
            which = sum(1 << (len(columns) - 1 - i) for i in range(len(columns)) if i not in own)
            out[k] = taken.where(F.col("which") == which).select(*(F.col(f"k{i}").alias(c) for i, c in zip(own, k))).na.drop("any")
        return out

    def _written(self, df: DataFrame) -> DataFrame:
        table, path = written(df)
        self.scratch.append(path)
        return table

    def release(self) -> None:
        """Delete the key tables that were written; the extraction's frames can no longer be read."""
        for path in self.scratch:
            discard(self.source.spark, path)
        self.scratch.clear()

    def _grown(self, found: dict[str, list[DataFrame]], seen: dict[str, DataFrame], level: int) -> dict[str, DataFrame]:
        """Add newly found keys to their tables; returns them as the next round's edge. Each round's keys are written once."""
        edge = {}
        for t, parts in found.items():
            r = self.reach[t]
            if r.seed and not r.filter:
                continue  # the whole table is in already
            new = reduce(DataFrame.union, parts).distinct()
            key = list(self.catalog.table(t).primary_key)
            if t in seen:
                new = semi(new, key, seen[t], "left_anti")
            if level + 1 < self.depth:
                new = self._written(new)
                if new.isEmpty():
                    continue
            r.keys = new if r.keys is None else r.keys.union(new)
            seen[t] = new if t not in seen else seen[t].union(new)
            edge[t] = new
        return edge


def orphans(child: DataFrame, fk: ForeignKey, parent: DataFrame) -> DataFrame:
    """Rows of child whose whole reference is set but has no parent."""
    return semi(child.na.drop("any", subset=list(fk.from_columns)), list(fk.from_columns), parent.select(*fk.to_columns), "left_anti")


def hierarchy(df: DataFrame, key: str, parent: str, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, depth): keys reached upwards through a self reference from the seeds, each at its least depth, in at most depth steps."""
    edge = seeds.toDF("id").na.drop().distinct().withColumn("depth", F.lit(0))
    out = edge
    links = df.select(F.col(key).alias("_key"), F.col(parent).alias("_parent")).na.drop()
    for d in range(1, depth + 1):
        up = semi(links, ["_key"], edge.select("id")).select(F.col("_parent").alias("id")).distinct()
        edge = semi(up, ["id"], out.select("id"), "left_anti").withColumn("depth", F.lit(d))
        if d < depth:
            edge, _ = written(edge)
            if edge.isEmpty():
                break
        out = out.union(edge)
    return out
