"""Exact and estimated extraction plans, their guard, and the comparison with what a run did."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.model import Catalog, PlanMode, RuleError, RuleSet
from lamina.operators.extract import Extraction
from lamina.sources.scan import Source


@dataclass(frozen=True)
class PlannedTable:
    table: str
    direct: int
    fk_parents: int
    fk_children: int
    origin: str

    @property
    def total(self) -> int:
        """-1 if any part is unknown."""
        parts = (self.direct, self.fk_parents, self.fk_children)
        return -1 if min(parts) < 0 else sum(parts)


@dataclass(frozen=True)
class Plan:
    mode: PlanMode
    tables: tuple[PlannedTable, ...]
    notes: tuple[str, ...] = ()

    @property
    def total(self) -> int:
        return sum(max(0, t.total) for t in self.tables)


def _split(origin: str, n: int) -> tuple[int, int, int]:
    return (n, 0, 0) if origin == "direct" else (0, 0, n) if "fk-child" in origin else (0, n, 0)


def table_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """(table, n) of all frames in one job."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), "n") for t, df in frames.items()])


def exact_plan(source: Source, catalog: Catalog, rules: RuleSet, extraction: Extraction | None = None) -> Plan:
    """Counts of the subset itself, so plan and run cannot differ; only keys are read and no row is built.

    A table reached as a child and as a parent counts once, under fk-child; a configured one under direct with what its filter gives.
    """
    extraction = extraction or Extraction(source, catalog, rules)
    frames = extraction.frames()
    seeds = {t: source.scan(t, r.filter) for t, r in extraction.reach.items() if r.seed and r.keys is not None}
    got = {r.table: r.n for r in table_counts(frames).collect()}
    direct = {r.table: r.n for r in table_counts(seeds).collect()} if seeds else {}
    out = []
    for t in frames:
        r, n = extraction.reach[t], got[t]
        if r.seed:
            seed = direct.get(t, n)
            children = n - seed if "fk-child" in r.origins else 0
            out.append(PlannedTable(t, seed, n - seed - children, children, "direct"))
        else:
            d, p, c = _split(r.label(), n)
            out.append(PlannedTable(t, d, p, c, r.label()))
    return Plan(PlanMode.EXACT, tuple(out))


def estimated_plan(source: Source, catalog: Catalog, rules: RuleSet) -> Plan:
    """Whole-table statistics along all foreign keys from the seeds: an upper bound that ignores filters (noted)."""
    counts = source.row_counts()
    origin = {t: "direct" for t in rules.filters()}
    notes = [f"filter of {t} is ignored by an estimate" for t, f in rules.filters().items() if f]
    edge = list(origin)
    while edge:
        children = [fk.from_table for t in edge for fk in catalog.referencing(t)]
        edge = list(dict.fromkeys(c for c in children if c not in origin))
        origin.update({c: "fk-child" for c in edge})
    edge = list(origin)
    while edge:
        parents = [fk.to_table for t in edge if t in catalog.tables for fk in catalog.table(t).foreign_keys]
        edge = list(dict.fromkeys(p for p in parents if p not in origin and p in catalog.tables))
        origin.update({p: "fk-parent" for p in edge})
    return Plan(PlanMode.ESTIMATE, tuple(PlannedTable(t, *_split(o, counts.get(t, -1)), o) for t, o in origin.items()), tuple(notes))


def guard(plan: Plan, most_rows: int) -> None:
    """Refuse a plan beyond most_rows before anything is extracted; 0 is no limit."""
    if most_rows > 0 and plan.total > most_rows:
        raise RuleError("PLAN_MAX_TARGET_ROWS", f"{plan.total} rows planned, {most_rows} allowed")


def compare(planned: DataFrame, actual: DataFrame) -> DataFrame:
    """(table, planned, actual, delta_percent) over the tables of both sides; planned and actual are (table, n).

    The delta is (actual - planned) / planned * 100; 0 where nothing or something unknown (negative) was planned.
    """
    p, a = planned.select("table", F.col("n").alias("planned")), actual.select("table", F.col("n").alias("actual"))
    both = p.join(a, "table", "full_outer").select("table", F.coalesce("planned", F.lit(0)).cast("long").alias("planned"), F.coalesce("actual", F.lit(0)).cast("long").alias("actual"))
    return both.withColumn("delta_percent", F.when(F.col("planned") > 0, (F.col("actual") - F.col("planned")) / F.col("planned") * 100).otherwise(F.lit(0.0)))


@dataclass
class TableOutcome:
    """What a run did with one table."""

    table: str
    extracted: int = 0
    fk_parents: int = 0
    fk_children: int = 0
    inserted: int = 0
    conflicts: int = 0
    batch_errors: int = 0

    @property
    def rows(self) -> int:
        return self.extracted + self.fk_parents + self.fk_children


@dataclass
class Outcome:
    tables: list[TableOutcome] = field(default_factory=list)
    strategies: dict[tuple[str, str, str], int] = field(default_factory=dict)
    seconds: float = 0.0

    def total(self, name: str) -> int:
        return sum(getattr(t, name) for t in self.tables)

    @property
    def warnings(self) -> bool:
        return self.total("conflicts") > 0 or self.total("batch_errors") > 0

    @property
    def covered_columns(self) -> int:
        return len({(t, c) for t, c, _ in self.strategies})

    @property
    def throughput(self) -> float | None:
        """Rows written a second; unknown below one second."""
        return self.total("inserted") / self.seconds if self.seconds >= 1 else None


@dataclass(frozen=True)
class Insight:
    level: str  # OK, WARN, ERROR
    subject: str
    text: str


def insights(plan: Plan, outcome: Outcome, catalog: Catalog | None = None, personal: int = 0) -> list[Insight]:
    """What the difference between plan and outcome says, by table and over all."""
    planned = {t.table: t.total for t in plan.tables}
    found, exact = [], 0
    for t in outcome.tables:
        p = planned.get(t.table, 0)
        delta = (t.rows - p) / p * 100 if p > 0 else 0.0
        exact += abs(delta) <= 1 and t.conflicts == 0
        asked = sorted({f"{fk.from_table}.{fk.from_columns[0]}" for fk in catalog.referencing(t.table) if fk.from_table != t.table}) if catalog else []
        by = f", asked for by {', '.join(asked)}" if asked else ""
        if delta > 1:
            found.append(Insight("WARN", t.table, f"{t.rows - p} rows more than planned" + (f" ({t.fk_parents} by foreign keys)" if t.fk_parents else "") + by))
        if delta < -1:
            found.append(Insight("WARN", t.table, f"{p - t.rows} rows fewer than planned"))
        if t.table not in planned and t.rows:
            found.append(Insight("WARN", t.table, f"not planned: {t.rows} rows came by foreign keys{by}"))
        if t.fk_parents and abs(delta) <= 1:
            found.append(Insight("OK", t.table, f"{t.fk_parents} parent rows came by foreign keys"))
        if t.conflicts:
            found.append(Insight("WARN", t.table, f"{t.conflicts} rows were in the target already"))
        if t.batch_errors:
            found.append(Insight("ERROR", t.table, f"{t.batch_errors} rows refused"))
    found.append(Insight("OK", "all", f"{exact} of {len(outcome.tables)} tables as planned"))
    if outcome.total("fk_parents"):
        found.append(Insight("OK", "all", f"{outcome.total('fk_parents')} parent rows came by foreign keys"))
    rows, inserted = outcome.total("rows"), outcome.total("inserted")
    if rows:
        lost = rows - inserted
        found.append(Insight("WARN" if lost else "OK", "all", f"{lost} of {rows} rows not written ({round(lost * 100 / rows)} %)" if lost else f"all {rows} rows written"))
    if not outcome.total("conflicts"):
        found.append(Insight("OK", "all", "no conflicts"))
    if not outcome.total("batch_errors"):
        found.append(Insight("OK", "all", "no refused rows"))
    if personal:
        found.append(Insight("WARN", "all", f"{personal} columns look personal and have no rule"))
    return found


def delta_text(delta: float) -> str:
    """0%, +0%/-0% for less than half a percent, else a signed whole number."""
    if delta == 0:
        return "0%"
    return f"{'+' if delta > 0 else '-'}{abs(round(delta))}%"


def matches(delta: float, conflicts: int) -> bool:
    return conflicts == 0 and abs(delta) <= 1.0
