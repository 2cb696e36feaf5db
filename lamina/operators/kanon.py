"""k-anonymity: equivalence classes of quasi-identifiers, their size distribution, and what follows from it."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.config import closest
from lamina.model import Catalog, RuleError, RuleSet
from lamina.operators.detect import NEUTRAL_AFTER_RUN, quasi_identifiers

SAMPLE, ACADEMIC = 20, 5


def sampled(df: DataFrame, rate: float = 1.0, seed: int = 0) -> DataFrame:
    """Bernoulli sample by row; a rate outside (0, 1] counts as 1."""
    return df.sample(fraction=rate, seed=seed) if 0 < rate < 1 else df


def classes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Size k of each class; nulls are a value."""
    return df.groupBy(*columns).agg(F.count("*").alias("k"))


def distribution(sizes: DataFrame) -> DataFrame:
    """One row: total_classes, total_rows, singletons, k2to4, k5to9, k10to99, k100plus, k_min (-1 if empty), k_average (0 if empty).

    Sizes are aggregated a second time; they never reach the driver.
    """
    between = lambda low, high: F.count_if(F.col("k").between(low, high))
    return sizes.agg(
        F.count("*").alias("total_classes"),
        F.coalesce(F.sum("k"), F.lit(0)).alias("total_rows"),
        between(1, 1).alias("singletons"),
        between(2, 4).alias("k2to4"),
        between(5, 9).alias("k5to9"),
        between(10, 99).alias("k10to99"),
        F.count_if(F.col("k") >= 100).alias("k100plus"),
        F.coalesce(F.min("k"), F.lit(-1)).alias("k_min"),
        F.coalesce(F.avg("k"), F.lit(0.0)).alias("k_average"),
    )


def singleton_sample(sizes: DataFrame, columns: list[str], n: int = SAMPLE) -> DataFrame:
    """The first n classes of one row, in order of their values; null is spelled NULL."""
    picked = sizes.where("k = 1").orderBy(*(F.col(c).asc_nulls_first() for c in columns)).limit(n)
    return picked.select(*(F.coalesce(F.col(c).cast("string"), F.lit("NULL")).alias(c) for c in columns))


def suppressed(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Rows whose class has at least k members (an extension for publishing): classes are counted by aggregation, so a large one is no single task."""
    names = [f"_class{i}" for i in range(len(columns))]
    large = classes(df, columns).where(F.col("k") >= k).select(*columns).toDF(*names)
    same = reduce(Column.__and__, [df[c].eqNullSafe(large[n]) for c, n in zip(columns, names)])
    return df.join(large, same, "left_semi")


def recommendation(table: str, columns: list[str], d: dict) -> tuple[str, str]:
    """(severity, text) for a table's distribution."""
    if not d["total_classes"]:
        return "INFO", f"{table} is empty: nothing to audit"
    if d["singletons"]:
        return "CRITICAL", f"{d['singletons']} row(s) of {table} stand alone by ({', '.join(columns)}): generalise a column or suppress them"
    if d["k_min"] < ACADEMIC:
        return "WARNING", f"smallest class of {table} has k={d['k_min']}, below {ACADEMIC}"
    return "INFO", f"{table} has k={d['k_min']} or more and no singletons"


@dataclass
class TableAudit:
    table: str
    columns: list[str]
    distribution: dict
    singletons: list[list[str]]
    severity: str
    advice: str


@dataclass
class AuditReport:
    tables: list[TableAudit] = field(default_factory=list)
    sample_rate: float = 1.0
    strict_k: int | None = None

    @property
    def overall_k_min(self) -> int:
        """Least k over tables with rows; -1 if there are none."""
        return min((t.distribution["k_min"] for t in self.tables if t.distribution["total_classes"]), default=-1)

    @property
    def violated(self) -> bool:
        return self.strict_k is not None and (self.overall_k_min < 0 or self.overall_k_min < self.strict_k)

    @property
    def exit_code(self) -> int:
        return 8 if self.violated else 0

    def as_dict(self) -> dict:
        return {"tables": [asdict(t) for t in self.tables], "overall_k_min": self.overall_k_min, "sample_rate": self.sample_rate, "strict_k": self.strict_k, "violated": self.violated}


def parse_quasi_id(text: str) -> tuple[str, list[str]]:
    """table:c1,c2 as its parts."""
    table, colon, columns = text.partition(":")
    names = [c.strip() for c in columns.split(",") if c.strip()]
    if not (table.strip() and colon and names):
        raise RuleError("AUDIT_QUASI_ID_SYNTAX", f"'{text}' is not table:column[,column]")
    return table.strip(), names


def resolve_quasi_ids(catalog: Catalog, rules: RuleSet, explicit: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Quasi-identifiers by table: an explicit list wins and must exist; else those detected and not hidden."""
    if explicit:
        for table, columns in explicit.items():
            if table not in catalog.tables:
                raise RuleError("AUDIT_UNKNOWN_TABLE", f"unknown table '{table}'; did you mean '{closest(table, catalog.tables)}'?")
            names = [c.name for c in catalog.table(table).columns]
            for c in columns:
                if c not in names:
                    raise RuleError("AUDIT_UNKNOWN_COLUMN", f"unknown column '{table}.{c}'; did you mean '{closest(c, names)}'?")
        return explicit
    out: dict[str, list[str]] = {}
    for f in quasi_identifiers(catalog, rules, neutral=NEUTRAL_AFTER_RUN):
        out.setdefault(f.table, []).append(f.column)
    return out


def audit(frames: dict[str, DataFrame], quasi: dict[str, list[str]], sample_rate: float = 1.0, strict_k: int | None = None) -> AuditReport:
    """Audit each table: one grouping, read twice (distribution, singletons)."""
    report = AuditReport(sample_rate=sample_rate, strict_k=strict_k)
    for table, columns in quasi.items():
        sizes = classes(sampled(frames[table], sample_rate), columns)
        d = distribution(sizes).first().asDict()
        alone = [list(r) for r in singleton_sample(sizes, columns).collect()] if d["singletons"] else []
        report.tables.append(TableAudit(table, columns, d, alone, *recommendation(table, columns, d)))
    return report
