"""A run: rules, plan, guard, extraction, pseudonymization, sink, outcome."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lamina.config import check_against, check_guardrails, check_secrets, check_structure
from lamina.model import Catalog, PlanMode, RuleError, RuleSet, Secrets
from lamina.operators.dictionary import check_entries, entries
from lamina.operators.extract import Extraction
from lamina.operators.pseudonymize import pseudonymized, used_strategies
from lamina.operators.rules import propagate
from lamina.plans.planner import Outcome, Plan, TableOutcome, estimated_plan, exact_plan, guard
from lamina.sources.scan import Source
from lamina.sources.sinks import Checkpoint, Sink, Tolerance, tolerant_write


def compiled(rules: RuleSet, catalog: Catalog, secrets: Secrets, strict: bool = False) -> tuple[RuleSet, list[str]]:
    """Checked rules with what foreign keys add, and notes on suspect ones."""
    check_secrets(secrets)
    check_structure(rules)
    check_against(rules, catalog, strict)  # names first: unknown ones would be ignored further on
    rules = propagate(rules, catalog)
    return rules, check_against(rules, catalog, strict)


def planned(source: Source, catalog: Catalog, rules: RuleSet, mode: PlanMode = PlanMode.EXACT, most_rows: int = 0, extraction: Extraction | None = None) -> Plan:
    plan = exact_plan(source, catalog, rules, extraction) if mode == PlanMode.EXACT else estimated_plan(source, catalog, rules)
    guard(plan, most_rows)
    return plan


@contextmanager
def bounded(spark: SparkSession, seconds: float | None, code: str, what: str) -> Iterator[None]:
    """Cancel the Spark jobs of the block once it has taken too long, and say so with the given code; no limit without seconds."""
    if not seconds:
        yield
        return
    tag, late = f"lamina-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        yield
    except Exception as e:
        if late.is_set():
            raise RuleError(code, f"{what} took more than {seconds:g} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)
    if late.is_set():
        raise RuleError(code, f"{what} took more than {seconds:g} s")


def execute(
    source: Source,
    catalog: Catalog,
    rules: RuleSet,
    secrets: Secrets,
    sink: Sink,
    plan: Plan | None = None,
    checkpoint: Checkpoint | None = None,
    extraction: Extraction | None = None,
    tolerance: Tolerance | None = None,
    most_entries: int = 0,
    table_seconds: float | None = None,
) -> Outcome:
    """Write the pseudonymized subset, parents first; tables that the checkpoint has are skipped whole.

    Within a table rows are ordered at the sink only where its format has an order. Counts come from the write itself. With a tolerance, rows that
    its check refuses are left out and counted, up to its rate. most_entries limits the distinct values behind FAKE rules (0: no limit), table_seconds
    the time of one table. Key tables that an extraction of this run's own has written go at its end.
    """
    began = time.monotonic()
    own = extraction is None
    extraction = extraction or Extraction(source, catalog, rules)
    if tolerance:
        check_guardrails(tolerance.most_rate)
    if most_entries:
        check_entries(entries(extraction.frames(), rules), most_entries)
    parts = {t.table: t for t in plan.tables} if plan else {}
    used = used_strategies(rules)
    outcome = Outcome()
    sink.open(catalog)
    try:
        for table in extraction.tables():
            if checkpoint and checkpoint.finished(table):
                continue
            rows_of = pseudonymized(extraction.rows(table), table, rules, secrets)
            with bounded(source.spark, table_seconds, "TIMEOUT_TABLE", table):
                n, conflicts, refused = tolerant_write(sink, catalog.table(table), rows_of, tolerance) if tolerance else (*sink.write(table, rows_of), 0)
            p = parts.get(table)
            rows = n + conflicts + refused
            parents, children = (max(0, p.fk_parents), max(0, p.fk_children)) if p and p.total >= 0 else (0, 0) if extraction.reach[table].seed else (rows, 0)
            outcome.tables.append(TableOutcome(table, max(0, rows - parents - children), parents, children, n, conflicts, refused))
            outcome.strategies |= {u: n for u in used if u[0] == table}
            if checkpoint:
                checkpoint.finish(table)
    finally:
        sink.close()
        if own:
            extraction.release()
    if checkpoint:
        checkpoint.clear()
    outcome.seconds = time.monotonic() - began
    return outcome


def shared_values(left, right):
    """(n_union, n_common): distinct values of two one-column frames - a check that linked columns agree."""
    values = left.toDF("v").distinct().withColumn("l", F.lit(1)).join(right.toDF("v").distinct().withColumn("r", F.lit(1)), "v", "full_outer")
    return values.agg(F.count("*").alias("n_union"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_common"))
