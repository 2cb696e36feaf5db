"""Command line: plan, execute, dry-run, audit, diag, preflight."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

import yaml
from pyspark.sql import SparkSession

from lamina.config import check_against, check_output_path, load_rules
from lamina.functions.crypto import REDACTION
from lamina.model import ForeignKey, PlanMode, RuleError, RuleSet, Secrets
from lamina.operators.detect import personal_columns, quasi_identifiers
from lamina.operators.kanon import audit, parse_quasi_id, resolve_quasi_ids
from lamina.plans.planner import insights
from lamina.preflight import failed, lines, preflight
from lamina.report import audit_json, audit_markdown, audit_text, plan_text, run_html, run_json, run_text
from lamina.run import bounded, compiled, execute, planned
from lamina.sources.scan import Source, fingerprint, introspect
from lamina.sources.sinks import Checkpoint, Tolerance, make_sink, read_state, write_state

#: Exit codes by the beginning of an error's code (the first that fits), and for an audit's policy, an interruption and anything else.
EXITS = {"PLAN_MAX_TARGET_ROWS": 3, "CONNECTION": 2, "SCHEMA": 4, "CATALOG": 4, "WRITE": 5, "SINK": 5, "ANON": 6, "TIMEOUT": 7}
REFUSED, VIOLATED, FAILED, INTERRUPTED = 1, 8, 127, 130


def exit_code(error: RuleError) -> int:
    """The code of an error's family; configuration, checkpoint and audit errors are the rest."""
    return next((n for start, n in EXITS.items() if error.code.startswith(start)), REFUSED)


def session(name: str = "lamina") -> SparkSession:
    """A session with adaptive execution and with keys hidden in plans and event logs."""
    return SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.redaction.string.regex", REDACTION).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def load_schema(spark: SparkSession, path: str, data: str, fetch_size: int = 1000, partitions: int = 16, **options):
    """Source and catalog from a YAML file: tables: {name: {key: [..], foreign: [{columns, table, to}], types: {column: type}, split: column}}, schema: name.

    data is a folder of Parquet tables or a JDBC URL; split names the numeric column by whose ranges a database table is read.
    """
    whole = yaml.safe_load(Path(path).read_text("utf-8"))
    raw = whole["tables"]
    if data.startswith("jdbc:"):
        try:
            source = Source.jdbc(spark, data, whole.get("schema") or "", list(raw), fetch_size, {n: t["split"] for n, t in raw.items() if (t or {}).get("split")}, partitions, **options)
        except RuleError:
            raise
        except Exception as e:  # a driver or a database that is not there
            raise RuleError("CONNECTION_SOURCE_FAILED", str(e).splitlines()[0]) from e
    else:
        source = Source.parquet(spark, data, list(raw))
    foreign = [ForeignKey(n, tuple(f["columns"]), f["table"], tuple(f["to"])) for n, t in raw.items() for f in (t or {}).get("foreign", [])]
    types = {(n, c): k for n, t in raw.items() for c, k in ((t or {}).get("types") or {}).items()}
    return source, introspect(source, {n: (t or {}).get("key", []) for n, t in raw.items()}, foreign, types)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lamina")
    p.add_argument("command", choices=["plan", "execute", "dry-run", "audit", "diag", "preflight"])
    p.add_argument("--schema", required=True, help="YAML file of tables and keys")
    p.add_argument("--data", required=True, help="folder of name.parquet tables, or a JDBC URL")
    p.add_argument("--config", help="YAML rule file")
    p.add_argument("--mode", choices=["EXACT", "ESTIMATE"], default="EXACT")
    p.add_argument("--sink", choices=["PARQUET", "DUMP", "JDBC", "NULL"], default="PARQUET")
    p.add_argument("--target-url", help="JDBC URL to write to")
    p.add_argument("--target-schema", default="")
    p.add_argument("--partitions", type=int, default=16, help="cursors on a split database table")
    p.add_argument("--max-error-rate", type=float, help="share of refused rows that a run stands; unset: rows are not checked")
    p.add_argument("--rejects", help="folder for refused rows below the working directory")
    p.add_argument("--max-entries", type=int, default=0, help="distinct values behind FAKE rules; 0: no limit")
    p.add_argument("--timeout", type=float, help="seconds for the run")
    p.add_argument("--table-timeout", type=float, help="seconds for one table")
    p.add_argument("--out", help="folder or dump file below the working directory")
    p.add_argument("--compression", default="GZIP")
    p.add_argument("--max-rows", type=int, default=0)
    p.add_argument("--strict", action="store_true")
    p.add_argument("--resume", action="store_true")
    p.add_argument("--checkpoint", help="manifest of finished tables")
    p.add_argument("--state", help="column strategies, written by execute and read by audit")
    p.add_argument("--html")
    p.add_argument("--format", choices=["text", "json", "markdown"], default="text")
    p.add_argument("--quasi-id", action="append", default=[], metavar="TABLE:C1,C2")
    p.add_argument("--sample-rate", type=float, default=1.0)
    p.add_argument("--k-min", type=int)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return _run(a, spark or session())
    except RuleError as e:
        code = exit_code(e)
        print(json.dumps({"error": {"code": e.code, "message": str(e)}, "exitCode": code}) if a.format == "json" else e, file=sys.stderr)
        return code
    except KeyboardInterrupt:
        return INTERRUPTED
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return FAILED


def _run(a: argparse.Namespace, spark: SparkSession) -> int:
    with bounded(spark, a.timeout, "TIMEOUT_RUN", "the run"):
        return _command(a, spark)


def _target(a: argparse.Namespace) -> dict:
    """The sink's options from the arguments."""
    if a.command == "dry-run" or a.sink == "NULL":
        return {}
    if a.sink == "JDBC":
        if not a.target_url:
            raise RuleError("CONFIG_SINK_URL", "a JDBC sink needs --target-url")
        return {"url": a.target_url, "schema": a.target_schema}
    out = str(check_output_path(a.out, "out"))
    return {"path": out, "compression": a.compression} if a.sink == "DUMP" else {"folder": out}


def _command(a: argparse.Namespace, spark: SparkSession) -> int:
    rules = load_rules(a.config) if a.config else RuleSet()
    source, catalog = load_schema(spark, a.schema, a.data, rules.fetch_size, a.partitions)
    if a.command == "diag":
        counts = source.row_counts()
        print("\n".join(f"{t}: {counts[t]} rows, key {','.join(catalog.table(t).primary_key) or 'none'}" for t in catalog.tables))
        print(f"schema {fingerprint(catalog)}")
        return 0
    if a.command == "audit":
        kept = read_state(a.state) if a.state else {}
        check_against(rules, catalog)
        quasi = resolve_quasi_ids(catalog, rules, dict(map(parse_quasi_id, a.quasi_id)))
        quasi = {t: [c for c in cs if a.quasi_id or kept.get((t, c)) not in ("FAKE", "NULLIFY", "MASK", "FPE_ID", "FPE_UUID")] for t, cs in quasi.items()}
        report = audit(source.frames, {t: cs for t, cs in quasi.items() if cs}, a.sample_rate, a.k_min)
        print({"text": audit_text, "json": audit_json, "markdown": audit_markdown}[a.format](report))
        return report.exit_code
    secrets = Secrets(os.environ.get("LAMINA_HMAC_SECRET", ""), os.environ.get("LAMINA_FPE_KEY", ""), locale=os.environ.get("LAMINA_LOCALE", "en"))
    if a.command == "preflight":
        found = preflight(source, catalog, rules, secrets, a.strict, a.max_error_rate or 0.0, lambda: str(_target(a).keys()) if a.out or a.target_url else None)
        print("\n".join(lines(found)))
        return REFUSED if failed(found) else 0
    rules, notes = compiled(rules, catalog, secrets, a.strict)
    personal, quasi = personal_columns(catalog, rules), quasi_identifiers(catalog, rules)
    plan = planned(source, catalog, rules, PlanMode[a.mode], a.max_rows)
    for n in [*notes, *(f"personal? {f.table}.{f.column} ({f.pattern})" for f in personal), *(f"quasi-identifier? {f.table}.{f.column} ({f.pattern})" for f in quasi)]:
        print(n, file=sys.stderr)
    if a.command == "plan":
        print(run_json(plan) if a.format == "json" else plan_text(plan))
        return 0
    sink = make_sink("NULL" if a.command == "dry-run" else a.sink, **_target(a))
    tolerance = None if a.max_error_rate is None else Tolerance(a.max_error_rate, str(check_output_path(a.rejects, "rejects")) if a.rejects else None)
    checkpoint = Checkpoint(a.checkpoint, Path(a.config).read_text("utf-8"), a.resume) if a.checkpoint else None
    outcome = execute(source, catalog, rules, secrets, sink, plan, checkpoint, tolerance=tolerance, most_entries=a.max_entries, table_seconds=a.table_timeout)
    found = insights(plan, outcome, catalog, len(personal))
    if a.state and a.command == "execute":
        write_state(a.state, list(outcome.strategies))
    if a.html:
        check_output_path(a.html, "html").write_text(run_html(plan, outcome, found), "utf-8")
    print(run_json(plan, outcome, found) if a.format == "json" else run_text(plan, outcome, found))
    return 0


if __name__ == "__main__":
    sys.exit(main())
