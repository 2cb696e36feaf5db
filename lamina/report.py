"""Reports as text, JSON, Markdown and HTML, from small results on the driver."""

from __future__ import annotations

import html
import json
from dataclasses import asdict

from lamina.operators.kanon import AuditReport
from lamina.plans.planner import Insight, Outcome, Plan, delta_text, matches


def _grid(head: list[str], rows: list[list]) -> str:
    cells = [[str(c) for c in r] for r in [head, *rows]]
    width = [max(len(r[i]) for r in cells) for i in range(len(head))]
    line = lambda r: "  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip()
    return "\n".join([line(cells[0]), "  ".join("-" * w for w in width), *map(line, cells[1:])])


def _plan_rows(plan: Plan) -> list[list]:
    show = lambda n: "unknown" if n < 0 else n
    return [[t.table, show(t.direct), show(t.fk_children), show(t.fk_parents), show(t.total), t.origin] for t in plan.tables]


PLAN_HEAD = ["table", "direct", "children", "parents", "total", "origin"]
RUN_HEAD = ["table", "planned", "actual", "delta", "written", "conflicts", "errors", "ok"]


def _run_rows(plan: Plan, outcome: Outcome) -> list[list]:
    planned = {t.table: max(0, t.total) for t in plan.tables}
    actual = {t.table: t for t in outcome.tables}
    rows = []
    for name in dict.fromkeys([*planned, *actual]):
        p, t = planned.get(name, 0), actual.get(name)
        n = t.rows if t else 0
        delta = (n - p) / p * 100 if p else 0.0
        rows.append([name, p, n, delta_text(delta), t.inserted if t else 0, t.conflicts if t else 0, t.batch_errors if t else 0, "yes" if matches(delta, t.conflicts if t else 0) else "no"])
    return rows


def plan_text(plan: Plan) -> str:
    return "\n".join([f"Plan ({plan.mode.name}): {plan.total} rows", _grid(PLAN_HEAD, _plan_rows(plan)), *plan.notes]) + "\n"


def run_text(plan: Plan, outcome: Outcome, found: list[Insight]) -> str:
    speed = f"{outcome.throughput:.0f} rows/s" if outcome.throughput else "n/a"
    head = f"Run: {outcome.total('inserted')} of {outcome.total('rows')} rows written, {outcome.covered_columns} columns covered, {speed}"
    return "\n".join([head, _grid(RUN_HEAD, _run_rows(plan, outcome)), *(f"{i.level} {i.subject}: {i.text}" for i in found)]) + "\n"


def run_json(plan: Plan, outcome: Outcome | None = None, found: list[Insight] = ()) -> str:
    out = {"plan": {"mode": plan.mode.name, "total": plan.total, "tables": [asdict(t) | {"total": t.total} for t in plan.tables], "notes": list(plan.notes)}}
    if outcome:
        names = ("rows", "inserted", "conflicts", "batch_errors")
        out["run"] = {"tables": [asdict(t) | {"rows": t.rows} for t in outcome.tables], "totals": {n: outcome.total(n) for n in names}, "warnings": outcome.warnings, "seconds": round(outcome.seconds, 3), "strategies": [[*k, n] for k, n in sorted(outcome.strategies.items())]}
        out["insights"] = [asdict(i) for i in found]
    return json.dumps(out, ensure_ascii=False)


def run_html(plan: Plan, outcome: Outcome | None = None, found: list[Insight] = ()) -> str:
    def grid(head: list[str], rows: list[list]) -> str:
        row = lambda r, tag: "<tr>" + "".join(f"<{tag}>{html.escape(str(c))}</{tag}>" for c in r) + "</tr>"
        return "<table>" + row(head, "th") + "".join(row(r, "td") for r in rows) + "</table>"

    body = f"<h1>Plan</h1>{grid(PLAN_HEAD, _plan_rows(plan))}"
    if outcome:
        body += f"<h1>Run</h1>{grid(RUN_HEAD, _run_rows(plan, outcome))}<ul>" + "".join(f"<li class='{i.level}'>{html.escape(f'{i.subject}: {i.text}')}</li>" for i in found) + "</ul>"
    return f"<!doctype html><html><head><meta charset='utf-8'><title>Report</title></head><body>{body}</body></html>\n"


AUDIT_HEAD = ["table", "columns", "rows", "classes", "k=1", "2-4", "5-9", "10-99", ">=100", "k min", "k mean", "severity"]


def _audit_rows(report: AuditReport) -> list[list]:
    names = ("total_rows", "total_classes", "singletons", "k2to4", "k5to9", "k10to99", "k100plus", "k_min")
    return [[t.table, ",".join(t.columns), *(t.distribution[n] for n in names), f"{t.distribution['k_average']:.2f}", t.severity] for t in report.tables]


def _verdict(report: AuditReport) -> str:
    policy = "no policy" if report.strict_k is None else f"policy k>={report.strict_k} " + ("violated" if report.violated else "held")
    note = "" if report.sample_rate >= 1 else f"; from a sample of {report.sample_rate:g} of the rows, so approximate"
    return f"overall k min {report.overall_k_min}, {policy}{note}"


def audit_text(report: AuditReport) -> str:
    return "\n".join([f"Anonymity: {_verdict(report)}", _grid(AUDIT_HEAD, _audit_rows(report)), *(f"{t.severity}: {t.advice}" for t in report.tables)]) + "\n"


def audit_markdown(report: AuditReport) -> str:
    bar = lambda r: "| " + " | ".join(map(str, r)) + " |"
    out = ["# Anonymity", "", _verdict(report), "", bar(AUDIT_HEAD), bar(["---"] * len(AUDIT_HEAD)), *map(bar, _audit_rows(report)), ""]
    for t in report.tables:
        out += [f"- **{t.severity}** {t.advice}"] + [f"  - {', '.join(v)}" for v in t.singletons]
    return "\n".join(out) + "\n"


def audit_json(report: AuditReport) -> str:
    return json.dumps(report.as_dict(), ensure_ascii=False)
