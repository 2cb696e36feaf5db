"""Checks before a run: each says what it looked at, whether it held, and why not."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from lamina.config import check_against, check_guardrails, check_secrets, check_structure
from lamina.model import Catalog, RuleError, RuleSet, Secrets
from lamina.operators.extract import Extraction
from lamina.operators.graph import cyclic
from lamina.operators.rules import propagate, resolved
from lamina.sources.scan import Source


@dataclass(frozen=True)
class Check:
    name: str
    status: str  # OK, WARN, FAIL, SKIP
    detail: str = ""


def _keys(source: Source, catalog: Catalog) -> str:
    for t in catalog.tables.values():
        missing = [c for c in t.primary_key if not t.column(c)]
        for fk in t.foreign_keys:
            missing += [c for c in fk.from_columns if not t.column(c)]
            if fk.to_table not in catalog.tables:
                raise RuleError("SCHEMA_FOREIGN_KEY", f"{fk} leads to an unknown table")
            missing += [f"{fk.to_table}.{c}" for c in fk.to_columns if not catalog.table(fk.to_table).column(c)]
        if missing:
            raise RuleError("SCHEMA_KEY", f"{t.name} has keys on unknown columns: {missing}")
    return f"{len(catalog.foreign_keys())} foreign keys"


def _readable(source: Source, rules: RuleSet, catalog: Catalog) -> str:
    for name, text in resolved(rules, catalog).filters().items():
        source.scan(name, text).limit(1).count()
    return f"{len(rules.extract)} filtered tables"


def preflight(source: Source, catalog: Catalog, rules: RuleSet, secrets: Secrets | None, strict: bool = False, most_rate: float = 0.0, target: Callable[[], str] | None = None) -> list[Check]:
    """All checks in order; one that fails does not stop the others, but those that build on it are skipped."""
    found: list[Check] = []

    def run(name: str, check: Callable[[], str | None], after: str | None = None) -> None:
        if after and any(c.name == after and c.status in ("FAIL", "SKIP") for c in found):
            found.append(Check(name, "SKIP", f"after {after}"))
            return
        try:
            found.append(Check(name, "OK", check() or ""))
        except Exception as e:  # any failure is a finding
            found.append(Check(name, "FAIL", str(e).splitlines()[0]))

    run("secrets", lambda: check_secrets(secrets) if secrets else None)
    run("guardrails", lambda: check_guardrails(most_rate))
    run("rules", lambda: check_structure(rules))
    run("keys", lambda: _keys(source, catalog))
    run("names and types", lambda: "; ".join(check_against(rules, catalog, strict)), "rules")
    run("propagation", lambda: f"{len(propagate(rules, catalog).rules) - len(resolved(rules, catalog).rules)} rules added", "names and types")
    run("filters", lambda: _readable(source, rules, catalog), "names and types")
    run("reach", lambda: f"{len(Extraction(source, catalog, rules, depth=0).reach)} seed tables", "names and types")
    if target:
        run("target", target)
    if loops := sorted(cyclic(catalog)):
        found.append(Check("cycles", "WARN", f"{', '.join(loops)} refer to themselves: written last, in the catalog's order"))
    return found


def failed(found: list[Check]) -> bool:
    return any(c.status == "FAIL" for c in found)


def lines(found: list[Check]) -> Iterator[str]:
    for c in found:
        yield f"{c.status:<4} {c.name}" + (f": {c.detail}" if c.detail else "")
