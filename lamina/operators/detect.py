"""Columns that look personal or identifying but have no rule that hides them."""

from __future__ import annotations

from dataclasses import dataclass

from lamina.model import Catalog, RuleSet, Strategy
from lamina.operators.rules import resolved

# Parts of column names, in the order that decides which one is reported.
PERSONAL = [
    "name", "nom", "prenom", "firstname", "lastname", "fullname", "email", "mail", "phone", "tel", "mobile", "fax", "address", "adresse", "street",
    "rue", "city", "ville", "zip", "postal", "birthday", "birth", "dob", "gender", "sexe", "ssn", "nir", "national_id", "iban", "bic", "card", "pan",
    "credit", "ip_address", "ip_addr", "ipv4", "ipv6", "session", "token", "api_key", "password", "passwd",
]
QUASI = [
    "birth", "dob", "naissance", "age", "postal", "zip", "gender", "sex", "sexe", "genre", "nationality", "nationalite", "citizenship", "ethnicity",
    "ethnie", "race", "religion", "marital", "situation_familiale", "civilite", "salary", "salaire", "income", "revenu", "profession", "occupation",
    "metier", "disability", "handicap",
]
TEXT_TYPES = ("char", "text", "varchar", "name", "citext", "bpchar")
#: Strategies that hide a quasi-identifier: for the detector, and for an audit of a finished run.
NEUTRAL = frozenset({Strategy.FAKE, Strategy.NULLIFY, Strategy.MASK})
NEUTRAL_AFTER_RUN = NEUTRAL | {Strategy.FPE_ID, Strategy.FPE_UUID}


@dataclass(frozen=True)
class Finding:
    table: str
    column: str
    type: str
    pattern: str
    strategy: Strategy | None = None


def _match(name: str, patterns) -> str | None:
    return next((p for p in patterns if p in name.lower()), None)


def is_text(type_name: str | None) -> bool:
    return any(p in (type_name or "").lower() for p in TEXT_TYPES)


def personal_columns(catalog: Catalog, rules: RuleSet, patterns=PERSONAL) -> list[Finding]:
    """Text columns without a rule whose name holds a pattern (the first in the list's order is reported)."""
    rules = resolved(rules, catalog)
    covered = {(r.table, r.column) for r in rules.rules}
    return [Finding(t.name, c.name, c.type, p) for t in catalog.tables.values() for c in t.columns if is_text(c.type) and (t.name, c.name) not in covered and (p := _match(c.name, patterns))]


def quasi_identifiers(catalog: Catalog, rules: RuleSet, patterns=QUASI, neutral=NEUTRAL, enabled: bool = True) -> list[Finding]:
    """Columns by name that have a rule which does not neutralise them, or none and are not text (personal_columns sees to those)."""
    rules = resolved(rules, catalog)
    strategy = {(r.table, r.column): r.strategy for r in rules.rules}
    out = []
    for t in catalog.tables.values() if enabled else ():
        for c in t.columns:
            own = strategy.get((t.name, c.name))
            if (p := _match(c.name, patterns)) and (not is_text(c.type) if own is None else own not in neutral):
                out.append(Finding(t.name, c.name, c.type, p, own))
    return out
