"""Rule compiler: rules flow along foreign keys, and contradictions are refused."""

from __future__ import annotations

from dataclasses import replace
from itertools import combinations

from lamina.model import Catalog, ColumnRule, RuleError, RuleSet, Strategy

SPREADING = (Strategy.FPE_ID, Strategy.FPE_UUID, Strategy.HASH)
Key = tuple[str, str]


class Classes:
    """Columns that hold the same logical value: union-find over foreign-key positions."""

    def __init__(self, catalog: Catalog):
        self.root: dict[Key, Key] = {}
        for fk in catalog.foreign_keys():
            for a, b in zip(fk.from_columns, fk.to_columns):
                x, y = self.find((fk.from_table, a)), self.find((fk.to_table, b))
                if x != y:
                    self.root[max(x, y)] = min(x, y)

    def find(self, key: Key) -> Key:
        self.root.setdefault(key, key)
        while self.root[key] != key:
            self.root[key] = self.root[self.root[key]]
            key = self.root[key]
        return key

    def groups(self) -> dict[Key, list[Key]]:
        out: dict[Key, list[Key]] = {}
        for key in sorted(self.root):
            out.setdefault(self.find(key), []).append(key)
        return out


def resolved(rules: RuleSet, catalog: Catalog) -> RuleSet:
    """The rules with the catalog's spelling of tables and columns: names may be written in any case. Unknown names stay as they are.

    An exact match wins over one in another case; of several rules for one column the last counts.
    """
    tables = {t.lower(): t for t in reversed(list(catalog.tables))} | {t: t for t in catalog.tables}

    def table(name: str) -> str:
        return tables.get(name) or tables.get((name or "").lower(), name)

    def column(of: str, name: str) -> str:
        known = catalog.tables.get(table(of))
        names = [c.name for c in known.columns] if known else []
        return name if name in names else next((c for c in names if c.lower() == (name or "").lower()), name)

    own = {}
    for r in rules.rules:
        own[(table(r.table), column(r.table, r.column))] = replace(r, table=table(r.table), column=column(r.table, r.column))
    linked = tuple(replace(x, columns=tuple((table(t), column(t, c)) for t, c in x.columns)) for x in rules.linked)
    return replace(rules, extract=tuple(replace(t, table=table(t.table)) for t in rules.extract), rules=tuple(own.values()), linked=linked)


def _named(key: Key) -> str:
    return ".".join(key)


def propagate(rules: RuleSet, catalog: Catalog) -> RuleSet:
    """The rules plus those that columns inherit from the foreign-key class they belong to.

    FPE_ID, FPE_UUID and HASH spread to undeclared members, FAKE too if every pair of members that are not NULLIFY is linked.
    Refused: members with different strategies (or FAKE types; an explicit KEEP counts, NULLIFY opts out), and MASK
    or NULLIFY on a referenced key unless the referencing column is NULLIFY. Names may be in any case; the result has the catalog's.
    """
    rules = resolved(rules, catalog)
    declared = {(r.table, r.column): r for r in rules.rules}
    for fk in catalog.foreign_keys():
        for a, b in zip(fk.from_columns, fk.to_columns):
            target, source = declared.get((fk.to_table, b)), declared.get((fk.from_table, a))
            if target and target.strategy in (Strategy.MASK, Strategy.NULLIFY) and not (source and source.strategy == Strategy.NULLIFY):
                raise RuleError("CONFIG_FK_PROPAGATION_INTEGRITY_BREAKING", f"{target.strategy.name} on {fk.to_table}.{b}, which {fk.from_table}.{a} references")
    linked = {frozenset(p) for x in rules.linked for p in combinations(x.columns, 2)}
    new: list[ColumnRule] = []
    for members in Classes(catalog).groups().values():
        active = [m for m in members if m in declared and declared[m].strategy != Strategy.NULLIFY]
        if not active:
            continue
        lead = declared[active[0]]
        if any(declared[m].strategy != lead.strategy or lead.strategy == Strategy.FAKE and declared[m].type != lead.type for m in active):
            raise RuleError("CONFIG_FK_PROPAGATION_STRATEGY_CONFLICT", "columns of one key differ: " + ", ".join(f"{_named(m)}={declared[m].strategy.name}" for m in active))
        if lead.strategy == Strategy.FAKE:
            open_ = [m for m in members if m not in declared or declared[m].strategy != Strategy.NULLIFY]
            for pair in combinations(open_, 2):
                if frozenset(pair) not in linked:
                    raise RuleError("CONFIG_FK_PROPAGATION_FAKE_REQUIRES_LINK", f"no linked_columns entry for {_named(pair[0])} and {_named(pair[1])}")
        elif lead.strategy not in SPREADING:
            continue
        new += [ColumnRule(*m, lead.strategy, lead.type) for m in members if m not in declared]
    return replace(rules, rules=rules.rules + tuple(new))
