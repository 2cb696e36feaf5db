"""The foreign-key graph (tables are few: plain Python on the driver)."""

from __future__ import annotations

from lamina.model import Catalog


def _parents(catalog: Catalog, name: str) -> list[str]:
    return [fk.to_table for fk in catalog.table(name).foreign_keys if fk.to_table in catalog.tables]


def cyclic(catalog: Catalog) -> set[str]:
    """Tables on a foreign-key cycle, self references included."""
    out = set()
    for start in catalog.tables:
        seen, todo = set(), _parents(catalog, start)
        while todo:
            t = todo.pop()
            if t == start:
                out.add(start)
                break
            if t not in seen:
                seen.add(t)
                todo += _parents(catalog, t)
    return out


def topological(catalog: Catalog) -> list[str]:
    """Parents before children; tables on cycles come last."""
    loops, order = cyclic(catalog), []
    done: set[str] = set()

    def visit(name: str) -> None:
        if name not in done and name not in loops:
            done.add(name)
            for p in _parents(catalog, name):
                visit(p)
            order.append(name)

    for name in catalog.tables:
        visit(name)
    return order + [t for t in catalog.tables if t in loops]


def ancestors(catalog: Catalog, name: str, depth: int) -> set[str]:
    """Tables reached upwards in at most depth steps, without the table itself."""
    found, edge = set(), {name}
    for _ in range(depth):
        edge = {p for t in edge for p in _parents(catalog, t)} - found - {name}
        found |= edge
    return found


def configured_order(catalog: Catalog, names: list[str]) -> list[str]:
    """The given tables parents first, then those the catalog does not know, as given."""
    order = [t for t in topological(catalog) if t in names]
    return order + [t for t in names if t not in order]
