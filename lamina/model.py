"""Data model: catalog of tables and keys, pseudonymization rules, and the errors they raise."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class Strategy(Enum):
    FAKE = "FAKE"
    MASK = "MASK"
    HASH = "HASH"
    NULLIFY = "NULLIFY"
    KEEP = "KEEP"
    FPE_ID = "FPE_ID"
    FPE_UUID = "FPE_UUID"


class SemanticType(Enum):
    EMAIL = "EMAIL"
    FIRST_NAME = "FIRST_NAME"
    LAST_NAME = "LAST_NAME"
    PHONE = "PHONE"
    ADDRESS = "ADDRESS"
    IBAN = "IBAN"
    IP_ADDRESS = "IP_ADDRESS"
    JSONB = "JSONB"


class PlanMode(Enum):
    EXACT = "EXACT"
    ESTIMATE = "ESTIMATE"


class ChildScope(Enum):
    """Whose children are followed: those of every reached table, or of the configured tables only."""

    ALL = "ALL"
    CONFIGURED = "CONFIGURED"


class RuleError(ValueError):
    """A rejected configuration or value; `code` names the rule."""

    def __init__(self, code: str, message: str):
        super().__init__(f"[{code}] {message}")
        self.code = code


@dataclass(frozen=True)
class Column:
    name: str
    type: str  # logical: text, uuid, jsonb, bigint, ...
    nullable: bool = True


@dataclass(frozen=True)
class ForeignKey:
    from_table: str
    from_columns: tuple[str, ...]
    to_table: str
    to_columns: tuple[str, ...]

    def __post_init__(self):
        if not self.from_columns or len(self.from_columns) != len(self.to_columns):
            raise RuleError("CATALOG_FOREIGN_KEY", f"{self.from_table}->{self.to_table}: columns must pair up, at least one")

    @property
    def composite(self) -> bool:
        return len(self.from_columns) > 1

    def __str__(self) -> str:
        return f"{self.from_table}({','.join(self.from_columns)})->{self.to_table}({','.join(self.to_columns)})"


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()

    @property
    def single_key(self) -> str | None:
        return self.primary_key[0] if len(self.primary_key) == 1 else None

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)


@dataclass(frozen=True)
class Catalog:
    """Tables in a fixed order (by name)."""

    tables: dict[str, Table]

    def __post_init__(self):
        object.__setattr__(self, "tables", dict(sorted(self.tables.items())))

    def table(self, name: str) -> Table:
        return self.tables[name]

    def foreign_keys(self) -> list[ForeignKey]:
        return [fk for t in self.tables.values() for fk in t.foreign_keys]

    def referencing(self, name: str) -> list[ForeignKey]:
        return [fk for fk in self.foreign_keys() if fk.to_table == name]


@dataclass(frozen=True)
class JsonPath:
    path: str
    strategy: Strategy
    type: SemanticType | None = None


@dataclass(frozen=True)
class ColumnRule:
    table: str
    column: str
    strategy: Strategy
    type: SemanticType | None = None
    json_paths: tuple[JsonPath, ...] = ()


@dataclass(frozen=True)
class LinkedColumns:
    semantic_key: str
    columns: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class ExtractTable:
    table: str
    filter: str | None = None


@dataclass(frozen=True)
class RuleSet:
    extract: tuple[ExtractTable, ...] = ()
    rules: tuple[ColumnRule, ...] = ()
    linked: tuple[LinkedColumns, ...] = ()
    fk_depth: int = 3
    fetch_size: int = 1000
    batch_size: int = 1000
    chunk_size: int = 10_000

    def of_table(self, table: str) -> dict[str, ColumnRule]:
        """Rules by column; the table's name in any case; of several entries the last counts."""
        return {r.column: r for r in self.rules if (r.table or "").lower() == table.lower()}

    def filters(self) -> dict[str, str | None]:
        return {t.table: (t.filter or "").strip() or None for t in self.extract}


@dataclass(frozen=True)
class Secrets:
    """Keys of the transforms; never printed."""

    hmac_secret: str = field(repr=False)
    fpe_key: str = field(repr=False)
    algorithm: str = "HmacSHA256"
    locale: str = "fr"
