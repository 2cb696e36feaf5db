"""The pseudonymizing projection: all of a table's rules fused into one select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.crypto import encrypt_id, hmac_hex, uuid_of
from lamina.functions.fake import fake
from lamina.functions.jsonpath import rewrite
from lamina.functions.mask import mask
from lamina.model import ColumnRule, RuleSet, Secrets, SemanticType, Strategy

#: Strategy: (value, semantic type, secrets) -> new value. Null in gives null out for each.
REGISTRY = {
    Strategy.HASH: lambda v, kind, secrets: hmac_hex(v, secrets),
    Strategy.MASK: lambda v, kind, secrets: mask(v, kind),
    Strategy.FAKE: lambda v, kind, secrets: fake(v, kind, secrets),
    Strategy.FPE_ID: lambda v, kind, secrets: encrypt_id(v, secrets),
    Strategy.FPE_UUID: lambda v, kind, secrets: uuid_of(v, secrets),
    Strategy.KEEP: lambda v, kind, secrets: v,
    Strategy.NULLIFY: lambda v, kind, secrets: F.lit(None),
}
_TYPED = {Strategy.FPE_ID}


def transformed(value: Column, strategy: Strategy, kind: SemanticType | None, secrets: Secrets) -> Column:
    return REGISTRY[strategy](value, kind, secrets)


def column_for(rule: ColumnRule, value: Column, data_type, secrets: Secrets) -> Column:
    """The new value of a column under its rule, in the column's type where the strategy keeps it."""
    if rule.type == SemanticType.JSONB:
        leaf = lambda p: lambda text: (transformed(text, p.strategy, p.type, secrets), p.strategy in _TYPED)
        return rewrite(value, [(p.path, leaf(p)) for p in rule.json_paths])
    new = transformed(value, rule.strategy, rule.type, secrets)
    if rule.strategy in (Strategy.NULLIFY, Strategy.KEEP) or rule.strategy == Strategy.FPE_ID and data_type.typeName() in ("long", "string", "decimal"):
        return new.cast(data_type)
    if rule.strategy == Strategy.FPE_ID and data_type.typeName() in ("integer", "short", "byte"):
        return new.cast("int")  # ids up to 2**31-1 stay there
    return new


def pseudonymized(df: DataFrame, table: str, rules: RuleSet, secrets: Secrets) -> DataFrame:
    """df with each column that has a rule rewritten and all others passed through, in one projection."""
    own = {name.lower(): rule for name, rule in rules.of_table(table).items()}
    out = []
    for f in df.schema:
        value, rule = F.col(f"`{f.name}`"), own.get(f.name.lower())
        out.append(column_for(rule, value, f.dataType, secrets).alias(f.name) if rule else value)
    return df.select(*out)


def used_strategies(rules: RuleSet) -> list[tuple[str, str, str]]:
    """(table, column, strategy) of each rule; JSON rules count as JSONB."""
    return [(r.table, r.column, "JSONB" if r.type == SemanticType.JSONB else r.strategy.name) for r in rules.rules]
