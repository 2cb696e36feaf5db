"""Rule files: YAML to a RuleSet, and every check that needs no data."""

from __future__ import annotations

import re
from pathlib import Path
from urllib.parse import parse_qsl, urlsplit

import yaml

from lamina.model import Catalog, ColumnRule, ExtractTable, JsonPath, LinkedColumns, RuleError, RuleSet, SemanticType, Secrets, Strategy

# The words a filter may not hold, its greatest length, and the greatest distance of a suggestion.
FORBIDDEN = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "TRUNCATE", "GRANT", "REVOKE", "CREATE", "COPY", "CALL", "DO", "EXECUTE", "MERGE")
FILTER_LENGTH, SUGGEST = 1000, 3
DEFAULTS = {"fk_depth": 3, "fetch_size": 1000, "batch_size": 1000, "chunk_size": 10_000}
# Parameters allowed in a JDBC URL.
JDBC_PARAMETERS = frozenset(
    [
        "ssl", "sslmode", "sslrootcert", "sslcert", "sslkey", "sslcrl", "applicationName", "ApplicationName", "connectTimeout", "socketTimeout",
        "loginTimeout", "tcpKeepAlive", "currentSchema", "options", "gssEncMode", "targetServerType", "readOnly", "defaultRowFetchSize",
        "prepareThreshold", "assumeMinServerVersion", "reWriteBatchedInserts", "loadBalanceHosts", "hostRecheckSeconds", "binaryTransfer",
    ]
)
# Families of logical types.
FAMILIES = {
    "NUMERIC": ["smallint", "integer", "bigint", "int", "int2", "int4", "int8", "decimal", "numeric", "real", "double precision", "double", "float", "float4", "float8", "serial", "bigserial", "smallserial"],
    "STRING": ["character", "character varying", "varchar", "text", "citext", "name", "bpchar", "char"],
    "UUID": ["uuid"],
    "JSON": ["json", "jsonb"],
    "BOOLEAN": ["boolean", "bool"],
    "TEMPORAL": ["timestamp", "timestamptz", "timestamp without time zone", "timestamp with time zone", "date", "time", "timetz", "time without time zone", "time with time zone", "interval"],
}
_FAMILY = {name: kind for kind, names in FAMILIES.items() for name in names}
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_$]{0,62}\Z")


def distance(a: str, b: str) -> int:
    """Levenshtein distance, case ignored."""
    a, b = a.lower(), b.lower()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def closest(name: str, known, most: int = SUGGEST) -> str | None:
    """The first of the known names at the least distance, if that is at most `most`."""
    best = min(((distance(name, k), i, k) for i, k in enumerate(known)), default=None)
    return best[2] if best and best[0] <= most else None


def check_identifier(name: str | None) -> str:
    if not name or not _IDENTIFIER.match(name):
        raise RuleError("CONFIG_INVALID_IDENTIFIER", f"'{name}' is not a valid table or column name")
    return name


def quoted(*names: str) -> str:
    """Checked names in double quotes, joined by dots."""
    return ".".join(f'"{check_identifier(n)}"' for n in names)


def check_filter(table: str, text: str | None) -> None:
    """Refuse predicates that could be more than a predicate; a blank one is none."""
    text = (text or "").strip()
    reason = None
    if len(text) > FILTER_LENGTH:
        reason = f"longer than {FILTER_LENGTH} characters"
    elif "\0" in text:
        reason = "holds a NUL"
    elif any(m in text for m in ("--", "/*", "*/")):
        reason = "holds a comment marker"
    elif ";" in re.sub(r"'(?:[^']|'')*('|\Z)", "", text):
        reason = "holds a semicolon outside a literal"
    elif m := re.search(rf"\b({'|'.join(FORBIDDEN)})\b", text, re.I):
        reason = f"holds the keyword {m[1].upper()}"
    if reason:
        raise RuleError("CONFIG_EXTRACTION_FILTER_INVALID", f"filter of {table} {reason}: {text[:80]}")


def check_secrets(secrets: Secrets) -> None:
    for name, value, fits in (("HMAC_SECRET", secrets.hmac_secret, lambda n: n >= 16), ("FPE_KEY", secrets.fpe_key, lambda n: n in (16, 24, 32))):
        if not (value or "").strip():
            raise RuleError(f"CONFIG_{name}_MISSING", f"{name.lower()} must be set")
        if not fits(len(value.encode())):
            raise RuleError(f"CONFIG_{name}_TOO_SHORT" if name == "HMAC_SECRET" else f"CONFIG_{name}_INVALID_LENGTH", f"{name.lower()} has {len(value.encode())} bytes")


def check_guardrails(max_batch_error_rate: float = 0.0, max_target_rows: int = 0, heap_warning_percent: int = 80) -> None:
    for name, value, low, high in (("max_batch_error_rate", max_batch_error_rate, 0, 1), ("max_target_rows", max_target_rows, 0, float("inf")), ("heap_warning_percent", heap_warning_percent, 1, 100)):
        if not low <= value <= high:
            raise RuleError("CONFIG_GUARDRAIL_OUT_OF_RANGE", f"{name} must be from {low} to {high}, is {value}")


def check_output_path(raw: str | None, name: str, base: Path | None = None) -> Path:
    """An absolute path below the working directory."""
    base = (base or Path.cwd()).resolve()
    if not (raw or "").strip():
        raise RuleError("CONFIG_OUTPUT_PATH_BLANK", f"{name} must not be blank")
    if "\0" in raw:
        raise RuleError("CONFIG_OUTPUT_PATH_INVALID", f"{name} holds a NUL")
    path = (base / raw).resolve()
    if path != base and base not in path.parents:
        raise RuleError("CONFIG_OUTPUT_PATH_TRAVERSAL", f"{name} lies outside {base}")
    return path


def check_compression(path: str, compression: str) -> None:
    """The ending of a dump's name must tell its compression."""
    want = {"GZIP": ".gz", "ZSTD": ".zst", "NONE": ""}[compression.upper()]
    has = next((e for e in (".gz", ".zst") if path.lower().endswith(e)), "")
    if has != want:
        raise RuleError("CONFIG_SINK_COMPRESSION_EXTENSION_MISMATCH", f"compression {compression} and path {path} do not fit")


def parse_jdbc_url(raw: str | None, name: str = "url") -> dict:
    """Host, port, database and sslmode of a PostgreSQL JDBC URL whose parameters are all allowed."""
    if not (raw or "").strip():
        raise RuleError("CONFIG_JDBC_URL_BLANK", f"{name} must not be blank")
    if not raw.startswith("jdbc:postgresql:"):
        raise RuleError("CONFIG_JDBC_URL_INVALID", f"{name} must start with jdbc:postgresql:")
    rest = raw.removeprefix("jdbc:postgresql:")
    try:
        parts = urlsplit(rest if rest.startswith("//") else f"//localhost/{rest}")
        host, port = parts.hostname or "localhost", parts.port or 5432
        given = dict(parse_qsl(parts.query, keep_blank_values=True))
    except ValueError as e:
        raise RuleError("CONFIG_JDBC_URL_INVALID", f"{name}: {e}") from e
    if refused := sorted(set(given) - JDBC_PARAMETERS):
        raise RuleError("CONFIG_JDBC_URL_REJECTED_PARAM", f"{name} has parameters that are not allowed: {refused}")
    if not (database := parts.path.strip("/")):
        raise RuleError("CONFIG_JDBC_URL_INVALID", f"{name} names no database")
    return {"host": host, "port": port, "database": database, "sslmode": given.get("sslmode")}


def _enum(kind, value, where: str):
    if value is None:
        return None
    try:
        return kind[str(value).strip().upper()]
    except KeyError:
        raise RuleError("CONFIG_UNKNOWN_VALUE", f"{where}: {value} is no {kind.__name__}") from None


def parse_rules(text: str) -> RuleSet:
    """A RuleSet from YAML; unknown properties are ignored and the names of strategies and types may have any case."""
    try:
        raw = yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        raise RuleError("CONFIG_UNREADABLE", str(e)) from e
    if not isinstance(raw, dict):
        raise RuleError("CONFIG_UNREADABLE", "the file must hold a mapping")
    ext, anon = raw.get("extraction") or {}, raw.get("anonymization") or {}
    rules = []
    for t in anon.get("tables") or []:
        for c in t.get("columns") or []:
            where = f"{t.get('table')}.{c.get('name')}"
            paths = tuple(JsonPath(p.get("path") or "", _enum(Strategy, p.get("strategy"), where), _enum(SemanticType, p.get("type"), where)) for p in c.get("json_paths") or [])
            rules.append(ColumnRule(t.get("table"), c.get("name"), _enum(Strategy, c.get("strategy"), where), _enum(SemanticType, c.get("type"), where), paths))
    linked = tuple(LinkedColumns(x.get("semantic_key"), tuple((y.get("table"), y.get("column")) for y in x.get("columns") or [])) for x in anon.get("linked_columns") or [])
    sizes = {k: (ext.get(k) or d) for k, d in DEFAULTS.items()}
    return RuleSet(tuple(ExtractTable(t.get("table"), t.get("filter")) for t in ext.get("tables") or []), tuple(rules), linked, **sizes)


def load_rules(path: str) -> RuleSet:
    file = Path(path)
    if not file.is_file():
        raise RuleError("CONFIG_NOT_FOUND", f"{path} does not exist")
    rules = parse_rules(file.read_text("utf-8"))
    check_structure(rules)
    return rules


def check_structure(rules: RuleSet) -> None:
    """What a rule file must satisfy on its own."""
    if not rules.extract:
        raise RuleError("CONFIG_EXTRACTION_TABLES_EMPTY", "extraction.tables must not be empty")
    for name in DEFAULTS:
        if getattr(rules, name) <= 0:
            raise RuleError(f"CONFIG_EXTRACTION_{name.upper()}_INVALID", f"extraction.{name} must be positive")
    for t in rules.extract:
        check_identifier(t.table)
        check_filter(t.table, t.filter)
    for r in rules.rules:
        check_identifier(r.table)
        check_identifier(r.column)
        if r.strategy == Strategy.FAKE and r.type is None:
            raise RuleError("CONFIG_STRATEGY_REQUIRES_TYPE", f"{r.table}.{r.column}: FAKE needs a type")
        if r.type == SemanticType.JSONB and not r.json_paths:
            raise RuleError("CONFIG_JSONB_REQUIRES_JSON_PATHS", f"{r.table}.{r.column}: JSONB needs json_paths")
        for p in r.json_paths:
            if p.type == SemanticType.JSONB:
                raise RuleError("CONFIG_JSONB_NESTED", f"{r.table}.{r.column} {p.path}: a leaf cannot be JSONB")


def family(type_name: str) -> str:
    return _FAMILY.get(re.sub(r"\(.*\)", "", type_name).strip().lower(), "OTHER")


def fit(strategy: Strategy, kind: SemanticType | None, type_name: str) -> str:
    """OK, SUSPECT or INCOMPATIBLE: a strategy on a column's type."""
    f = family(type_name)
    if strategy in (Strategy.KEEP, Strategy.NULLIFY):
        return "OK"
    if kind == SemanticType.JSONB and strategy == Strategy.FAKE:
        return "OK" if f == "JSON" else "INCOMPATIBLE"
    good, doubtful = {
        Strategy.FPE_ID: (("NUMERIC",), ("STRING",)),
        Strategy.FPE_UUID: (("UUID",), ("STRING",)),
        Strategy.HASH: (("STRING",), ("NUMERIC", "UUID", "BOOLEAN", "TEMPORAL", "OTHER")),
        Strategy.FAKE: (("STRING",), ()),
        Strategy.MASK: (("STRING",), ("NUMERIC",)),
    }[strategy]
    return "OK" if f in good else "SUSPECT" if f in doubtful else "INCOMPATIBLE"


def check_against(rules: RuleSet, catalog: Catalog, strict: bool = False) -> list[str]:
    """Names and types against the catalog (case ignored): errors carry a suggestion; returns what is suspect."""
    names = {t.lower(): t for t in catalog.tables}

    def known(table: str, column: str | None = None) -> None:
        if (table or "").lower() not in names:
            raise RuleError("CONFIG_UNKNOWN_TABLE", f"unknown table '{table}'" + _hint(closest(table or "", catalog.tables)))
        columns = [c.name for c in catalog.table(names[table.lower()]).columns]
        if column is not None and column.lower() not in map(str.lower, columns):
            raise RuleError("CONFIG_UNKNOWN_COLUMN", f"unknown column '{table}.{column}'" + _hint(closest(column, columns)))

    notes = []
    for t in rules.extract:
        known(t.table)
    for r in rules.rules:
        known(r.table, r.column)
        kind = catalog.table(names[r.table.lower()]).column(r.column).type
        verdict = fit(r.strategy, r.type, kind)
        if verdict == "INCOMPATIBLE" and strict:
            raise RuleError("CONFIG_STRATEGY_INCOMPATIBLE", f"{r.strategy.name} on {r.table}.{r.column} ({kind})")
        if verdict != "OK":
            notes.append(f"{verdict}: {r.strategy.name} on {r.table}.{r.column} ({kind})")
    for link in rules.linked:
        for table, column in link.columns:
            known(table, column)
    return notes


def _hint(name: str | None) -> str:
    return f"; did you mean '{name}'?" if name else ""
