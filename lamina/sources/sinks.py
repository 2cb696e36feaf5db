"""Sinks: Parquet, JDBC, SQL dump, none; quarantine; the manifest and state kept beside a run."""

from __future__ import annotations

import datetime
import gzip
import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.config import check_compression, parse_jdbc_url, quoted
from lamina.functions.text import copy_rows
from lamina.model import Catalog, RuleError, Table
from lamina.sources.scan import drop_binary, semi


class Sink:
    """open, then write for each table, then close. write returns (inserted, conflicts)."""

    def open(self, catalog: Catalog) -> None:
        self.catalog = catalog

    def write(self, table: str, df: DataFrame) -> tuple[int, int]:
        raise NotImplementedError

    def close(self) -> None:
        self.catalog = None

    def _opened(self) -> Catalog:
        if getattr(self, "catalog", None) is None:
            raise RuleError("SINK_NOT_OPEN", "write before open")
        return self.catalog


def _observed(df: DataFrame, save) -> int:
    """Run save(df) and return its rows, counted on the way."""
    from pyspark.sql import Observation

    seen = Observation()
    save(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]


class NoSink(Sink):
    """Computes every row and writes none (a dry run)."""

    def write(self, table: str, df: DataFrame) -> tuple[int, int]:
        self._opened()
        return _observed(df, lambda d: d.write.format("noop").mode("overwrite").save()), 0


class ParquetSink(Sink):
    def __init__(self, folder: str, compression: str = "zstd"):
        self.folder, self.compression = folder, compression

    def write(self, table: str, df: DataFrame) -> tuple[int, int]:
        self._opened()
        save = lambda d: d.write.mode("overwrite").option("compression", self.compression).parquet(f"{self.folder}/{table}.parquet")
        return _observed(df, save), 0


def staged_insert(schema: str, table: str, staging: str, columns: list[str]) -> str:
    """One statement that moves staged rows into their table and leaves out those that any unique key of it refuses."""
    names = ", ".join(map(quoted, columns))
    return f"INSERT INTO {quoted(schema, table)} ({names}) SELECT {names} FROM {quoted(schema, staging)} ON CONFLICT DO NOTHING"


class JdbcSink(Sink):
    """Appends in batches; rows whose primary key the target has, or that repeat one, count as conflicts and are left out.

    On PostgreSQL executors append to a staging table and one statement moves its rows, so other writers do no harm and any
    unique key counts; elsewhere keys the target has are read first. check_url refuses URLs, by default all but PostgreSQL's with allowed parameters.
    """

    def __init__(self, url: str, schema: str = "", batch_size: int = 1000, check_url: Callable = parse_jdbc_url, **options):
        check_url(url)
        self.options = {"url": url, "batchsize": str(batch_size), **options}
        self.schema, self.prefix = schema, f"{schema}." if schema else ""

    def _staged(self, table: str, df: DataFrame) -> tuple[int, int]:
        schema, staging = self.schema or "public", f"staging_{uuid.uuid4().hex[:16]}"
        at = self.options | {"dbtable": f"{schema}.{staging}"}
        spark = df.sparkSession
        properties = spark._jvm.java.util.Properties()
        for name, value in self.options.items():
            if name not in ("url", "batchsize", "driver"):
                properties.setProperty(name, value)
        connection = spark._jvm.java.sql.DriverManager.getConnection(self.options["url"], properties)
        try:
            statement = connection.createStatement()
            statement.executeUpdate(f"CREATE UNLOGGED TABLE {quoted(schema, staging)} AS TABLE {quoted(schema, table)} WITH NO DATA")
            try:
                total = _observed(df, lambda d: d.write.format("jdbc").options(**at).mode("append").save())
                inserted = statement.executeLargeUpdate(staged_insert(schema, table, staging, df.columns))
            finally:
                statement.executeUpdate(f"DROP TABLE {quoted(schema, staging)}")
        finally:
            connection.close()
        return inserted, total - inserted

    def write(self, table: str, df: DataFrame) -> tuple[int, int]:
        key = list(self._opened().table(table).primary_key)
        if self.options["url"].startswith("jdbc:postgresql:"):
            return self._staged(table, df)
        at = self.options | {"dbtable": self.prefix + table}
        total, fresh = None, df
        if key:
            total = df.count()
            there = df.sparkSession.read.format("jdbc").options(**at).load().select(*key)
            fresh = semi(df.dropDuplicates(key), key, there, "left_anti")
        n = _observed(fresh, lambda d: d.write.format("jdbc").options(**at).mode("append").save())
        return n, (total - n) if total is not None else 0


@contextmanager
def _text_file(path: Path, compression: str) -> Iterator:
    path.parent.mkdir(parents=True, exist_ok=True)
    if compression == "GZIP":
        with path.open("wb") as raw, gzip.GzipFile("", "wb", fileobj=raw, mtime=0) as f:
            yield lambda s: f.write(s.encode())
    elif compression == "ZSTD":
        import zstandard

        with path.open("wb") as raw, zstandard.ZstdCompressor().stream_writer(raw) as f:
            yield lambda s: f.write(s.encode())
    else:
        with path.open("w", encoding="utf-8", newline="") as f:
            yield f.write


def ddl(table: Table, schema: str) -> str:
    lines = [f"  {quoted(c.name)} {c.type}{'' if c.nullable else ' NOT NULL'}" for c in table.columns]
    if table.primary_key:
        lines.append(f"  PRIMARY KEY ({', '.join(map(quoted, table.primary_key))})")
    return f"CREATE TABLE {quoted(schema, table.name)} (\n" + ",\n".join(lines) + "\n);\n"


class DumpSink(Sink):
    """One SQL file: schema, then a COPY block for each table in order of its key; runs are byte-identical without timestamps.

    Rows stream through the driver one partition at a time, as a single file must; dump_parts() writes the same blocks in parallel.
    """

    def __init__(self, path: str, schema: str = "public", compression: str = "GZIP", timestamps: bool = True):
        check_compression(path, compression)
        self.path, self.schema, self.compression, self.timestamps = Path(path), schema, compression.upper(), timestamps

    def open(self, catalog: Catalog) -> None:
        super().open(catalog)
        self._file = _text_file(self.path, self.compression)
        self._put = self._file.__enter__()
        stamp = f"-- generated_at: {datetime.datetime.now(datetime.timezone.utc).isoformat()}\n" if self.timestamps else ""
        self._put(f"-- dump of schema {self.schema}\n{stamp}\n" + "\n".join(ddl(t, self.schema) for t in catalog.tables.values()) + "\nSET session_replication_role = 'replica';\n\n")

    def write(self, table: str, df: DataFrame) -> tuple[int, int]:
        key = list(self._opened().table(table).primary_key)
        ordered = df.orderBy(*(key or df.columns))
        n = 0
        for row in copy_rows(drop_binary(ordered), drop_binary=True).toLocalIterator():
            if not n:
                self._put(f"COPY {quoted(self.schema, table)} ({', '.join(map(quoted, df.columns))}) FROM stdin;\n")
            self._put(row.line + "\n")
            n += 1
        if n:
            self._put("\\.\n\n")
        return n, 0

    def close(self) -> None:
        self._put("SET session_replication_role = 'origin';\n")
        self._file.__exit__(None, None, None)
        super().close()


def dump_parts(df: DataFrame, path: str, compression: str = "gzip") -> int:
    """A table's COPY rows as compressed text parts, written by all executors; returns the rows."""
    return _observed(copy_rows(df, drop_binary=True), lambda d: d.write.mode("overwrite").option("compression", compression).text(path))


def make_sink(kind: str, **options) -> Sink:
    kinds = {"JDBC": JdbcSink, "DUMP": DumpSink, "NULL": NoSink, "PARQUET": ParquetSink}
    if kind.upper() not in kinds:
        raise RuleError("CONFIG_SINK_TYPE", f"unknown sink {kind}")
    if kind.upper() == "DUMP" and not options.get("path"):
        raise RuleError("CONFIG_OUTPUT_PATH_BLANK", "a dump needs a path")
    return kinds[kind.upper()](**options)


def quarantine(df: DataFrame, valid: Column, most_rate: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows by a check; fails if the share of bad rows exceeds most_rate (an equal share passes). A null check is bad."""
    good = F.coalesce(valid, F.lit(False))
    total, bad = df.agg(F.count("*"), F.count_if(~good)).first()
    if total and bad / total > most_rate:
        raise RuleError("WRITE_BATCH_ERROR_RATE", f"{bad} of {total} rows fail, more than {most_rate:g}")
    return df.where(good), df.where(~good)


@dataclass(frozen=True)
class Tolerance:
    """How a run deals with rows that its checks refuse: the share of them that it stands, and where they are kept (nowhere: they are counted only)."""

    most_rate: float = 0.0
    rejects: str | None = None
    check: Callable[[Table], Column | None] = lambda table: required(table)


def required(table: Table) -> Column | None:
    """Keys and columns that may not be null are set."""
    names = dict.fromkeys([*table.primary_key, *(c.name for c in table.columns if not c.nullable)])
    tests = [F.col(f"`{n}`").isNotNull() for n in names]
    return reduce(Column.__and__, tests) if tests else None


def tolerant_write(sink: Sink, table: Table, df: DataFrame, tolerance: Tolerance) -> tuple[int, int, int]:
    """Write the rows that pass their check: (inserted, conflicts, refused). Refused ones are counted first, on the checked columns alone.

    Fails before anything is written if their share exceeds the tolerance (an equal share passes); a null check refuses.
    """
    valid = tolerance.check(table)
    if valid is None:
        return *sink.write(table.name, df), 0
    good, bad = quarantine(df, valid, tolerance.most_rate)
    refused = bad.count()
    if refused and tolerance.rejects:
        bad.write.mode("overwrite").parquet(f"{tolerance.rejects}/{table.name}.parquet")
    return *sink.write(table.name, good), refused


# --- files beside a run --------------------------------------------------------------------------


def config_hash(text: str) -> str:
    """SHA-256 of a rule file with any line ends read as LF."""
    return hashlib.sha256(text.replace("\r\n", "\n").encode()).hexdigest()


def _atomic(path: Path, data: dict) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    new = path.with_suffix(path.suffix + ".new")
    with new.open("w", encoding="utf-8") as f:
        json.dump(data, f, indent=1, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(new, path)


class Checkpoint:
    """Tables a run has finished, so that another run skips them; a changed rule file is an error."""

    def __init__(self, path: str, config: str, resume: bool = False):
        self.path, self.hash, self.done = Path(path), config_hash(config), []
        if resume and self.path.exists():
            kept = json.loads(self.path.read_text("utf-8"))
            if kept["config"] != self.hash:
                raise RuleError("CHECKPOINT_CONFIG_DRIFT", "the rules changed since the checkpoint")
            self.done = kept["tables"]

    def finished(self, table: str) -> bool:
        return table in self.done

    def finish(self, table: str) -> None:
        self.done = [*self.done, table]
        _atomic(self.path, {"config": self.hash, "tables": self.done})

    def clear(self) -> None:
        self.path.unlink(missing_ok=True)


def write_state(path: str, strategies: list[tuple[str, str, str]]) -> None:
    """Which strategy each column went through, for a later audit."""
    _atomic(Path(path), {"columns": [list(x) for x in sorted(strategies)]})


def read_state(path: str) -> dict[tuple[str, str], str]:
    try:
        return {(t, c): s for t, c, s in json.loads(Path(path).read_text("utf-8"))["columns"]}
    except FileNotFoundError:
        return {}
