"""Scans of a schema's tables: filtered, chunked, distinct, by key, sampled; schema and statistics."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.config import check_filter, check_identifier, parse_jdbc_url, quoted
from lamina.model import Catalog, Column, ForeignKey, RuleError, Table

_LOGICAL = {"string": "text", "long": "bigint", "integer": "integer", "short": "smallint", "byte": "smallint", "double": "double precision", "float": "real", "boolean": "boolean", "date": "date", "timestamp": "timestamptz", "timestamp_ntz": "timestamp", "binary": "bytea"}


#: A database's estimate of the rows of its tables.
STATISTICS = "SELECT c.relname AS name, CAST(c.reltuples AS BIGINT) AS n FROM pg_class c JOIN pg_namespace s ON s.oid = c.relnamespace WHERE c.relkind IN ('r', 'p') AND s.nspname = '{schema}'"


class Source:
    """Tables of one schema: a folder of Parquet tables (name.parquet), any DataFrames, or a JDBC database."""

    connection: tuple[dict, str] | None = None

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame]):
        self.spark, self.frames = spark, dict(sorted(frames.items()))

    @classmethod
    def parquet(cls, spark: SparkSession, folder: str, names: list[str]) -> Source:
        return cls(spark, {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names})

    @classmethod
    def jdbc(cls, spark: SparkSession, url: str, schema: str, names: list[str], fetch_size: int = 1000, partition_by: dict[str, str] | None = None, partitions: int = 16, check_url: Callable = parse_jdbc_url, **options) -> Source:
        """Filters and columns are pushed to the database; fetch_size is the cursor's. check_url refuses URLs, by default all but PostgreSQL's with allowed parameters.

        A table in partition_by is read through `partitions` cursors, in ranges of that numeric column between its least and largest value (one query finds both); others through one.
        """
        check_url(url)
        at = {"url": url, "fetchsize": str(fetch_size), **options}

        def read(name: str) -> DataFrame:
            table = f"{schema}.{name}" if schema else name
            more = {}
            if column := (partition_by or {}).get(name):
                bounds = spark.read.format("jdbc").options(**at, query=f"SELECT min({quoted(column)}) AS low, max({quoted(column)}) AS high FROM {table}").load().first()
                if bounds[0] is not None:
                    more = {"partitionColumn": column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
            return spark.read.format("jdbc").options(**at, dbtable=table, **more).load()

        made = cls(spark, {n: read(n) for n in names})
        made.connection = (at, schema)
        return made

    def register(self) -> None:
        """Temporary views by table name, for filters with sub-queries."""
        for name, df in self.frames.items():
            df.createOrReplaceTempView(name)

    def scan(self, table: str, where: str | None = None, order_by: str | None = None) -> DataFrame:
        """All columns of the rows that satisfy a checked predicate (sub-queries allowed), lazily, optionally in order."""
        check_filter(table, where)
        df = self.frames[table]
        if where and where.strip():
            if "select" in where.lower():
                self.register()
            df = df.where(where)
        return df.orderBy(order_by) if order_by else df

    def chunks(self, table: str, consume: Callable[[list], None], where: str | None = None, chunk_size: int = 10_000, order_by: str | None = None) -> int:
        """Hand rows to consume on the driver, at most chunk_size at once; never more than one partition is held."""
        if chunk_size <= 0:
            raise RuleError("SCAN_CHUNK_SIZE", "chunk_size must be positive")
        held, total = [], 0
        for row in self.scan(table, where, order_by).toLocalIterator():
            held.append(row)
            if len(held) == chunk_size:
                consume(held)
                total, held = total + len(held), []
        if held:
            consume(held)
        return total + len(held)

    def distinct_values(self, table: str, columns: list[str], where: str | None = None) -> DataFrame:
        """Distinct tuples; a tuple with any null is left out."""
        return self.scan(table, where).select(*columns).na.drop("any").distinct()

    def by_keys(self, table: str, columns: list[str], keys: DataFrame) -> DataFrame:
        """Rows whose columns equal one of the keys' tuples (same number of columns, by position)."""
        return semi(self.frames[table], columns, keys)

    def row_counts(self) -> dict[str, int]:
        """Rows of each table from statistics, or -1: a PostgreSQL database's own estimates (-1 where it never analysed a table), else file footers (no column is read)."""
        out = {}
        if self.connection and self.connection[0]["url"].startswith("jdbc:postgresql:"):
            at, schema = self.connection
            known = {r[0]: r[1] for r in self.spark.read.format("jdbc").options(**at, query=STATISTICS.format(schema=check_identifier(schema or "public"))).load().collect()}
            return {name: known.get(name, -1) for name in self.frames}
        for name, df in self.frames.items():
            try:
                out[name] = max(0, df.select().count())
            except Exception:  # a missing or unreadable table is reported, not fatal
                out[name] = -1
        return out


def semi(df: DataFrame, columns: list[str], keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """df semi- or anti-joined with keys by position."""
    names = [f"_k{i}" for i in range(len(columns))]
    keys = keys.toDF(*names)
    on = [df[c] == keys[k] for c, k in zip(columns, names)]
    condition = on[0]
    for c in on[1:]:
        condition &= c
    return df.join(keys, condition, how)


def logical_type(data_type: T.DataType) -> str:
    if isinstance(data_type, T.DecimalType):
        return f"numeric({data_type.precision},{data_type.scale})"
    return _LOGICAL.get(data_type.typeName(), data_type.simpleString())


def introspect(source: Source, keys: dict[str, list[str]], foreign: list[ForeignKey], types: dict[tuple[str, str], str] | None = None) -> Catalog:
    """Catalog of a source's columns with declared keys (files enforce none); types overrides logical types, as for uuid or jsonb texts."""
    types = types or {}
    tables = {}
    for name, df in source.frames.items():
        columns = tuple(Column(f.name, types.get((name, f.name), logical_type(f.dataType)), f.nullable) for f in df.schema)
        tables[name] = Table(name, columns, tuple(keys.get(name, ())), tuple(fk for fk in foreign if fk.from_table == name))
    return Catalog(tables)


def fingerprint(catalog: Catalog) -> str:
    """SHA-256 of tables, columns with types, and foreign keys in a fixed order."""
    shape = [[t.name, [[c.name, c.type, c.nullable] for c in t.columns], list(t.primary_key), sorted(map(str, t.foreign_keys))] for t in catalog.tables.values()]
    return hashlib.sha256(json.dumps(shape).encode()).hexdigest()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (unset, in a local session as in tests) one in the warehouse; on a cluster it must be set."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuleError("CONFIG_CHECKPOINT_DIR", "spark.checkpoint.dir must name a folder that driver and executors share")
    return set_dir or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lamina_scratch"


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and its path: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/lamina/keys-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that written() made."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_binary(df: DataFrame) -> DataFrame:
    """Binary columns as null, for text output."""
    return df.select(*(F.lit(None).cast("binary").alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f"`{f.name}`") for f in df.schema))
