"""Registered queries whose results are small: validators, the key graph, runs, plans, policies; each beside literal SQL or SQL over the tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina import config
from lamina.functions.crypto import ID_MAX, INT_MAX, encrypt_id
from lamina.functions.fake import fake
from lamina.model import Catalog, ChildScope, ColumnRule, ExtractTable, ForeignKey, JsonPath, LinkedColumns, PlanMode, RuleError, RuleSet, Secrets, SemanticType, Strategy
from lamina.operators import dictionary, graph, kanon
from lamina.operators.extract import Extraction
from lamina.operators.pseudonymize import pseudonymized
from lamina.operators.rules import propagate, resolved
from lamina.plans.planner import Outcome, Plan, PlannedTable, TableOutcome, delta_text, guard, insights
from lamina.preflight import preflight
from lamina.queries import _CLOSURE, FOREIGN, SECRETS, SEED, STAR, _rows, catalog, query, source, sql_hmac
from lamina.report import audit_markdown, plan_text
from lamina.run import compiled, execute, planned
from lamina.sources.scan import discard, fingerprint, shared_dir
from lamina.sources.sinks import NoSink, ParquetSink, Tolerance, dump_parts, make_sink, staged_insert


def _values(columns: str, rows: list[tuple]) -> str:
    """SQL of a literal table."""
    word = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    names = [c.strip() for c in columns.split(",")]
    return f"SELECT {', '.join(f'col{i} AS \"{n}\"' for i, n in enumerate(names))} FROM (VALUES {', '.join('(' + ', '.join(map(word, r)) + ')' for r in rows)})"


def verdict(check: Callable[[], object]) -> str:
    """OK, or the code of the error."""
    try:
        check()
    except RuleError as e:
        return e.code
    return "OK"


def _checked(name: str, check: Callable, cases: list[tuple[str, object, str]]) -> None:
    """Register a query of (given, verdict) for named arguments, with the verdicts that are right as its SQL."""

    @query(_values("given, verdict", [(label, code) for label, _, code in cases]), name)
    def run(spark, sf_dir):
        return _rows(spark, [(label, verdict(lambda v=value: check(v))) for label, value, _ in cases], "given string, verdict string")


# --- validators -----------------------------------------------------------------------------------

_checked(
    "filter_verdicts",
    lambda text: config.check_filter("t", text),
    [("none", None, "OK"), ("plain", "a > 1 and b = 'x;y'", "OK"), ("semicolon", "a = 1; b", "CONFIG_EXTRACTION_FILTER_INVALID"), ("comment", "a = 1 -- b", "CONFIG_EXTRACTION_FILTER_INVALID"), ("drop", "a = (drop table b)", "CONFIG_EXTRACTION_FILTER_INVALID"), ("subquery", "a in (select b from c)", "OK"), ("long", "a" * 1001, "CONFIG_EXTRACTION_FILTER_INVALID"), ("word inside another", "updated_at > 1", "OK")],
)
_checked("identifier_verdicts", config.check_identifier, [("plain", "a_1$", "OK"), ("digit first", "1a", "CONFIG_INVALID_IDENTIFIER"), ("quote", 'a"b', "CONFIG_INVALID_IDENTIFIER"), ("long", "a" * 64, "CONFIG_INVALID_IDENTIFIER"), ("empty", "", "CONFIG_INVALID_IDENTIFIER")])
_checked(
    "jdbc_url_verdicts",
    config.parse_jdbc_url,
    [("plain", "jdbc:postgresql://h:5433/d?sslmode=require", "OK"), ("no host", "jdbc:postgresql:d", "OK"), ("other", "jdbc:mysql://h/d", "CONFIG_JDBC_URL_INVALID"), ("factory", "jdbc:postgresql://h/d?socketFactory=x", "CONFIG_JDBC_URL_REJECTED_PARAM"), ("blank", " ", "CONFIG_JDBC_URL_BLANK"), ("no database", "jdbc:postgresql://h/", "CONFIG_JDBC_URL_INVALID")],
)
_checked(
    "secret_verdicts",
    lambda pair: config.check_secrets(Secrets(*pair)),
    [("right", ("h" * 16, "k" * 32), "OK"), ("short hmac", ("h" * 15, "k" * 16), "CONFIG_HMAC_SECRET_TOO_SHORT"), ("no hmac", ("", "k" * 16), "CONFIG_HMAC_SECRET_MISSING"), ("odd key", ("h" * 16, "k" * 17), "CONFIG_FPE_KEY_INVALID_LENGTH"), ("no key", ("h" * 16, " "), "CONFIG_FPE_KEY_MISSING")],
)
_checked("guardrail_verdicts", lambda given: config.check_guardrails(**given), [("default", {}, "OK"), ("rate", {"max_batch_error_rate": 1.5}, "CONFIG_GUARDRAIL_OUT_OF_RANGE"), ("rows", {"max_target_rows": -1}, "CONFIG_GUARDRAIL_OUT_OF_RANGE"), ("heap", {"heap_warning_percent": 0}, "CONFIG_GUARDRAIL_OUT_OF_RANGE")])
_checked("output_path_verdicts", lambda raw: config.check_output_path(raw, "out", Path("/base")), [("inside", "a/b", "OK"), ("above", "../x", "CONFIG_OUTPUT_PATH_TRAVERSAL"), ("absolute", "/etc/x", "CONFIG_OUTPUT_PATH_TRAVERSAL"), ("blank", "", "CONFIG_OUTPUT_PATH_BLANK"), ("nul", "a\0", "CONFIG_OUTPUT_PATH_INVALID")])
_checked("compression_verdicts", lambda pair: config.check_compression(*pair), [("gz", ("a.sql.gz", "GZIP"), "OK"), ("zst", ("a.sql.zst", "zstd"), "OK"), ("none", ("a.sql", "NONE"), "OK"), ("other ending", ("a.sql.gz", "NONE"), "CONFIG_SINK_COMPRESSION_EXTENSION_MISMATCH"), ("no ending", ("a.sql", "GZIP"), "CONFIG_SINK_COMPRESSION_EXTENSION_MISMATCH")])
_checked("sink_verdicts", lambda given: make_sink(given[0], **given[1]), [("null", ("NULL", {}), "OK"), ("parquet", ("PARQUET", {"folder": "x"}), "OK"), ("dump without path", ("DUMP", {}), "CONFIG_OUTPUT_PATH_BLANK"), ("unknown", ("TAPE", {}), "CONFIG_SINK_TYPE"), ("jdbc elsewhere", ("JDBC", {"url": "jdbc:h2:mem"}), "CONFIG_JDBC_URL_INVALID"), ("write before open", ("NULL", {}), "OK")])
_checked("unopened_sink_verdicts", lambda sink: sink.write("t", None), [("none", NoSink(), "SINK_NOT_OPEN"), ("parquet", ParquetSink("x"), "SINK_NOT_OPEN")])
_checked("quasi_id_verdicts", kanon.parse_quasi_id, [("one", "t:a", "OK"), ("two", " t : a , b", "OK"), ("no table", ":a", "AUDIT_QUASI_ID_SYNTAX"), ("no column", "t:", "AUDIT_QUASI_ID_SYNTAX"), ("no colon", "t", "AUDIT_QUASI_ID_SYNTAX")])

_FILE = "extraction: {{tables: [{{table: orders}}]{0}}}\nanonymization: {{tables: [{{table: customer, columns: [{1}]}}]}}"
_checked(
    "rule_file_verdicts",
    lambda text: config.check_structure(config.parse_rules(text)),
    [
        ("right", _FILE.format("", "{name: c_name, strategy: hash}"), "OK"),
        ("no tables", "extraction: {tables: []}", "CONFIG_EXTRACTION_TABLES_EMPTY"),
        ("negative depth", _FILE.format(", fk_depth: -1", "{name: a, strategy: KEEP}"), "CONFIG_EXTRACTION_FK_DEPTH_INVALID"),
        ("unknown strategy", _FILE.format("", "{name: a, strategy: BURN}"), "CONFIG_UNKNOWN_VALUE"),
        ("fake without type", _FILE.format("", "{name: a, strategy: FAKE}"), "CONFIG_STRATEGY_REQUIRES_TYPE"),
        ("json without paths", _FILE.format("", "{name: a, strategy: FAKE, type: JSONB}"), "CONFIG_JSONB_REQUIRES_JSON_PATHS"),
        ("json in json", _FILE.format("", "{name: a, strategy: FAKE, type: JSONB, json_paths: [{path: $.x, strategy: FAKE, type: JSONB}]}"), "CONFIG_JSONB_NESTED"),
        ("no yaml", "a: [", "CONFIG_UNREADABLE"),
        ("a list", "- a", "CONFIG_UNREADABLE"),
    ],
)

_RULE_CASES = [
    ("one key spreads", [ColumnRule("customer", "c_custkey", Strategy.FPE_ID)], (), "OK"),
    ("two strategies", [ColumnRule("customer", "c_custkey", Strategy.FPE_ID), ColumnRule("orders", "o_custkey", Strategy.HASH)], (), "CONFIG_FK_PROPAGATION_STRATEGY_CONFLICT"),
    ("keep against hash", [ColumnRule("customer", "c_custkey", Strategy.HASH), ColumnRule("orders", "o_custkey", Strategy.KEEP)], (), "CONFIG_FK_PROPAGATION_STRATEGY_CONFLICT"),
    ("masked key", [ColumnRule("customer", "c_custkey", Strategy.MASK)], (), "CONFIG_FK_PROPAGATION_INTEGRITY_BREAKING"),
    ("nullified both", [ColumnRule("customer", "c_custkey", Strategy.NULLIFY), ColumnRule("orders", "o_custkey", Strategy.NULLIFY)], (), "OK"),
    ("fake without link", [ColumnRule("customer", "c_custkey", Strategy.FAKE, SemanticType.EMAIL)], (), "CONFIG_FK_PROPAGATION_FAKE_REQUIRES_LINK"),
    ("fake with link", [ColumnRule("customer", "c_custkey", Strategy.FAKE, SemanticType.EMAIL)], (LinkedColumns("k", (("customer", "c_custkey"), ("orders", "o_custkey"))),), "OK"),
]


@query(_values("given, verdict", [(c[0], c[3]) for c in _RULE_CASES]))
def propagation_verdicts(spark, sf_dir):
    cat = catalog(source(spark, sf_dir, *STAR))
    return _rows(spark, [(name, verdict(lambda r=rules, x=linked: propagate(RuleSet(rules=tuple(r), linked=x), cat))) for name, rules, linked, _ in _RULE_CASES], "given string, verdict string")


_NAME_CASES = [
    ("right", ExtractTable("orders"), ColumnRule("customer", "c_name", Strategy.HASH), "OK"),
    ("other case", ExtractTable("ORDERS"), ColumnRule("Customer", "C_NAME", Strategy.HASH), "OK"),
    ("unknown table", ExtractTable("order"), ColumnRule("customer", "c_name", Strategy.HASH), "CONFIG_UNKNOWN_TABLE"),
    ("unknown column", ExtractTable("orders"), ColumnRule("customer", "c_nam", Strategy.HASH), "CONFIG_UNKNOWN_COLUMN"),
    ("wrong type", ExtractTable("orders"), ColumnRule("orders", "o_custkey", Strategy.FPE_UUID), "CONFIG_STRATEGY_INCOMPATIBLE"),
]


@query(_values("given, verdict", [(c[0], c[3]) for c in _NAME_CASES]))
def schema_verdicts(spark, sf_dir):
    cat = catalog(source(spark, sf_dir, *STAR))
    return _rows(spark, [(name, verdict(lambda t=table, r=rule: compiled(RuleSet((t,), (r,)), cat, SECRETS, True))) for name, table, rule, _ in _NAME_CASES], "given string, verdict string")


@query(f"SELECT c_custkey, {sql_hmac('c_name')} AS c_name, c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer")
def rule_names_any_case(spark, sf_dir):
    """Rules in any case apply to the columns they mean."""
    src = source(spark, sf_dir, *STAR)
    given = RuleSet((ExtractTable("CUSTOMER"),), (ColumnRule("CUSTOMER", "C_NAME", Strategy.HASH), ColumnRule("Customer", "c_AcctBal", Strategy.NULLIFY)))
    rules, _ = compiled(given, catalog(src), SECRETS)
    return pseudonymized(src.scan("customer"), "customer", rules, SECRETS)


@query("""SELECT event_id, '{"k":"' || substr(CAST(json_extract(props, '$.k') AS VARCHAR), 1, 1) || '***"}' AS props FROM events""")
def jsonb_column_rule(spark, sf_dir):
    """A JSONB rule dispatches its leaves through the projection."""
    rules = RuleSet(rules=(ColumnRule("events", "props", Strategy.FAKE, SemanticType.JSONB, (JsonPath("$.k", Strategy.MASK),)),))
    return pseudonymized(source(spark, sf_dir, "events").scan("events").select("event_id", "props"), "events", rules, SECRETS)


_checked("fake_type_verdicts", lambda kind: fake(F.lit("x"), kind, SECRETS), [("email", SemanticType.EMAIL, "OK"), ("json", SemanticType.JSONB, "CONFIG_FAKE_TYPE")])


@query(f"SELECT count(DISTINCT o_orderkey) AS n_keys, count(DISTINCT o_orderkey) AS n_ids, CAST(0 AS BIGINT) AS n_outside, CAST(0 AS BIGINT) AS n_unchanged FROM orders")
def fpe_large_ids(spark, sf_dir):
    """Ids beyond 31 bits: one to one, within 18 digits, and none stays what it was."""
    big = F.col("o_orderkey") + F.lit(10**12)
    ids = source(spark, sf_dir, "orders").scan("orders").select(big.alias("k"), encrypt_id(big, SECRETS).alias("id"))
    return ids.agg(F.countDistinct("k").alias("n_keys"), F.countDistinct("id").alias("n_ids"), F.count_if((F.col("id") < 0) | (F.col("id") > ID_MAX)).alias("n_outside"), F.count_if(F.col("id") == F.col("k")).alias("n_unchanged"))


@query("SELECT count(DISTINCT c_custkey) AS n_keys, count(DISTINCT c_custkey) AS n_ids, min(c_custkey) >= 0 AS inside, TRUE AS repeatable FROM customer")
def fpe_small_ids(spark, sf_dir):
    """Ids within 31 bits: one to one, in range, and the same on every call."""
    ids = source(spark, sf_dir, "customer").scan("customer").select(F.col("c_custkey").alias("k"), encrypt_id(F.col("c_custkey"), SECRETS).alias("id"), encrypt_id(F.col("c_custkey").cast("string"), SECRETS).alias("again"))
    return ids.agg(F.countDistinct("k").alias("n_keys"), F.countDistinct("id").alias("n_ids"), F.bool_and(F.col("id").between(0, INT_MAX)).alias("inside"), F.bool_and(F.col("id") == F.col("again")).alias("repeatable"))


# --- scans, graph, extraction ---------------------------------------------------------------------


@query("SELECT CAST(ceil(count(*) / 700) AS BIGINT) AS chunks, count(*) AS n, least(700, count(*)) AS largest, TRUE AS ordered FROM supplier WHERE s_acctbal > 0")
def chunked_scan(spark, sf_dir):
    """Rows handed over in chunks of at most 700, in order of the key."""
    sizes, last, ordered = [], [None], [True]

    def take(rows):
        sizes.append(len(rows))
        for r in rows:
            ordered[0] &= last[0] is None or last[0] < r.s_suppkey
            last[0] = r.s_suppkey

    n = source(spark, sf_dir, "supplier").chunks("supplier", take, "s_acctbal > 0", 700, "s_suppkey")
    return _rows(spark, [(len(sizes), n, max(sizes, default=0), ordered[0])], "chunks long, n long, largest long, ordered boolean")


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS falls FROM orders")
def ordered_scan(spark, sf_dir):
    """A scan in order of the key: no row is below the one before it."""
    df = source(spark, sf_dir, "orders").scan("orders", order_by="o_orderkey").select("o_orderkey", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part"))
    within = df.withColumn("fall", F.col("o_orderkey") < F.lag("o_orderkey").over(Window.partitionBy("part").orderBy("at")))
    parts = within.groupBy("part").agg(F.count("*").alias("n"), F.count_if("fall").alias("falls"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))
    across = parts.withColumn("fall", F.col("low") < F.lag("high").over(Window.orderBy("part")))  # a row for each partition
    return across.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.coalesce(F.sum("falls"), F.lit(0)) + F.count_if("fall")).alias("falls"))


@query("SELECT TRUE AS same, TRUE AS key_counts, TRUE AS column_counts")
def schema_fingerprint(spark, sf_dir):
    """The fingerprint of a schema is stable, and a dropped foreign key or column changes it."""
    cat = catalog(source(spark, sf_dir, *STAR))
    orders = cat.table("orders")
    without = lambda t: fingerprint(Catalog(cat.tables | {"orders": t}))
    marks = (fingerprint(catalog(source(spark, sf_dir, *STAR))), without(replace(orders, foreign_keys=())), without(replace(orders, columns=orders.columns[1:])))
    own = fingerprint(cat)
    return _rows(spark, [(own == marks[0], own != marks[1], own != marks[2])], "same boolean, key_counts boolean, column_counts boolean")


def _looped(spark, sf_dir) -> Catalog:
    """The star with two more keys: customers refer to customers, and nations to suppliers, who refer to nations."""
    cat = catalog(source(spark, sf_dir, *STAR))
    more = {"customer": ForeignKey("customer", ("c_custkey",), "customer", ("c_custkey",)), "nation": ForeignKey("nation", ("n_nationkey",), "supplier", ("s_suppkey",))}
    return Catalog({n: replace(t, foreign_keys=t.foreign_keys + ((more[n],) if n in more else ())) for n, t in cat.tables.items()})


@query(_values("table", [("customer",), ("nation",), ("supplier",)]))
def key_cycles(spark, sf_dir):
    return _rows(spark, [(t,) for t in graph.cyclic(_looped(spark, sf_dir))], "table string")


@query(_values("depth, table", [(1, "orders"), (1, "part"), (1, "supplier"), (2, "customer"), (2, "nation"), (2, "orders"), (2, "part"), (2, "supplier"), (9, "customer"), (9, "nation"), (9, "orders"), (9, "part"), (9, "region"), (9, "supplier")]))
def key_ancestors(spark, sf_dir):
    cat = catalog(source(spark, sf_dir, *STAR))
    return _rows(spark, [(d, t) for d in (1, 2, 9) for t in graph.ancestors(cat, "lineitem", d)], "depth int, table string")


@query(_values("place, table", [(1, "region"), (2, "nation"), (3, "orders"), (4, "lineitem"), (5, "unknown")]))
def configured_order(spark, sf_dir):
    order = graph.configured_order(catalog(source(spark, sf_dir, *STAR)), ["lineitem", "unknown", "orders", "region", "nation"])
    return _rows(spark, list(enumerate(order, 1)), "place int, table string")


@query(f"WITH o AS (SELECT * FROM orders WHERE {SEED}), s AS (SELECT * FROM supplier WHERE s_acctbal > 9000) SELECT 'orders' AS \"table\", count(*) AS n FROM o UNION ALL SELECT 'supplier', count(*) FROM s UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o) OR l_suppkey IN (SELECT s_suppkey FROM s)")
def configured_children(spark, sf_dir):
    """Children are followed from the configured tables only; a table without a key that two of them reach has each row once."""
    src = source(spark, sf_dir, *STAR)
    rules = RuleSet((ExtractTable("orders", SEED), ExtractTable("supplier", "s_acctbal > 9000")), fk_depth=2)
    found = Extraction(src, catalog(src), rules, scope=ChildScope.CONFIGURED, parents=False)
    frames = found.frames()
    return _rows(spark, [(t, df.count()) for t, df in frames.items()], "table string, n long")


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def children_of_every_parent(spark, sf_dir):
    """Whole tables as seeds: their rows are read as they are."""
    src = source(spark, sf_dir, "nation", "customer")
    rules = RuleSet((ExtractTable("nation"),), fk_depth=1)
    rows = Extraction(src, catalog(src), rules, parents=False).rows("customer")
    return rows.join(src.frames["nation"], F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


# --- runs, plans, policies ------------------------------------------------------------------------


def _run(spark, sf_dir, **options) -> tuple[Plan, Outcome, RuleSet, Extraction]:
    src = source(spark, sf_dir, *STAR)
    cat = catalog(src)
    given = RuleSet((ExtractTable("orders", SEED),), (ColumnRule("customer", "c_name", Strategy.HASH), ColumnRule("orders", "o_orderpriority", Strategy.MASK)), fk_depth=4)
    rules, _ = compiled(given, cat, SECRETS)
    found = Extraction(src, cat, rules)
    plan = planned(src, cat, rules, PlanMode.EXACT, extraction=found)
    outcome = execute(src, cat, rules, SECRETS, NoSink(), plan, extraction=found, **options)
    return plan, outcome, rules, found


_PARTS = {"orders": "o", "lineitem": "l", "customer": "c", "supplier": "s", "part": "p", "nation": "n", "region": "r"}
_EACH = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS inserted FROM {a}" for t, a in _PARTS.items())


@query(f"{_CLOSURE}, k AS ({_EACH}) SELECT \"table\", inserted, CAST(0 AS BIGINT) AS conflicts, CAST(0 AS BIGINT) AS refused FROM k UNION ALL SELECT '(all)', CAST(sum(inserted) AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM k")
def run_outcome(spark, sf_dir):
    """A whole run into no sink: what each table wrote, and all of them."""
    _, outcome, _, found = _run(spark, sf_dir)
    found.release()
    rows = [(t.table, t.inserted, t.conflicts, t.batch_errors) for t in outcome.tables]
    return _rows(spark, [*rows, ("(all)", outcome.total("inserted"), outcome.total("conflicts"), outcome.total("batch_errors"))], "table string, inserted long, conflicts long, refused long")


@query(f"SELECT 'customer' AS \"table\", 'c_name' AS \"column\", 'HASH' AS strategy, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE {SEED}) UNION ALL SELECT 'orders', 'o_orderpriority', 'MASK', count(*) FROM orders WHERE {SEED} UNION ALL SELECT '(all)', 'covered', NULL, 2")
def run_coverage(spark, sf_dir):
    """Columns that the run rewrote, with the rows each strategy went over."""
    _, outcome, _, found = _run(spark, sf_dir)
    found.release()
    return _rows(spark, [*((*k, n) for k, n in outcome.strategies.items()), ("(all)", "covered", None, outcome.covered_columns)], "table string, column string, strategy string, n long")


@query("SELECT CAST(count(*) FILTER (WHERE o_orderstatus <> 'P') AS BIGINT) AS inserted, CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS refused, 'WRITE_BATCH_ERROR_RATE' AS at_rate_zero FROM orders")
def run_with_refused_rows(spark, sf_dir):
    """A run that stands some refused rows, and one that stands none."""
    src = source(spark, sf_dir, "orders")
    cat = catalog(src)
    rules = RuleSet((ExtractTable("orders"),))
    check = lambda table: F.col("o_orderstatus") != "P"
    outcome = execute(src, cat, rules, SECRETS, NoSink(), tolerance=Tolerance(0.9, check=check))
    strict = verdict(lambda: execute(src, cat, rules, SECRETS, NoSink(), tolerance=Tolerance(0.0, check=check)))
    return _rows(spark, [(outcome.total("inserted"), outcome.total("batch_errors"), strict)], "inserted long, refused long, at_rate_zero string")


@query("SELECT CAST(0 AS BIGINT) AS left_over")
def released_key_tables(spark, sf_dir):
    """A run deletes the key tables it has written."""
    _, _, _, found = _run(spark, sf_dir)
    paths = list(found.scratch)
    found.release()
    folder = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    there = [p for p in paths if folder(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder(p))]
    return _rows(spark, [(len(there) if paths else -1,)], "left_over long")


@query("SELECT CAST(n_nationkey AS VARCHAR) || chr(9) || n_name || chr(9) || CAST(n_regionkey AS VARCHAR) AS line FROM nation")
def dump_lines(spark, sf_dir):
    """COPY rows as compressed text parts, written by all executors and read again."""
    path = f"{shared_dir(spark)}/lamina/dump-{uuid.uuid4().hex}"
    dump_parts(source(spark, sf_dir, "nation").scan("nation"), path)
    lines = [r.value for r in spark.read.text(path).collect()]  # 25 rows
    discard(spark, path)
    return _rows(spark, [(x,) for x in lines], "line string")


@query(_values("statement", [('INSERT INTO "public"."t" ("id", "v") SELECT "id", "v" FROM "public"."s" ON CONFLICT DO NOTHING',)]))
def conflict_safe_insert(spark, sf_dir):
    return _rows(spark, [(staged_insert("public", "t", "s", ["id", "v"]),)], "statement string")


_PLAN = Plan(PlanMode.EXACT, (PlannedTable("a", 10, 0, 0, "direct"), PlannedTable("b", 0, 5, 0, "fk-parent")))
_checked("row_guard_verdicts", lambda most: guard(_PLAN, most), [("no limit", 0, "OK"), ("enough", 15, "OK"), ("too few", 14, "PLAN_MAX_TARGET_ROWS")])


@query(_values("level, subject, text", [("WARN", "a", "2 rows more than planned"), ("WARN", "b", "1 rows fewer than planned"), ("WARN", "b", "1 rows were in the target already"), ("ERROR", "b", "1 rows refused"), ("OK", "all", "0 of 2 tables as planned"), ("OK", "all", "4 parent rows came by foreign keys"), ("WARN", "all", "2 of 16 rows not written (12 %)"), ("WARN", "all", "3 columns look personal and have no rule")]))
def run_insights(spark, sf_dir):
    outcome = Outcome([TableOutcome("a", 12, inserted=12), TableOutcome("b", 0, 4, inserted=2, conflicts=1, batch_errors=1)])
    return _rows(spark, [(i.level, i.subject, i.text) for i in insights(_PLAN, outcome, None, 3)], "level string, subject string, text string")


@query(_values("delta, text", [(0.0, "0%"), (0.3, "+0%"), (-0.3, "-0%"), (12.5, "+12%"), (-100.0, "-100%")]))
def delta_texts(spark, sf_dir):
    return _rows(spark, [(d, delta_text(d)) for d in (0.0, 0.3, -0.3, 12.5, -100.0)], "delta double, text string")


@query(_values("at, line", [(0, "Plan (EXACT): 15 rows"), (1, "table  direct  children  parents  total  origin"), (2, "-----  ------  --------  -------  -----  ---------"), (3, "a      10      0         0        10     direct"), (4, "b      0       0         5        5      fk-parent")]))
def plan_report(spark, sf_dir):
    return _rows(spark, list(enumerate(plan_text(_PLAN).splitlines())), "at int, line string")


@query("SELECT 'customer' AS \"table\", count(*) AS rows, count(DISTINCT c_nationkey) AS classes FROM customer")
def audit_report(spark, sf_dir):
    """The audit's Markdown, read back: its table row."""
    src = source(spark, sf_dir, "customer")
    text = audit_markdown(kanon.audit(src.frames, {"customer": ["c_nationkey"]}))
    cells = [c.strip() for c in next(line for line in text.splitlines() if line.startswith("| customer")).strip("|").split("|")]
    return _rows(spark, [(cells[0], int(cells[2]), int(cells[3]))], "table string, rows long, classes long")


_POLICY = "WITH k AS (SELECT count(*) AS k FROM customer GROUP BY c_nationkey) SELECT least_k, CASE WHEN coalesce((SELECT min(k) FROM k), -1) < least_k THEN 8 ELSE 0 END AS exit_code FROM (VALUES (1), (10), (100000)) AS p(least_k)"


@query(_POLICY)
def audit_policy(spark, sf_dir):
    src = source(spark, sf_dir, "customer")
    return _rows(spark, [(k, kanon.audit(src.frames, {"customer": ["c_nationkey"]}, strict_k=k).exit_code) for k in (1, 10, 100000)], "least_k int, exit_code int")


@query(_values("table, column", [("people", "birth_date"), ("people", "postal_code"), ("staff", "gender")]))
def audit_quasi_ids(spark, sf_dir):
    """Quasi-identifiers of an audit by name, with what a finished run has hidden left out."""
    orders = source(spark, sf_dir, "orders").scan("orders")
    people = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("birth_date"), F.col("o_custkey").alias("postal_code"))
    staff = orders.select(F.col("o_custkey").alias("gender"), F.col("o_custkey").alias("age"))
    src = type(source(spark, sf_dir, "orders"))(spark, {"people": people, "staff": staff})
    from lamina.sources.scan import introspect

    found = kanon.resolve_quasi_ids(introspect(src, {}, []), RuleSet(rules=(ColumnRule("STAFF", "AGE", Strategy.FPE_ID),)))
    return _rows(spark, [(t, c) for t, columns in found.items() for c in columns], "table string, column string")


@query("SELECT count(*) AS total_classes, CAST(sum(k) AS BIGINT) AS total_rows FROM (SELECT count(*) AS k FROM orders GROUP BY o_orderpriority)")
def kanon_rate_of_one(spark, sf_dir):
    """A sampling rate outside 0 to 1 reads every row."""
    df = kanon.sampled(source(spark, sf_dir, "orders").scan("orders"), 5.0)
    return kanon.distribution(kanon.classes(df, ["o_orderpriority"])).select("total_classes", "total_rows")


@query("SELECT count(DISTINCT lower(c_name)) AS entries, 'OK' AS at_a_million, 'ANON_DICTIONARY_OVERFLOW' AS at_one FROM customer")
def dictionary_limit(spark, sf_dir):
    counts = dictionary.entries(source(spark, sf_dir, "customer").frames, RuleSet(rules=(ColumnRule("customer", "c_name", Strategy.FAKE, SemanticType.LAST_NAME),)))
    n = dictionary.usage(counts)["entries"]
    return _rows(spark, [(n, verdict(lambda: dictionary.check_entries(counts)), verdict(lambda: dictionary.check_entries(counts, 1)))], "entries long, at_a_million string, at_one string")


_PREFLIGHT = [("secrets", "OK"), ("guardrails", "FAIL"), ("rules", "OK"), ("keys", "OK"), ("names and types", "FAIL"), ("propagation", "SKIP"), ("filters", "SKIP"), ("reach", "SKIP")]


@query(_values("check, status", _PREFLIGHT))
def preflight_checks(spark, sf_dir):
    """Checks before a run with a wrong rate and an unknown column: what builds on a failed check is skipped."""
    src = source(spark, sf_dir, *STAR)
    rules = RuleSet((ExtractTable("orders", SEED),), (ColumnRule("customer", "c_nam", Strategy.HASH),))
    return _rows(spark, [(c.name, c.status) for c in preflight(src, catalog(src), rules, SECRETS, most_rate=2.0)], "check string, status string")


@query(_values("table, column, strategy", [("customer", "c_custkey", "FPE_ID"), ("orders", "o_custkey", "FPE_ID"), ("nowhere", "X", "KEEP")]))
def resolved_rules(spark, sf_dir):
    given = RuleSet(rules=(ColumnRule("customer", "C_CUSTKEY", Strategy.HASH), ColumnRule("CUSTOMER", "c_custkey", Strategy.FPE_ID), ColumnRule("Orders", "O_CUSTKEY", Strategy.FPE_ID), ColumnRule("nowhere", "X", Strategy.KEEP)))
    rules = resolved(given, catalog(source(spark, sf_dir, *STAR)))
    return _rows(spark, [(r.table, r.column, r.strategy.name) for r in rules.rules], "table string, column string, strategy string")


@query(_values("child, parent", [(str(fk).split("->")[0], str(fk).split("->")[1]) for fk in FOREIGN]))
def foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [tuple(str(fk).split("->")) for fk in catalog(source(spark, sf_dir, *STAR)).foreign_keys()], "child string, parent string")
