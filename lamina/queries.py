"""Registered queries of the engine's own operators, each with SQL for an independent engine where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.config import closest, fit, parse_rules
from lamina.functions import crypto, fake as fakes
from lamina.functions.jsonpath import rewrite
from lamina.functions.mask import mask
from lamina.functions.text import copy_rows
from lamina.model import Catalog, ColumnRule, ForeignKey, LinkedColumns, RuleSet, Secrets, SemanticType, Strategy
from lamina.operators import dictionary, graph, kanon
from lamina.operators.detect import personal_columns, quasi_identifiers
from lamina.operators.extract import Extraction, hierarchy, orphans
from lamina.operators.pseudonymize import pseudonymized, used_strategies
from lamina.operators.rules import propagate
from lamina.plans.planner import compare, estimated_plan, exact_plan, table_counts
from lamina.run import shared_values
from lamina.sources.scan import Source, introspect, logical_type
from lamina.sources.sinks import quarantine
from lamina.streaming import pseudonymized_stream

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels", "conversations"]
KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"], "conversations": ["conv_id", "turn"]}
FOREIGN = [ForeignKey(a, (b,), c, (d,)) for a, b, c, d in (("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"))]
#: Test keys; a deployment brings its own.
SECRETS = Secrets("example-hmac-secret-for-queries-only", "0123456789abcdef", locale="en")
RULES = parse_rules(
    """
extraction:
  fk_depth: 4
  tables:
    - {table: orders, filter: "o_totalprice > 400000"}
anonymization:
  tables:
    - table: customer
      columns:
        - {name: c_custkey, strategy: FPE_ID}
        - {name: c_name, strategy: FAKE, type: LAST_NAME}
        - {name: c_acctbal, strategy: NULLIFY}
    - table: orders
      columns:
        - {name: o_orderpriority, strategy: MASK}
        - {name: o_orderstatus, strategy: HASH}
    - table: events
      columns:
        - name: props
          strategy: FAKE
          type: JSONB
          json_paths: [{path: $.k, strategy: FPE_ID}]
"""
)


def source(spark: SparkSession, sf_dir: str, *names: str) -> Source:
    return Source.parquet(spark, sf_dir, list(names or TABLES))


def catalog(src: Source) -> Catalog:
    return introspect(src, KEYS, [fk for fk in FOREIGN if fk.from_table in src.frames and fk.to_table in src.frames], {("events", "props"): "jsonb"})


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- SQL pieces -----------------------------------------------------------------------------------


def sql_hmac(value: str, secret: str = SECRETS.hmac_secret) -> str:
    key = secret.encode().ljust(64, b"\0")
    inner, outer = (bytes(b ^ p for b in key).hex() for p in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({value}))))"


def sql_long(h: str, start: int = 1, length: int = 16) -> str:
    u = f"CAST(CAST('0x' || substr({h}, {start}, {length}) AS UBIGINT) AS HUGEINT)"
    return f"(CASE WHEN {u} >= 9223372036854775808 THEN {u} - 18446744073709551616 ELSE {u} END)" if length == 16 else u


def sql_mod(x: str, n: int) -> str:
    return f"((({x}) % {n} + {n}) % {n})"


def sql_shift(x: str, k: int) -> str:
    return f"((({x}) - {sql_mod(x, 2**k)}) // {2**k})"


def sql_pick(table: dict, x: str) -> str:
    options = fakes.words(table, SECRETS.locale)
    return "[" + ", ".join("'" + o.replace("'", "''") + "'" for o in options) + f"][CAST(1 + {sql_mod(x, len(options))} AS BIGINT)]"


def _seeded(table: str, key: str, value: str, columns: str) -> str:
    h = sql_hmac(f"lower({value})")
    return f"WITH h AS (SELECT {key}, {h} AS h FROM {table} WHERE {value} IS NOT NULL), s AS (SELECT {key}, h, {sql_long('h')} AS s, {sql_long('h', 17, 15)} AS m FROM h) SELECT {key}, {columns} FROM s"


# --- queries --------------------------------------------------------------------------------------

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


PSEUDO_ORDERS = RuleSet(rules=(ColumnRule("orders", "o_orderstatus", Strategy.HASH), ColumnRule("orders", "o_orderpriority", Strategy.MASK), ColumnRule("orders", "o_custkey", Strategy.HASH), ColumnRule("orders", "o_totalprice", Strategy.NULLIFY)))


@query(f"SELECT o_orderkey, {sql_hmac('CAST(o_custkey AS VARCHAR)')} AS o_custkey, {sql_hmac('o_orderstatus')} AS o_orderstatus, CAST(NULL AS DOUBLE) AS o_totalprice, o_orderdate, substr(o_orderpriority, 1, 1) || '***' AS o_orderpriority FROM orders WHERE o_totalprice > 100000")
def pseudonymized_orders(spark, sf_dir):
    rules = replace(PSEUDO_ORDERS, rules=PSEUDO_ORDERS.rules)
    df = source(spark, sf_dir, "orders").scan("orders", "o_totalprice > 100000").withColumn("o_custkey", F.col("o_custkey").cast("string"))
    return pseudonymized(df, "orders", rules, SECRETS)


@query("SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 200000")
def scan_filter_orders(spark, sf_dir):
    return source(spark, sf_dir, "orders").scan("orders", "o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 200000")


@query("SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def scan_subquery_filter(spark, sf_dir):
    return source(spark, sf_dir, "orders", "customer").scan("orders", "o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")


@query("SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity > 45 AND l_suppkey IS NOT NULL")
def distinct_fk_values(spark, sf_dir):
    return source(spark, sf_dir, "lineitem").distinct_values("lineitem", ["l_suppkey"], "l_quantity > 45")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL")
def distinct_fk_tuples(spark, sf_dir):
    return source(spark, sf_dir, "lineitem").distinct_values("lineitem", ["l_partkey", "l_suppkey"])


@query("SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def key_lookup(spark, sf_dir):
    src = source(spark, sf_dir, "orders", "customer")
    return src.by_keys("customer", ["c_custkey"], src.distinct_values("orders", ["o_custkey"], "o_totalprice > 300000"))


@query("SELECT * FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 50)")
def composite_key_lookup(spark, sf_dir):
    src = source(spark, sf_dir, "lineitem")
    return src.by_keys("lineitem", ["l_partkey", "l_suppkey"], src.distinct_values("lineitem", ["l_partkey", "l_suppkey"], "l_quantity >= 50"))


@query(f"SELECT c_custkey, {sql_hmac('c_name')} AS hashed FROM customer")
def hash_customer_name(spark, sf_dir):
    return source(spark, sf_dir, "customer").scan("customer").select("c_custkey", crypto.hmac_hex(F.col("c_name"), SECRETS).alias("hashed"))


_ODD = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN '' ELSE o_orderstatus END AS v FROM orders"


@query(f"SELECT o_orderkey, CASE WHEN v IS NULL THEN NULL ELSE {sql_hmac('v')} END AS hashed FROM ({_ODD})")
def hash_null_and_empty(spark, sf_dir):
    source(spark, sf_dir, "orders").register()
    return spark.sql(_ODD).select("o_orderkey", crypto.hmac_hex(F.col("v"), SECRETS).alias("hashed"))


@query(f"SELECT c_custkey, CAST({sql_long(sql_hmac('lower(c_name)'))} AS BIGINT) AS seed FROM customer")
def hmac_seed(spark, sf_dir):
    return source(spark, sf_dir, "customer").scan("customer").select("c_custkey", crypto.seed(F.col("c_name"), SECRETS).alias("seed"))


@query(f"SELECT o_orderkey, substr({sql_hmac('coalesce(v, ' + chr(39) + 'null' + chr(39) + ')')}, 1, 8) AS mark FROM ({_ODD})")
def fingerprint_values(spark, sf_dir):
    source(spark, sf_dir, "orders").register()
    return spark.sql(_ODD).select("o_orderkey", crypto.fingerprint(F.col("v"), SECRETS).alias("mark"))


@query(f"WITH h AS (SELECT c_custkey, {sql_hmac('lower(c_name)')} AS h FROM customer) SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || CASE substr(h, 17, 1) WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8' WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9' WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h")
def uuid_pseudonym(spark, sf_dir):
    return source(spark, sf_dir, "customer").scan("customer").select("c_custkey", crypto.uuid_of(F.col("c_name"), SECRETS).alias("uuid"))


@query()
def fpe_id_keys(spark, sf_dir):
    return source(spark, sf_dir, "customer").scan("customer").select("c_custkey", crypto.encrypt_id(F.col("c_custkey"), SECRETS).alias("id"))


@query("SELECT count(DISTINCT l_orderkey) AS n_keys, count(DISTINCT l_orderkey) AS n_ids, CAST(0 AS BIGINT) AS n_outside, count(*) FILTER (WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS n_orphans FROM lineitem")
def fpe_id_fk_preserved(spark, sf_dir):
    """Encrypted keys stay as many, in range, and still find their parents; a repeated key is encrypted once."""
    src = source(spark, sf_dir, "orders", "lineitem")
    parents = src.scan("orders").select(crypto.encrypt_id(F.col("o_orderkey"), SECRETS).alias("p"))
    keys = src.scan("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("k"))
    keys = keys.select("k", crypto.encrypt_id(F.col("l_orderkey"), SECRETS).alias("id"))
    joined = keys.join(parents, keys["id"] == parents["p"], "left")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("k"))), F.lit(0))
    return joined.agg(F.count("*").alias("n_keys"), F.countDistinct("id").alias("n_ids"), total((F.col("id") < 0) | (F.col("id") > crypto.INT_MAX)).alias("n_outside"), total(F.col("p").isNull()).alias("n_orphans"))


_PHONES = "SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '12345' WHEN 2 THEN '' ELSE '06' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS v FROM customer"
_IPS = "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '1.2' WHEN 2 THEN 'none' ELSE CAST(c_custkey % 256 AS VARCHAR) || '.7.' || CAST(c_nationkey AS VARCHAR) || '.9' END AS v FROM customer"


def _masked(spark, sf_dir, text: str, kind):
    source(spark, sf_dir, "customer").register()
    return spark.sql(text.replace("VARCHAR", "STRING")).select("c_custkey", mask(F.col("v"), kind).alias("masked"))


@query(f"SELECT c_custkey, CASE WHEN length(v) <= 5 THEN repeat('*', length(v)) ELSE substr(v, 1, 3) || repeat('*', length(v) - 5) || right(v, 2) END AS masked FROM ({_PHONES})")
def mask_phone(spark, sf_dir):
    return _masked(spark, sf_dir, _PHONES, SemanticType.PHONE)


@query(f"SELECT c_custkey, CASE WHEN v IS NULL THEN NULL WHEN contains(v, '.') THEN split_part(v, '.', 1) || '.' || split_part(v, '.', 2) || '.*.*' ELSE '*.*.*.*' END AS masked FROM ({_IPS})")
def mask_ip(spark, sf_dir):
    return _masked(spark, sf_dir, _IPS, SemanticType.IP_ADDRESS)


@query(f"SELECT c_custkey, CASE WHEN v = '' THEN '' ELSE substr(v, 1, 1) || '***' END AS masked FROM ({_PHONES})")
def mask_default(spark, sf_dir):
    return _masked(spark, sf_dir, _PHONES, None)


def _fake(kind: SemanticType):
    def run(spark, sf_dir):
        return source(spark, sf_dir, "customer").scan("customer").select("c_custkey", fakes.fake(F.col("c_name"), kind, SECRETS).alias("fake"))

    return run


def _digit(x: str, n: int) -> str:
    return f"lpad(CAST({sql_mod(x, 10**n)} AS VARCHAR), {n}, '0')"


_IBAN_BODY = f"{_digit('s', 12)} || {_digit('m', 11)}"
for _kind, _sql in {
    SemanticType.IP_ADDRESS: "CAST(1 + {} AS VARCHAR) || '.' || CAST({} AS VARCHAR) || '.' || CAST({} AS VARCHAR) || '.' || CAST(1 + {} AS VARCHAR)".format(sql_mod(sql_shift("s", 24), 223), sql_mod(sql_shift("s", 16), 256), sql_mod(sql_shift("s", 8), 256), sql_mod("s", 254)),
    SemanticType.EMAIL: f"lower({sql_pick(fakes.FIRST, 's')}) || '.' || lower({sql_pick(fakes.LAST, sql_shift('s', 16))}) || '.' || substr(h, 11, 6) || '@' || {sql_pick(fakes.DOMAINS, sql_shift('s', 32))}",
    SemanticType.FIRST_NAME: sql_pick(fakes.FIRST, "s"),
    SemanticType.LAST_NAME: sql_pick(fakes.LAST, "s"),
    SemanticType.PHONE: f"'555-' || substr({_digit('m', 9)}, 1, 3) || '-' || substr({_digit('m', 9)}, 4, 4)",
    SemanticType.ADDRESS: f"CAST(1 + {sql_mod('m', 199)} AS VARCHAR) || ' ' || {sql_pick(fakes.STREETS, 's')} || ', ' || {_digit(sql_shift('m', 12), 5)} || ' ' || {sql_pick(fakes.CITIES, sql_shift('s', 24))}",
    SemanticType.IBAN: f"'FR' || lpad(CAST(98 - CAST({_IBAN_BODY} || '152700' AS HUGEINT) % 97 AS VARCHAR), 2, '0') || {_IBAN_BODY}",
}.items():
    query(_seeded("customer", "c_custkey", "c_name", f"{_sql} AS fake"), f"fake_{_kind.name.lower()}")(_fake(_kind))


@query("SELECT s_suppkey, CAST(NULL AS VARCHAR) AS s_name, s_nationkey, s_acctbal FROM supplier")
def nullify_keep(spark, sf_dir):
    rules = RuleSet(rules=(ColumnRule("supplier", "s_name", Strategy.NULLIFY), ColumnRule("supplier", "s_acctbal", Strategy.KEEP)))
    return pseudonymized(source(spark, sf_dir, "supplier").scan("supplier"), "supplier", rules, SECRETS)


_DOCS = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'not json' WHEN 2 THEN '[1]' WHEN 3 THEN '{"a":{"b":' || user_id || '},"c":"x"}' WHEN 4 THEN '{"a":7,"c":null}' ELSE '{"a":{"b":null,"d":[1,true]},"c":"' || event_type || '"}' END AS doc FROM events"""


@query(f"""SELECT event_id, CASE event_id % 6 WHEN 3 THEN '{{"a":{{"b":"' || substr(CAST(user_id AS VARCHAR), 1, 1) || '***"}},"c":"' || {sql_hmac("'x'")} || '"}}' WHEN 5 THEN '{{"a":{{"b":null,"d":[1,true]}},"c":"' || {sql_hmac('event_type')} || '"}}' ELSE doc END AS doc FROM (SELECT e.*, d.doc FROM events e JOIN ({_DOCS}) d USING (event_id))""")
def json_leaf_rewrite(spark, sf_dir):
    source(spark, sf_dir, "events").register()
    paths = [("$.a.b", lambda v: (mask(v), False)), ("c", lambda v: (crypto.hmac_hex(v, SECRETS), False))]
    return spark.sql(_DOCS).select("event_id", rewrite(F.col("doc"), paths).alias("doc"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, TRUE AS is_number FROM events""")
def json_leaf_type_kept(spark, sf_dir):
    """KEEP through the JSON path: a numeric leaf stays a number."""
    df = source(spark, sf_dir, "events").scan("events").select("event_id", rewrite(F.col("props"), [("$.k", lambda v: (v, False))]).alias("doc"))
    v = F.try_parse_json("doc")
    return df.select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.schema_of_variant(F.variant_get(v, "$.k", "variant")).isin("BIGINT").alias("is_number"))


# --- extraction -----------------------------------------------------------------------------------

SEED = "o_totalprice > 400000"
STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def extraction(spark, sf_dir, tables=STAR, seed=("orders", SEED), depth=4, **options) -> Extraction:
    src = source(spark, sf_dir, *tables)
    rules = RuleSet(extract=(replace(RULES.extract[0], table=seed[0], filter=seed[1]),), fk_depth=depth)
    return Extraction(src, catalog(src), rules, **options)


_O = f"SELECT * FROM orders WHERE {SEED}"
_CLOSURE = f"""WITH o AS ({_O}), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)),
c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o)), s AS (SELECT * FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM l)),
p AS (SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM l)), n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c UNION SELECT s_nationkey FROM s)),
r AS (SELECT * FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n))"""
_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {a}" for t, a in (("orders", "o"), ("lineitem", "l"), ("customer", "c"), ("supplier", "s"), ("part", "p"), ("nation", "n"), ("region", "r")))


@query(f"SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE {SEED})")
def fk_parents_1(spark, sf_dir):
    return extraction(spark, sf_dir, depth=1, children=False).rows("customer")


@query(f"SELECT n.* FROM nation n WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE {SEED}))")
def fk_parent_closure(spark, sf_dir):
    return extraction(spark, sf_dir, children=False).rows("nation")


@query(f"SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE {SEED})")
def fk_children_1(spark, sf_dir):
    return extraction(spark, sf_dir, depth=1, parents=False).rows("lineitem")


@query("WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)) SELECT 'orders' AS \"table\", count(*) AS n FROM o UNION ALL SELECT 'customer', count(*) FROM c UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)) UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) UNION ALL SELECT 'nation', count(*) FROM nation WHERE n_regionkey = 2")
def fk_child_closure(spark, sf_dir):
    return table_counts(extraction(spark, sf_dir, seed=("nation", "n_regionkey = 2"), parents=False).frames())


@query(f"{_CLOSURE} {_COUNTS}")
def subset_closure_counts(spark, sf_dir):
    return table_counts(extraction(spark, sf_dir).frames())


@query(f"{_CLOSURE} SELECT * FROM s")
def subset_closure_suppliers(spark, sf_dir):
    return extraction(spark, sf_dir).rows("supplier")


@query("SELECT 'lineitem' AS child, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'orders', 0 UNION ALL SELECT 'customer', 0 UNION ALL SELECT 'supplier', 0 UNION ALL SELECT 'nation', 0")
def subset_has_no_orphans(spark, sf_dir):
    found = extraction(spark, sf_dir)
    frames = found.frames()
    per = [orphans(frames[fk.from_table], fk, frames[fk.to_table]).select(F.lit(fk.from_table).alias("child"), F.lit(1).alias("k")) for fk in found.catalog.foreign_keys()]
    children = _rows(spark, [(t,) for t in sorted({fk.from_table for fk in found.catalog.foreign_keys()})], "child string")
    return children.join(reduce(DataFrame.union, per), "child", "left").groupBy("child").agg(F.count("k").alias("n"))


@query("SELECT count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_totalprice < 50000)")
def orphan_check(spark, sf_dir):
    src = source(spark, sf_dir, "orders", "lineitem")
    return orphans(src.scan("lineitem"), FOREIGN[4], src.scan("orders", "o_totalprice < 50000")).agg(F.count("*").alias("n"))


_ACCOUNTS = "SELECT DISTINCT l_suppkey AS tenant, l_returnflag AS account FROM lineitem"
_MOVES = "SELECT l_orderkey AS id, l_linenumber AS line, l_suppkey AS tenant, l_returnflag AS account, l_quantity AS amount FROM lineitem"


@query(f"SELECT * FROM ({_ACCOUNTS}) WHERE (tenant, account) IN (SELECT tenant, account FROM ({_MOVES}) WHERE amount >= 49)")
def composite_fk_parents(spark, sf_dir):
    source(spark, sf_dir, "lineitem").register()
    src = Source(spark, {"accounts": spark.sql(_ACCOUNTS), "moves": spark.sql(_MOVES)})
    cat = introspect(src, {"accounts": ["tenant", "account"]}, [ForeignKey("moves", ("tenant", "account"), "accounts", ("tenant", "account"))])
    return Extraction(src, cat, RuleSet(extract=(replace(RULES.extract[0], table="moves", filter="amount >= 49"),))).rows("accounts")


@query("WITH RECURSIVE t AS (SELECT c_custkey AS id, 0 AS depth FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT CAST(t.id // 2 AS BIGINT), t.depth + 1 FROM t JOIN customer c ON c.c_custkey = t.id WHERE t.depth < 5 AND t.id > 1) SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM t GROUP BY id")
def hierarchy_recursive(spark, sf_dir):
    df = source(spark, sf_dir, "customer").scan("customer").select("c_custkey", F.when(F.col("c_custkey") > 1, F.expr("c_custkey div 2")).alias("parent"), "c_mktsegment")
    return hierarchy(df, "c_custkey", "parent", df.where("c_mktsegment = 'BUILDING'").select("c_custkey"), 5)


@query("VALUES (1, 'region'), (2, 'nation'), (3, 'customer'), (4, 'orders'), (5, 'part'), (6, 'supplier'), (7, 'lineitem')".join(["SELECT col0 AS place, col1 AS \"table\" FROM (", ")"]))
def topological_order(spark, sf_dir):
    order = graph.topological(catalog(source(spark, sf_dir, *STAR)))
    return _rows(spark, list(enumerate(order, 1)), "place int, table string")


# --- plans ----------------------------------------------------------------------------------------


def _plan_frame(spark, plan) -> DataFrame:
    return _rows(spark, [(t.table, t.total, t.origin) for t in plan.tables], "table string, n long, origin string")


_ORIGINS = {"orders": "direct", "lineitem": "fk-child"}


@query(f"{_CLOSURE}, k AS ({_COUNTS}) SELECT \"table\", n, CASE \"table\" WHEN 'orders' THEN 'direct' WHEN 'lineitem' THEN 'fk-child' ELSE 'fk-parent' END AS origin FROM k")
def plan_exact(spark, sf_dir):
    e = extraction(spark, sf_dir)
    return _plan_frame(spark, exact_plan(e.source, e.catalog, RULES, e))


@query("SELECT 'orders' AS \"table\", count(*) AS n, 'direct' AS origin FROM orders UNION ALL SELECT 'lineitem', count(*), 'fk-child' FROM lineitem UNION ALL SELECT 'customer', count(*), 'fk-parent' FROM customer UNION ALL SELECT 'part', count(*), 'fk-parent' FROM part UNION ALL SELECT 'supplier', count(*), 'fk-parent' FROM supplier UNION ALL SELECT 'nation', count(*), 'fk-parent' FROM nation UNION ALL SELECT 'region', count(*), 'fk-parent' FROM region")
def plan_estimate(spark, sf_dir):
    src = source(spark, sf_dir, *STAR)
    return _plan_frame(spark, estimated_plan(src, catalog(src), RULES))


@query(f"{_CLOSURE}, a AS ({_COUNTS}), q AS (SELECT 'orders' AS \"table\", count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem) SELECT \"table\", coalesce(q.n, 0) AS planned, coalesce(a.n, 0) AS actual, CASE WHEN coalesce(q.n, 0) > 0 THEN (coalesce(a.n, 0) - q.n) / q.n * 100 ELSE 0.0 END AS delta_percent FROM q FULL OUTER JOIN a USING (\"table\")")
def plan_vs_actual(spark, sf_dir):
    e = extraction(spark, sf_dir)
    return compare(table_counts({t: e.source.frames[t] for t in ("orders", "lineitem")}), table_counts(e.frames()))


# --- privacy --------------------------------------------------------------------------------------


@query("SELECT c_nationkey, c_mktsegment, count(*) AS k FROM customer GROUP BY ALL")
def kanon_classes(spark, sf_dir):
    return kanon.classes(source(spark, sf_dir, "customer").scan("customer"), ["c_nationkey", "c_mktsegment"])


def _distribution_sql(table: str, columns: str) -> str:
    return f"SELECT count(*) AS total_classes, coalesce(CAST(sum(k) AS BIGINT), 0) AS total_rows, count(*) FILTER (WHERE k = 1) AS singletons, count(*) FILTER (WHERE k BETWEEN 2 AND 4) AS k2to4, count(*) FILTER (WHERE k BETWEEN 5 AND 9) AS k5to9, count(*) FILTER (WHERE k BETWEEN 10 AND 99) AS k10to99, count(*) FILTER (WHERE k >= 100) AS k100plus, coalesce(min(k), -1) AS k_min, coalesce(avg(k), 0.0) AS k_average FROM (SELECT count(*) AS k FROM {table} GROUP BY {columns})"


@query(_distribution_sql("orders", "o_orderdate, o_orderpriority, o_orderstatus"))
def kanon_distribution(spark, sf_dir):
    return kanon.distribution(kanon.classes(source(spark, sf_dir, "orders").scan("orders"), ["o_orderdate", "o_orderpriority", "o_orderstatus"]))


@query(_distribution_sql("(SELECT * FROM customer WHERE c_custkey < 0)", "c_nationkey"))
def kanon_distribution_empty(spark, sf_dir):
    return kanon.distribution(kanon.classes(source(spark, sf_dir, "customer").scan("customer", "c_custkey < 0"), ["c_nationkey"]))


@query("SELECT CAST(x AS VARCHAR) AS c_nationkey, CAST(y AS VARCHAR) AS b FROM (SELECT c_nationkey AS x, CAST(floor(c_acctbal / 100) AS BIGINT) AS y, count(*) AS k FROM customer GROUP BY ALL) WHERE k = 1 ORDER BY x, y LIMIT 20")
def kanon_singletons(spark, sf_dir):
    df = source(spark, sf_dir, "customer").scan("customer").select(F.col("c_nationkey").cast("long").alias("c_nationkey"), F.floor(F.col("c_acctbal") / 100).alias("b"))
    return kanon.singleton_sample(kanon.classes(df, ["c_nationkey", "b"]), ["c_nationkey", "b"])


@query("SELECT 'customer' AS \"table\", CAST(min(k) AS BIGINT) AS k_min, CASE WHEN sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) > 0 THEN 'CRITICAL' WHEN min(k) < 5 THEN 'WARNING' ELSE 'INFO' END AS severity FROM (SELECT count(*) AS k FROM customer GROUP BY c_nationkey, c_mktsegment) UNION ALL SELECT 'orders', CAST(min(k) AS BIGINT), CASE WHEN sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) > 0 THEN 'CRITICAL' WHEN min(k) < 5 THEN 'WARNING' ELSE 'INFO' END FROM (SELECT count(*) AS k FROM orders GROUP BY o_orderdate, o_orderpriority, o_orderstatus) UNION ALL SELECT '(all)', CAST(min(k) AS BIGINT), 'policy' FROM (SELECT count(*) AS k FROM customer GROUP BY c_nationkey, c_mktsegment UNION ALL SELECT count(*) FROM orders GROUP BY o_orderdate, o_orderpriority, o_orderstatus)")
def kanon_overall_min(spark, sf_dir):
    src = source(spark, sf_dir, "customer", "orders")
    report = kanon.audit(src.frames, {"customer": ["c_nationkey", "c_mktsegment"], "orders": ["o_orderdate", "o_orderpriority", "o_orderstatus"]}, strict_k=5)
    return _rows(spark, [(t.table, t.distribution["k_min"], t.severity) for t in report.tables] + [("(all)", report.overall_k_min, "policy")], "table string, k_min long, severity string")


@query("SELECT * EXCLUDE (k) FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS k FROM customer) WHERE k >= 10")
def kanon_suppressed(spark, sf_dir):
    return kanon.suppressed(source(spark, sf_dir, "customer").scan("customer"), ["c_nationkey", "c_mktsegment"], 10)


@query()
def kanon_sampled(spark, sf_dir):
    return kanon.distribution(kanon.classes(kanon.sampled(source(spark, sf_dir, "orders").scan("orders"), 0.2, 7), ["o_orderpriority", "o_orderstatus"]))


@query("SELECT col0 AS \"table\", col1 AS \"column\", col2 AS pattern FROM (VALUES ('customer', 'c_name', 'name'), ('nation', 'n_name', 'name'), ('part', 'p_name', 'name'), ('region', 'r_name', 'name'), ('supplier', 's_name', 'name'))")
def pii_columns(spark, sf_dir):
    found = personal_columns(catalog(source(spark, sf_dir, *STAR)), RuleSet())
    return _rows(spark, [(f.table, f.column, f.pattern) for f in found], "table string, column string, pattern string")


@query("SELECT 'pages' AS \"table\", 'page_id' AS \"column\", 'age' AS pattern, CAST(NULL AS VARCHAR) AS strategy UNION ALL SELECT 'people', 'birth_date', 'birth', 'HASH' UNION ALL SELECT 'people', 'postal_code', 'postal', NULL")
def quasi_id_columns(spark, sf_dir):
    people = source(spark, sf_dir, "orders").scan("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("birth_date"), F.col("o_custkey").alias("postal_code"), F.col("o_orderstatus").alias("gender"))
    src = Source(spark, source(spark, sf_dir, "pages").frames | {"people": people})
    rules = RuleSet(rules=(ColumnRule("people", "birth_date", Strategy.HASH), ColumnRule("people", "gender", Strategy.MASK)))
    found = quasi_identifiers(introspect(src, {}, []), rules)
    return _rows(spark, [(f.table, f.column, f.pattern, f.strategy.name if f.strategy else None) for f in found], "table string, column string, pattern string, strategy string")


@query("WITH a AS (SELECT DISTINCT lower(c_name) AS v FROM customer WHERE c_nationkey < 12), b AS (SELECT DISTINCT lower(c_name) AS v FROM customer WHERE c_nationkey > 8) SELECT (SELECT count(*) FROM (SELECT v FROM a UNION SELECT v FROM b)) AS n_union, (SELECT count(*) FROM (SELECT v FROM a INTERSECT SELECT v FROM b)) AS n_common")
def linked_consistency(spark, sf_dir):
    """Two tables' hashes of one logical value agree: as many shared pseudonyms as shared values."""
    df = source(spark, sf_dir, "customer").scan("customer")
    hashed = lambda d, v: d.select(crypto.uuid_of(v, SECRETS).alias("v"))
    return shared_values(hashed(df.where("c_nationkey < 12"), F.upper("c_name")), hashed(df.where("c_nationkey > 8"), F.col("c_name")))


def _linked_rules() -> RuleSet:
    fake = lambda t, c: ColumnRule(t, c, Strategy.FAKE, SemanticType.LAST_NAME)
    return RuleSet(rules=(fake("customer", "c_name"), fake("supplier", "s_name"), fake("part", "p_brand")), linked=(LinkedColumns("person", (("customer", "c_name"), ("supplier", "s_name"))),))


@query("SELECT 'person' AS semantic_key, count(DISTINCT v) AS entries FROM (SELECT lower(c_name) AS v FROM customer UNION ALL SELECT lower(s_name) FROM supplier) UNION ALL SELECT 'part.p_brand', count(DISTINCT lower(p_brand)) FROM part")
def dict_stats_topn(spark, sf_dir):
    return dictionary.top_contributors(dictionary.entries(source(spark, sf_dir, *STAR).frames, _linked_rules()))


# --- rules, sinks, reports ------------------------------------------------------------------------


@query("SELECT col0 AS \"table\", col1 AS \"column\", col2 AS strategy FROM (VALUES ('customer', 'c_custkey', 'FPE_ID'), ('customer', 'c_name', 'FAKE'), ('customer', 'c_acctbal', 'NULLIFY'), ('orders', 'o_orderpriority', 'MASK'), ('orders', 'o_orderstatus', 'HASH'), ('events', 'props', 'JSONB'), ('orders', 'o_custkey', 'FPE_ID'))")
def rule_propagation(spark, sf_dir):
    rules = propagate(RULES, catalog(source(spark, sf_dir)))
    return _rows(spark, used_strategies(rules), "table string, column string, strategy string")


@query(f"SELECT 'customer' AS \"table\", 'c_name' AS \"column\", 'FAKE' AS strategy, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE {SEED}) UNION ALL SELECT 'orders', 'o_orderpriority', 'MASK', count(*) FROM orders WHERE {SEED}")
def strategy_usage(spark, sf_dir):
    e = extraction(spark, sf_dir)
    rules = RuleSet(rules=(ColumnRule("customer", "c_name", Strategy.FAKE, SemanticType.LAST_NAME), ColumnRule("orders", "o_orderpriority", Strategy.MASK)))
    counts = table_counts({t: pseudonymized(e.rows(t), t, rules, SECRETS) for t in ("customer", "orders")})
    return _rows(spark, used_strategies(rules), "table string, column string, strategy string").join(counts, "table").select("table", "column", "strategy", "n")


_AWKWARD = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a' || chr(9) || 'b' WHEN 2 THEN 'x' || chr(10) || chr(92) || 'y' || chr(13) ELSE o_orderpriority END AS v FROM orders"


@query(f"SELECT CAST(o_orderkey AS VARCHAR) || chr(9) || coalesce(replace(replace(replace(replace(v, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't'), chr(92) || 'N') AS line FROM ({_AWKWARD})")
def copy_text_rows(spark, sf_dir):
    source(spark, sf_dir, "orders").register()
    return copy_rows(spark.sql(_AWKWARD))


@query("SELECT count(*) FILTER (WHERE o_totalprice > 1000) AS good, count(*) FILTER (WHERE NOT o_totalprice > 1000) AS bad FROM orders")
def quarantine_split(spark, sf_dir):
    good, bad = quarantine(source(spark, sf_dir, "orders").scan("orders"), F.col("o_totalprice") > 1000, 0.5)
    both = good.select(F.lit(1).alias("good"), F.lit(0).alias("bad")).union(bad.select(F.lit(0), F.lit(1)))
    return both.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))


@query("SELECT 'custmer' AS given, 'customer' AS suggestion UNION ALL SELECT 'LINEITEMS', 'lineitem' UNION ALL SELECT 'zzzzzzzz', NULL")
def name_suggestions(spark, sf_dir):
    return _rows(spark, [(g, closest(g, TABLES)) for g in ("custmer", "LINEITEMS", "zzzzzzzz")], "given string, suggestion string")


@query("SELECT * FROM (SELECT 'HASH' AS strategy, 'text' AS type, 'OK' AS verdict UNION ALL SELECT 'HASH', 'bigint', 'SUSPECT' UNION ALL SELECT 'HASH', 'jsonb', 'INCOMPATIBLE' UNION ALL SELECT 'FPE_ID', 'bigint', 'OK' UNION ALL SELECT 'FPE_ID', 'text', 'SUSPECT' UNION ALL SELECT 'FPE_ID', 'jsonb', 'INCOMPATIBLE' UNION ALL SELECT 'MASK', 'text', 'OK' UNION ALL SELECT 'MASK', 'bigint', 'SUSPECT' UNION ALL SELECT 'MASK', 'jsonb', 'INCOMPATIBLE' UNION ALL SELECT 'FPE_UUID', 'text', 'SUSPECT' UNION ALL SELECT 'FPE_UUID', 'bigint', 'INCOMPATIBLE' UNION ALL SELECT 'FPE_UUID', 'jsonb', 'INCOMPATIBLE' UNION ALL SELECT 'FAKE', 'text', 'OK' UNION ALL SELECT 'FAKE', 'bigint', 'INCOMPATIBLE' UNION ALL SELECT 'FAKE', 'jsonb', 'INCOMPATIBLE' UNION ALL SELECT 'NULLIFY', 'text', 'OK' UNION ALL SELECT 'NULLIFY', 'bigint', 'OK' UNION ALL SELECT 'NULLIFY', 'jsonb', 'OK' UNION ALL SELECT 'KEEP', 'text', 'OK' UNION ALL SELECT 'KEEP', 'bigint', 'OK' UNION ALL SELECT 'KEEP', 'jsonb', 'OK')")
def strategy_type_matrix(spark, sf_dir):
    return _rows(spark, [(s.name, t, fit(s, SemanticType.LAST_NAME if s == Strategy.FAKE else None, t)) for s in Strategy for t in ("text", "bigint", "jsonb")], "strategy string, type string, verdict string")


@query("SELECT column_name AS \"column\", CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'integer' WHEN 'DOUBLE' THEN 'double precision' WHEN 'VARCHAR' THEN 'text' ELSE 'timestamp' END AS type FROM (DESCRIBE SELECT * FROM orders)".replace("(DESCRIBE SELECT * FROM orders)", "information_schema.columns WHERE table_name = 'orders'"))
def schema_introspection(spark, sf_dir):
    orders = catalog(source(spark, sf_dir, "orders")).table("orders")
    return _rows(spark, [(c.name, c.type.removesuffix("tz")) for c in orders.columns], "column string, type string")


@query(f"SELECT event_id, {sql_hmac('CAST(user_id AS VARCHAR)')} AS user_id, event_type FROM events")
def stream_pseudonymized_events(spark, sf_dir):
    """The projection as a stream that reads what is there and stops."""
    import uuid

    from lamina.sources.scan import shared_dir

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").cast("string").alias("user_id"), "event_type")
    at = f"{shared_dir(spark)}/lamina/stream-{uuid.uuid4().hex}"
    events.write.parquet(f"{at}/in")
    rules = RuleSet(rules=(ColumnRule("events", "user_id", Strategy.HASH),))
    stream = pseudonymized_stream(spark.readStream.schema(events.schema).parquet(f"{at}/in"), "events", rules, SECRETS)
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{at}/state").format("parquet").start(f"{at}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@query()
def pseudonymized_subset(spark, sf_dir):
    """The whole engine at once: closure, propagated rules, one projection a table; shown as keyed texts."""
    src = source(spark, sf_dir, *STAR)
    cat = catalog(src)
    rules = propagate(replace(RULES, rules=tuple(r for r in RULES.rules if r.table in STAR)), cat)
    found = Extraction(src, cat, rules)
    return reduce(DataFrame.unionByName, [copy_rows(pseudonymized(found.rows(t), t, rules, SECRETS)).select(F.lit(t).alias("table"), "line") for t in found.tables()])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import lamina.small_queries  # noqa: F401 (registers its own)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    import lamina.small_queries  # noqa: F401

    return dict(ORACLES)
