"""Subset closure, plans, audits: properties and calibrated fixtures."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lamina import queries as q
from lamina.model import ChildScope, ExtractTable, ForeignKey, PlanMode, RuleError, RuleSet
from lamina.operators import kanon
from lamina.operators.extract import Extraction, hierarchy, orphans
from lamina.plans.planner import Outcome, Plan, PlannedTable, TableOutcome, compare, delta_text, estimated_plan, exact_plan, guard, insights, matches
from lamina.sources.scan import Source, fingerprint, introspect, semi

FKS = [ForeignKey("orders", ("user_id",), "users", ("id",)), ForeignKey("items", ("order_id",), "orders", ("id",)), ForeignKey("items", ("product_id",), "products", ("id",)), ForeignKey("users", ("manager_id",), "users", ("id",)), ForeignKey("notes", ("item_order",), "orders", ("id",))]


@pytest.fixture(scope="module")
def shop(spark):
    frames = {
        "users": spark.createDataFrame([(i, i - 1 if i > 1 else None) for i in range(1, 9)], "id long, manager_id long"),
        "products": spark.createDataFrame([(i,) for i in range(1, 6)], "id long"),
        "orders": spark.createDataFrame([(i, 1 + i % 8 if i != 7 else None) for i in range(1, 21)], "id long, user_id long"),
        "items": spark.createDataFrame([(i, 1 + i % 20, 1 + i % 4) for i in range(1, 61)], "id long, order_id long, product_id long"),
        "notes": spark.createDataFrame([(i % 5, "a") for i in range(30)], "item_order long, text string"),  # no key, repeated rows
    }
    src = Source(spark, frames)
    return src, introspect(src, {t: ["id"] for t in frames if t != "notes"}, FKS)


def ids(df, column="id"):
    return sorted(r[0] for r in df.select(column).collect())


def plain_closure(src, seeds, depth):
    """Children then parents over Python sets, by rounds."""
    data = {t: [r.asDict() for r in df.collect()] for t, df in src.frames.items()}
    rows = {t: {i for i, r in enumerate(data[t]) if seeds[t](r)} if t in seeds else set() for t in data}
    edge = {t: {data[t][i]["id"] for i in rows[t]} for t in seeds if t != "notes"}
    seen = {t: set(v) for t, v in edge.items()}
    for _ in range(depth):
        new = {}
        for fk in FKS:
            if edge.get(fk.to_table):
                hit = {i for i, r in enumerate(data[fk.from_table]) if r[fk.from_columns[0]] in edge[fk.to_table]}
                rows[fk.from_table] |= hit
                if fk.from_table != "notes":
                    new.setdefault(fk.from_table, set()).update(data[fk.from_table][i]["id"] for i in hit)
        edge = {t: v - seen.get(t, set()) for t, v in new.items()}
        for t, v in edge.items():
            seen.setdefault(t, set()).update(v)
    edge = {t: set(v) for t, v in rows.items()}
    for _ in range(depth):
        new = {}
        for fk in FKS:
            want = {data[fk.from_table][i][fk.from_columns[0]] for i in edge.get(fk.from_table, ())}
            new.setdefault(fk.to_table, set()).update(i for i, r in enumerate(data[fk.to_table]) if r["id"] in want)
        edge = {t: v - rows[t] for t, v in new.items()}
        for t, v in edge.items():
            rows[t] |= v
    return {t: len(v) for t, v in rows.items() if v}


@pytest.mark.parametrize("depth", [1, 2, 5])
@pytest.mark.parametrize("seed", [("orders", "id <= 3"), ("users", "id = 4"), ("notes", "item_order = 2"), ("products", None)])
def test_closure_against_plain_version(shop, seed, depth):
    src, cat = shop
    table, text = seed
    tests = {"id <= 3": lambda r: r["id"] <= 3, "id = 4": lambda r: r["id"] == 4, "item_order = 2": lambda r: r["item_order"] == 2, None: lambda r: True}
    rules = RuleSet(extract=(ExtractTable(table, text),), fk_depth=depth)
    found = Extraction(src, cat, rules)
    got = {t: df.count() for t, df in found.frames().items()}
    assert {t: n for t, n in got.items() if n} == plain_closure(src, {table: tests[text]}, depth)
    plan = exact_plan(src, cat, rules, found)
    assert {t.table: t.total for t in plan.tables} == got


def test_no_orphans_and_order(shop):
    src, cat = shop
    found = Extraction(src, cat, RuleSet(extract=(ExtractTable("orders", "id <= 3"),), fk_depth=9))
    frames = found.frames()
    for fk in cat.foreign_keys():
        assert orphans(frames[fk.from_table], fk, frames[fk.to_table]).isEmpty()
    names = list(frames)
    assert names.index("products") < names.index("items") and names[-1] in ("users", "orders", "items", "notes")


def test_scopes_and_parts(shop):
    src, cat = shop
    rules = RuleSet(extract=(ExtractTable("orders", "id <= 3"), ExtractTable("items", "id = 10")), fk_depth=3)
    assert Extraction(src, cat, rules, scope=ChildScope.CONFIGURED, parents=False).rows("items").count() == 1
    assert Extraction(src, cat, rules, parents=False).rows("items").count() == 10
    assert set(Extraction(src, cat, rules, children=False).reach) == {"orders", "items", "users", "products"}


def test_subquery_filter_and_both_reasons(shop):
    src, cat = shop
    rules = RuleSet(extract=(ExtractTable("orders", "user_id IN (SELECT id FROM users WHERE id < 3)"), ExtractTable("users", "id = 8")), fk_depth=1)
    found = Extraction(src, cat, rules)
    assert set(ids(found.rows("users"))) >= {1, 2, 8}


def test_composite_keys(spark):
    accounts = spark.createDataFrame([(1, 1, "A11"), (1, 2, "A12"), (2, 1, "A21"), (2, 2, "A22")], "tenant_id int, account_id int, name string")
    moves = spark.createDataFrame([(1, 1, 1, 150.0), (2, 2, 2, 200.0), (3, 1, 2, 50.0), (4, None, 2, 500.0)], "id int, tenant_id int, account_id int, amount double")
    src = Source(spark, {"accounts": accounts, "transactions": moves})
    fk = ForeignKey("transactions", ("tenant_id", "account_id"), "accounts", ("tenant_id", "account_id"))
    cat = introspect(src, {"accounts": ["tenant_id", "account_id"], "transactions": ["id"]}, [fk])
    found = Extraction(src, cat, RuleSet(extract=(ExtractTable("transactions", "amount >= 100"),)))
    assert {(r.tenant_id, r.account_id) for r in found.rows("accounts").collect()} == {(1, 1), (2, 2)} and found.rows("transactions").count() == 3


def test_hierarchy(shop):
    src, _ = shop
    got = {(r.id, r.depth) for r in hierarchy(src.frames["users"], "id", "manager_id", src.frames["users"].where("id = 5").select("id"), 3).collect()}
    assert got == {(5, 0), (4, 1), (3, 2), (2, 3)}


def test_scans(shop):
    src, cat = shop
    assert src.distinct_values("orders", ["user_id"]).count() == 8
    assert ids(src.by_keys("orders", ["id"], src.frames["products"])) == [1, 2, 3, 4, 5]
    seen = []
    assert src.chunks("orders", lambda rows: seen.append(len(rows)), chunk_size=7, order_by="id") == 20 and max(seen) == 7 and sum(seen) == 20
    with pytest.raises(RuleError):
        src.chunks("orders", seen.append, chunk_size=0)
    with pytest.raises(RuleError):
        src.scan("orders", "1 = 1; drop table x")
    assert src.row_counts()["orders"] == 20 and fingerprint(cat) == fingerprint(cat)
    assert semi(src.frames["orders"], ["id"], src.frames["products"], "left_anti").count() == 15


def test_plans_guard_and_estimate(shop):
    src, cat = shop
    rules = RuleSet(extract=(ExtractTable("orders", "id <= 3"),), fk_depth=3)
    est = estimated_plan(src, cat, rules)
    assert {t.table: (t.total, t.origin) for t in est.tables} == {"orders": (20, "direct"), "items": (60, "fk-child"), "notes": (30, "fk-child"), "users": (8, "fk-parent"), "products": (5, "fk-parent")} and est.notes
    guard(est, 0)
    with pytest.raises(RuleError, match="PLAN_MAX"):
        guard(est, 10)
    unknown = Plan(PlanMode.EXACT, (PlannedTable("a", -1, 0, 0, "direct"), PlannedTable("b", 4, 0, 0, "direct")))
    assert unknown.tables[0].total == -1 and unknown.total == 4


def test_compare_and_insights(spark, shop):
    side = lambda rows: spark.createDataFrame(rows, "table string, n long")
    got = {r.table: (r.planned, r.actual, r.delta_percent) for r in compare(side([("a", 10), ("b", 0), ("c", -1)]), side([("a", 15), ("d", 2), ("c", 5)])).collect()}
    assert got == {"a": (10, 15, 50.0), "b": (0, 0, 0.0), "c": (-1, 5, 0.0), "d": (0, 2, 0.0)}
    plan = Plan(PlanMode.EXACT, (PlannedTable("orders", 10, 0, 0, "direct"), PlannedTable("items", 10, 0, 0, "direct"), PlannedTable("users", 5, 0, 0, "direct")))
    outcome = Outcome([TableOutcome("orders", 20, inserted=20), TableOutcome("items", 5, inserted=4, conflicts=1), TableOutcome("users", 0, 5, inserted=5), TableOutcome("extra", 0, 3, inserted=3, batch_errors=1)])
    found = insights(plan, outcome, shop[1], personal=2)
    by = {(i.level, i.subject) for i in found}
    assert {("WARN", "orders"), ("WARN", "items"), ("OK", "users"), ("WARN", "extra"), ("ERROR", "extra"), ("WARN", "all")} <= by
    assert "items.order_id" in next(i.text for i in found if i.subject == "orders") and outcome.warnings and outcome.throughput is None
    assert [delta_text(d) for d in (0, 0.2, -0.2, 12.4, -50)] == ["0%", "+0%", "-0%", "+12%", "-50%"] and matches(1.0, 0) and not matches(0, 1)


CALIBRATED = [("1985-03-15", 75001, "M"), ("1992-07-22", 13002, "F"), ("1990-01-01", 69001, "M"), ("1990-01-01", 69001, "F"), ("1990-01-01", 69001, "M")]


def test_k_anonymity(spark):
    users = spark.createDataFrame(CALIBRATED, "birth_date string, postal_code int, gender string").withColumn("birth_date", F.to_date("birth_date"))
    src = Source(spark, {"users": users, "none": users.limit(0)})
    cat = introspect(src, {}, [])
    quasi = kanon.resolve_quasi_ids(cat, RuleSet(), {"users": ["birth_date", "postal_code"]})
    report = kanon.audit(src.frames, quasi, strict_k=5)
    d = report.tables[0].distribution
    assert (d["total_rows"], d["total_classes"], d["singletons"], d["k2to4"], d["k5to9"], d["k_min"]) == (5, 3, 2, 1, 0, 1)
    assert report.exit_code == 8 and report.tables[0].severity == "CRITICAL" and report.tables[0].singletons[0] == ["1985-03-15", "75001"]
    assert kanon.audit(src.frames, quasi, strict_k=1).exit_code == 0
    empty = kanon.audit({"none": src.frames["none"]}, {"none": ["gender"]}, strict_k=1)
    assert empty.overall_k_min == -1 and empty.violated and empty.tables[0].distribution["k_average"] == 0.0
    with pytest.raises(RuleError, match="birth_date"):
        kanon.resolve_quasi_ids(cat, RuleSet(), {"users": ["birth_dat"]})
    with pytest.raises(RuleError, match="users"):
        kanon.resolve_quasi_ids(cat, RuleSet(), {"user": ["x"]})
    assert kanon.resolve_quasi_ids(cat, RuleSet()) == {"none": ["birth_date", "postal_code"], "users": ["birth_date", "postal_code"]}
    assert kanon.parse_quasi_id("t: a , b") == ("t", ["a", "b"])
    for bad in ("t", "t:", ":a"):
        with pytest.raises(RuleError):
            kanon.parse_quasi_id(bad)
    nulls = users.withColumn("postal_code", F.lit(None).cast("int"))
    assert kanon.classes(nulls, ["postal_code"]).first().k == 5
    assert kanon.suppressed(users, ["birth_date"], 2).count() == 3 and kanon.sampled(users, 5.0).count() == 5


def test_every_query_has_a_plan_without_python(spark, sf_dir):
    for name in ("pseudonymized_orders", "fpe_id_keys", "fake_iban", "json_leaf_rewrite", "pseudonymized_subset"):
        text = q.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert "Python" not in text and "MapInArrow" not in text
    scan = q.scan_filter_orders(spark, sf_dir)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in scan
    assert replace(q.RULES, fk_depth=1).fk_depth == 1
