"""Rule files, checks, propagation, graph, detectors."""

import pytest

from lamina import config
from lamina.model import Catalog, Column, ColumnRule, ForeignKey, LinkedColumns, RuleError, RuleSet, Secrets, SemanticType, Strategy, Table
from lamina.operators import detect, dictionary, graph
from lamina.operators.rules import Classes, propagate

S = Strategy


def table(name, columns, key=(), foreign=()):
    return Table(name, tuple(Column(*c) for c in columns), tuple(key), tuple(foreign))


SHOP = Catalog(
    {
        t.name: t
        for t in [
            table("users", [("id", "bigint"), ("email", "varchar(255)"), ("manager_id", "bigint"), ("birth_date", "date"), ("address_json", "jsonb")], ["id"], [ForeignKey("users", ("manager_id",), "users", ("id",))]),
            table("products", [("id", "bigint"), ("name", "text")], ["id"]),
            table("orders", [("id", "bigint"), ("user_id", "bigint"), ("postal_code", "integer")], ["id"], [ForeignKey("orders", ("user_id",), "users", ("id",))]),
            table("order_items", [("id", "bigint"), ("order_id", "bigint"), ("product_id", "bigint")], ["id"], [ForeignKey("order_items", ("order_id",), "orders", ("id",)), ForeignKey("order_items", ("product_id",), "products", ("id",))]),
            table("audit_logs", [("id", "bigint"), ("user_email", "text"), ("gender", "text")], ["id"]),
        ]
    }
)


def code(call, *args, **kw):
    with pytest.raises(RuleError) as e:
        call(*args, **kw)
    return e.value.code


@pytest.mark.parametrize("text", [None, "", "  ", "a = 1", "a = 'x;y'", "a = 'it''s; ok'", "status = 'updated'", "id IN (SELECT id FROM t)", "dropped = true", "x" * 1000])
def test_filters_accepted(text):
    config.check_filter("t", text)


@pytest.mark.parametrize("text", ["a = 1; b", "a -- b", "/* a */ 1", "a = '--'", "DROP table x", "a = 1 and delete", "do", "x" * 1001, "a\0b", "a = 'x' ; ", "Merge"])
def test_filters_refused(text):
    assert code(config.check_filter, "t", text) == "CONFIG_EXTRACTION_FILTER_INVALID"


YAML = """
extraction: {fk_depth: 0, tables: [{table: orders, filter: "id > 3"}], unknown: 1}
anonymization:
  tables:
    - table: users
      columns:
        - {name: email, strategy: fake, type: Email}
        - {name: address_json, strategy: FAKE, type: JSONB, json_paths: [{path: $.city, strategy: mask}]}
  linked_columns:
    - {semantic_key: mail, columns: [{table: users, column: email}, {table: audit_logs, column: user_email}]}
"""


def test_parse_rules():
    r = config.parse_rules(YAML)
    assert (r.fk_depth, r.batch_size, r.filters()) == (3, 1000, {"orders": "id > 3"})
    assert r.rules[0] == ColumnRule("users", "email", S.FAKE, SemanticType.EMAIL) and r.rules[1].json_paths[0].strategy == S.MASK
    assert dictionary.semantic_key(r, "audit_logs", "user_email") == "mail" and dictionary.semantic_key(r, "users", "id") == "users.id"
    config.check_structure(r)
    assert config.check_against(r, SHOP) == []


def test_parse_errors(tmp_path):
    assert code(config.parse_rules, "a: [") == "CONFIG_UNREADABLE"
    assert code(config.parse_rules, "- 1") == "CONFIG_UNREADABLE"
    assert code(config.load_rules, str(tmp_path / "none.yaml")) == "CONFIG_NOT_FOUND"
    assert code(config.parse_rules, "anonymization: {tables: [{table: t, columns: [{name: c, strategy: ROT13}]}]}") == "CONFIG_UNKNOWN_VALUE"


@pytest.mark.parametrize(
    "text,want",
    [
        ("extraction: {tables: []}", "CONFIG_EXTRACTION_TABLES_EMPTY"),
        ("extraction: {fk_depth: -1, tables: [{table: t}]}", "CONFIG_EXTRACTION_FK_DEPTH_INVALID"),
        ("extraction: {chunk_size: -5, tables: [{table: t}]}", "CONFIG_EXTRACTION_CHUNK_SIZE_INVALID"),
        ("extraction: {tables: [{table: 'a b'}]}", "CONFIG_INVALID_IDENTIFIER"),
        ("extraction: {tables: [{table: t}]}\nanonymization: {tables: [{table: t, columns: [{name: c, strategy: FAKE}]}]}", "CONFIG_STRATEGY_REQUIRES_TYPE"),
        ("extraction: {tables: [{table: t}]}\nanonymization: {tables: [{table: t, columns: [{name: c, strategy: FAKE, type: JSONB}]}]}", "CONFIG_JSONB_REQUIRES_JSON_PATHS"),
    ],
)
def test_structure_errors(text, want):
    assert code(config.check_structure, config.parse_rules(text)) == want


def test_names_against_catalog():
    bad = RuleSet(rules=(ColumnRule("userz", "id", S.KEEP),))
    with pytest.raises(RuleError, match="users"):
        config.check_against(bad, SHOP)
    with pytest.raises(RuleError, match="email"):
        config.check_against(RuleSet(rules=(ColumnRule("USERS", "emial", S.KEEP),)), SHOP)
    notes = config.check_against(RuleSet(rules=(ColumnRule("users", "id", S.HASH), ColumnRule("users", "id", S.FPE_UUID))), SHOP)
    assert [n.split(":")[0] for n in notes] == ["SUSPECT", "INCOMPATIBLE"]
    assert code(config.check_against, RuleSet(rules=(ColumnRule("users", "id", S.FPE_UUID),)), SHOP, strict=True) == "CONFIG_STRATEGY_INCOMPATIBLE"


def test_secrets_and_guardrails(tmp_path):
    ok = Secrets("s" * 16, "k" * 16)
    config.check_secrets(ok)
    assert code(config.check_secrets, Secrets(" ", "k" * 16)) == "CONFIG_HMAC_SECRET_MISSING"
    assert code(config.check_secrets, Secrets("s" * 15, "k" * 16)) == "CONFIG_HMAC_SECRET_TOO_SHORT"
    assert code(config.check_secrets, Secrets("s" * 16, "k" * 17)) == "CONFIG_FPE_KEY_INVALID_LENGTH"
    for bad in ({"max_batch_error_rate": 1.1}, {"max_target_rows": -1}, {"heap_warning_percent": 0}):
        assert code(config.check_guardrails, **bad) == "CONFIG_GUARDRAIL_OUT_OF_RANGE"
    assert config.check_output_path("a/b.sql", "out", tmp_path) == tmp_path / "a/b.sql"
    assert code(config.check_output_path, "../x", "out", tmp_path) == "CONFIG_OUTPUT_PATH_TRAVERSAL"
    assert code(config.check_output_path, "", "out", tmp_path) == "CONFIG_OUTPUT_PATH_BLANK"
    config.check_compression("a.sql.GZ", "GZIP")
    for path, kind in (("a.sql", "GZIP"), ("a.gz", "ZSTD"), ("a.zst", "NONE")):
        assert code(config.check_compression, path, kind) == "CONFIG_SINK_COMPRESSION_EXTENSION_MISMATCH"


def test_jdbc_urls():
    assert config.parse_jdbc_url("jdbc:postgresql://db:6000/shop?sslmode=require") == {"host": "db", "port": 6000, "database": "shop", "sslmode": "require"}
    assert config.parse_jdbc_url("jdbc:postgresql:shop")["port"] == 5432
    for url, want in ((None, "BLANK"), ("jdbc:mysql://x/y", "INVALID"), ("jdbc:postgresql://h:x/d", "INVALID"), ("jdbc:postgresql://h/", "INVALID"), ("jdbc:postgresql://h/d?socketFactory=a", "REJECTED_PARAM")):
        assert code(config.parse_jdbc_url, url) == f"CONFIG_JDBC_URL_{want}"


def test_quote_and_distance():
    assert config.quoted("s", "t$1") == '"s"."t$1"' and config.distance("Kitten", "sitting") == 3
    assert config.closest("usrs", ["products", "users"]) == "users" and config.closest("zzzzzz", ["users"]) is None
    for bad in ("", None, "1a", 'a"b', "a" * 64):
        assert code(config.check_identifier, bad) == "CONFIG_INVALID_IDENTIFIER"
    assert [config.family(t) for t in ("VARCHAR(3)", "double precision", "int4", "bytea", "timestamp with time zone")] == ["STRING", "NUMERIC", "NUMERIC", "OTHER", "TEMPORAL"]


def rules(*own, linked=()):
    return RuleSet(rules=tuple(ColumnRule(*r) for r in own), linked=tuple(linked))


def strategies(r):
    return {(x.table, x.column): x.strategy for x in r.rules}


def test_propagation_spreads_both_ways():
    for start in (("users", "id"), ("orders", "user_id"), ("users", "manager_id")):
        got = strategies(propagate(rules((*start, S.FPE_ID)), SHOP))
        assert got == {("users", "id"): S.FPE_ID, ("orders", "user_id"): S.FPE_ID, ("users", "manager_id"): S.FPE_ID}
    assert strategies(propagate(rules(("users", "id", S.KEEP)), SHOP)) == {("users", "id"): S.KEEP}
    assert strategies(propagate(rules(("orders", "user_id", S.MASK)), SHOP)) == {("orders", "user_id"): S.MASK}
    got = strategies(propagate(rules(("users", "id", S.HASH), ("users", "manager_id", S.NULLIFY)), SHOP))
    assert got[("users", "manager_id")] == S.NULLIFY and got[("orders", "user_id")] == S.HASH


def test_propagation_refuses():
    assert code(propagate, rules(("users", "id", S.FPE_ID), ("orders", "user_id", S.HASH)), SHOP) == "CONFIG_FK_PROPAGATION_STRATEGY_CONFLICT"
    assert code(propagate, rules(("users", "id", S.FPE_ID), ("orders", "user_id", S.KEEP)), SHOP) == "CONFIG_FK_PROPAGATION_STRATEGY_CONFLICT"
    assert code(propagate, rules(("users", "id", S.MASK)), SHOP) == "CONFIG_FK_PROPAGATION_INTEGRITY_BREAKING"
    assert code(propagate, rules(("products", "id", S.NULLIFY)), SHOP) == "CONFIG_FK_PROPAGATION_INTEGRITY_BREAKING"
    propagate(rules(("products", "id", S.NULLIFY), ("order_items", "product_id", S.NULLIFY)), SHOP)
    fake = ("products", "id", S.FAKE, SemanticType.EMAIL)
    assert code(propagate, rules(fake), SHOP) == "CONFIG_FK_PROPAGATION_FAKE_REQUIRES_LINK"
    link = LinkedColumns("p", (("products", "id"), ("order_items", "product_id")))
    assert strategies(propagate(rules(fake, linked=[link]), SHOP))[("order_items", "product_id")] == S.FAKE
    assert code(propagate, rules(fake, ("order_items", "product_id", S.FAKE, SemanticType.PHONE), linked=[link]), SHOP) == "CONFIG_FK_PROPAGATION_STRATEGY_CONFLICT"


def test_composite_classes_pair_by_position():
    fk = ForeignKey("b", ("x", "y"), "a", ("k1", "k2"))
    cat = Catalog({"a": table("a", [("k1", "int"), ("k2", "int")], ["k1", "k2"]), "b": table("b", [("x", "int"), ("y", "int")], (), [fk])})
    assert sorted(map(sorted, Classes(cat).groups().values())) == [[("a", "k1"), ("b", "x")], [("a", "k2"), ("b", "y")]]
    with pytest.raises(RuleError):
        ForeignKey("b", ("x",), "a", ("k1", "k2"))


def test_graph():
    order = graph.topological(SHOP)
    assert order.index("products") < order.index("order_items") and order[-1] == "users" and graph.cyclic(SHOP) == {"users"}
    assert graph.ancestors(SHOP, "order_items", 1) == {"orders", "products"} and graph.ancestors(SHOP, "order_items", 2) == {"orders", "products", "users"}
    assert graph.configured_order(SHOP, ["order_items", "other", "products"]) == ["products", "order_items", "other"]


def test_detectors():
    found = detect.personal_columns(SHOP, rules(("users", "email", S.HASH)))
    assert [(f.table, f.column, f.pattern) for f in found] == [("audit_logs", "user_email", "email"), ("audit_logs", "gender", "gender"), ("products", "name", "name")]
    quasi = detect.quasi_identifiers(SHOP, rules(("audit_logs", "gender", S.HASH), ("orders", "postal_code", S.MASK)))
    assert [(f.table, f.column, f.strategy) for f in quasi] == [("audit_logs", "gender", S.HASH), ("users", "manager_id", None), ("users", "birth_date", None)]  # "age" is a part of manager_id
    assert detect.quasi_identifiers(SHOP, RuleSet(), enabled=False) == []
    assert [f.column for f in detect.quasi_identifiers(SHOP, RuleSet(), patterns=["manager"])] == ["manager_id"]
