"""Sinks, checkpoints, reports, streaming and the command line."""

import gzip
import json
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lamina import cli, report
from lamina import queries as q
from lamina.model import ColumnRule, ExtractTable, PlanMode, RuleError, RuleSet, Strategy
from lamina.operators.detect import personal_columns
from lamina.operators.extract import Extraction
from lamina.operators.rules import propagate, resolved
from lamina.run import bounded, compiled, execute, planned
from lamina.sources.scan import Source, introspect
from lamina.sources.sinks import Checkpoint, DumpSink, JdbcSink, NoSink, ParquetSink, Tolerance, config_hash, ddl, dump_parts, make_sink, quarantine, read_state, staged_insert, write_state
from lamina.streaming import pseudonymized_stream, windowed_counts

RULES = RuleSet(extract=(ExtractTable("orders", "o_totalprice > 480000"),), rules=(ColumnRule("customer", "c_custkey", Strategy.FPE_ID), ColumnRule("customer", "c_name", Strategy.HASH), ColumnRule("orders", "o_orderpriority", Strategy.MASK)), fk_depth=3)


@pytest.fixture(scope="module")
def star(spark, sf_dir):
    src = q.source(spark, sf_dir, *q.STAR)
    cat = q.catalog(src)
    rules, notes = compiled(RULES, cat, q.SECRETS)
    return src, cat, rules


def test_run_matches_plan_and_stays_consistent(spark, star, tmp_path):
    src, cat, rules = star
    plan = planned(src, cat, rules)
    outcome = execute(src, cat, rules, q.SECRETS, ParquetSink(str(tmp_path)), plan)
    assert {t.table: t.rows for t in outcome.tables} == {t.table: t.total for t in plan.tables} and outcome.total("rows") > 0
    out = {t.table: spark.read.parquet(f"{tmp_path}/{t.table}.parquet") for t in outcome.tables}
    assert out["orders"].join(out["customer"], F.col("o_custkey") == F.col("c_custkey"), "left_anti").count() == 0
    assert out["customer"].join(src.frames["customer"], "c_name").count() == 0
    dry = execute(src, cat, rules, q.SECRETS, NoSink(), plan)
    assert dry.total("inserted") == outcome.total("inserted")
    assert ("customer", "c_name", "HASH") in outcome.strategies and outcome.covered_columns == 4
    text = report.run_text(plan, outcome, [])
    assert "orders" in text and json.loads(report.run_json(plan, outcome))["run"]["totals"]["conflicts"] == 0
    assert "<table>" in report.run_html(plan, outcome) and "EXACT" in report.plan_text(plan)


def test_dump_is_reproducible(star, tmp_path):
    src, cat, rules = star
    texts = []
    for n in range(2):
        sink = DumpSink(str(tmp_path / f"{n}.sql.gz"), timestamps=False)
        outcome = execute(src, cat, rules, q.SECRETS, sink)
        texts.append((tmp_path / f"{n}.sql.gz").read_bytes())
    assert texts[0] == texts[1]
    text = gzip.decompress(texts[0]).decode()
    blocks = text.split("FROM stdin;\n")[1:]
    assert [b.split("\\.\n")[0].count("\n") for b in blocks] == [t.inserted for t in outcome.tables if t.inserted]
    assert text.index('COPY "public"."region"') < text.index('COPY "public"."orders"') and "session_replication_role = 'origin'" in text
    assert 'PRIMARY KEY ("r_regionkey")' in ddl(cat.table("region"), "public")
    sink = DumpSink(str(tmp_path / "a.sql.zst"), compression="ZSTD", timestamps=False)
    execute(src, cat, rules, q.SECRETS, sink)
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader((tmp_path / "a.sql.zst").open("rb")).read().decode() == text


def test_sink_rules(star, spark, tmp_path):
    src, cat, _ = star
    with pytest.raises(RuleError, match="SINK_NOT_OPEN"):
        NoSink().write("orders", src.frames["orders"])
    with pytest.raises(RuleError):
        make_sink("DUMP")
    with pytest.raises(RuleError):
        make_sink("TAPE")
    with pytest.raises(RuleError):
        make_sink("DUMP", path="x.sql")
    assert dump_parts(src.frames["nation"], str(tmp_path / "n")) == 25
    good, bad = quarantine(src.frames["nation"], F.col("n_nationkey") < 20, 0.2)
    assert (good.count(), bad.count()) == (20, 5)
    with pytest.raises(RuleError, match="WRITE_BATCH_ERROR_RATE"):
        quarantine(src.frames["nation"], F.col("n_nationkey") < 20, 0.19)


def test_jdbc_ignores_conflicts(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id int, v string")
    cat = introspect(Source(spark, {"t": df}), {"t": ["id"]}, [])
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df.where("id = 1").write.format("jdbc").options(url=url, dbtable="t", **driver).save()
    with pytest.raises(RuleError, match="CONFIG_JDBC_URL_INVALID"):
        JdbcSink(url, **driver)
    with pytest.raises(RuleError, match="CONFIG_JDBC_URL_REJECTED_PARAM"):
        Source.jdbc(spark, "jdbc:postgresql://h/d?socketFactory=x", "", ["t"])
    driver["check_url"] = lambda url: None
    sink = JdbcSink(url, **driver)
    sink.open(cat)
    assert sink.write("t", df) == (1, 2)
    assert sink.write("t", df) == (0, 3)
    assert Source.jdbc(spark, url, "", ["t"], **driver).scan("t", "id > 1").count() == 1
    many = spark.range(1000).selectExpr("cast(id as int) id", "cast(id % 7 as string) v")
    many.write.format("jdbc").options(url=url, dbtable="big", driver=driver["driver"]).save()
    split = Source.jdbc(spark, url, "", ["big", "t"], partition_by={"big": "id"}, partitions=5, **driver)
    assert split.frames["big"].rdd.getNumPartitions() == 5 and split.frames["t"].rdd.getNumPartitions() == 1
    assert split.frames["big"].count() == 1000 and split.row_counts() == {"big": 1000, "t": 2}
    assert staged_insert("public", "t", "s", ["id", "v"]) == 'INSERT INTO "public"."t" ("id", "v") SELECT "id", "v" FROM "public"."s" ON CONFLICT DO NOTHING'


def test_checkpoint_resumes(star, tmp_path):
    src, cat, rules = star
    path = str(tmp_path / "run.json")
    first = Checkpoint(path, "a: 1\r\n")
    first.finish("region")
    again = Checkpoint(path, "a: 1\n", resume=True)
    assert again.finished("region") and not again.finished("orders")
    with pytest.raises(RuleError, match="DRIFT"):
        Checkpoint(path, "a: 2\n", resume=True)
    outcome = execute(src, cat, rules, q.SECRETS, NoSink(), checkpoint=again)
    assert "region" not in {t.table for t in outcome.tables} and not (tmp_path / "run.json").exists()
    assert config_hash("x\r\ny") == config_hash("x\ny")
    write_state(str(tmp_path / "s.json"), [("t", "c", "HASH")])
    assert read_state(str(tmp_path / "s.json")) == {("t", "c"): "HASH"} and read_state(str(tmp_path / "none")) == {}


def test_crash_keeps_finished_tables(star, tmp_path):
    src, cat, rules = star

    class Breaks(NoSink):
        def write(self, table, df):
            if table == "orders":
                raise OSError("disk")
            return super().write(table, df)

    path = str(tmp_path / "run.json")
    with pytest.raises(OSError):
        execute(src, cat, rules, q.SECRETS, Breaks(), checkpoint=Checkpoint(path, "a"))
    done = Checkpoint(path, "a", resume=True).done
    assert "customer" in done and "orders" not in done


def test_streaming_is_the_same_projection(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.union(events).repartition(2).write.parquet(f"{tmp_path}/in")
    rules = RuleSet(rules=(ColumnRule("events", "event_type", Strategy.HASH),))
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    out = pseudonymized_stream(stream, "events", rules, q.SECRETS, key=["event_id"], time="ts", late="3650 days")
    out.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").format("parquet").start(f"{tmp_path}/out").awaitTermination()
    from lamina.operators.pseudonymize import pseudonymized

    got = spark.read.parquet(f"{tmp_path}/out")
    want = pseudonymized(events, "events", rules, q.SECRETS).withColumn("ts", F.col("ts").cast("timestamp"))
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).isEmpty()
    counts = windowed_counts(stream, "ts", "1 day")
    counts.writeStream.outputMode("complete").trigger(availableNow=True).format("memory").queryName("w").start().awaitTermination()
    assert spark.sql("select sum(n) from w").first()[0] == 2 * events.count()


SCHEMA = """
tables:
  nation: {key: [n_nationkey]}
  customer: {key: [c_custkey], foreign: [{columns: [c_nationkey], table: nation, to: [n_nationkey]}]}
  orders: {key: [o_orderkey], foreign: [{columns: [o_custkey], table: customer, to: [c_custkey]}]}
"""
CONFIG = """
extraction: {tables: [{table: orders, filter: "o_totalprice > 450000"}]}
anonymization:
  tables:
    - table: customer
      columns: [{name: c_custkey, strategy: FPE_ID}, {name: c_name, strategy: FAKE, type: LAST_NAME}]
"""


def test_command_line(spark, sf_dir, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("LAMINA_HMAC_SECRET", "s" * 20)
    monkeypatch.setenv("LAMINA_FPE_KEY", "k" * 16)
    (tmp_path / "schema.yaml").write_text(SCHEMA)
    (tmp_path / "config.yaml").write_text(CONFIG)
    base = ["--schema", "schema.yaml", "--data", sf_dir, "--config", "config.yaml"]
    assert cli.main(["plan", *base, "--format", "json"], spark) == 0
    plan = json.loads(capsys.readouterr().out)["plan"]
    assert cli.main(["execute", *base, "--out", "o", "--state", "s.json", "--html", "r.html", "--format", "json", "--checkpoint", "c.json"], spark) == 0
    run = json.loads(capsys.readouterr().out)["run"]
    assert run["totals"]["rows"] == plan["total"] and (tmp_path / "r.html").exists() and ("customer", "c_name") in read_state("s.json")
    assert cli.main(["dry-run", *base], spark) == 0 and cli.main(["plan", *base, "--mode", "ESTIMATE"], spark) == 0
    assert cli.main(["execute", *base, "--out", "d.sql", "--sink", "DUMP", "--compression", "NONE"], spark) == 0 and "COPY" in (tmp_path / "d.sql").read_text()
    assert cli.main(["plan", *base, "--max-rows", "1"], spark) == 3
    assert cli.main(["preflight", *base, "--out", "o"], spark) == 0 and "OK   names and types" in capsys.readouterr().out
    (tmp_path / "bad.yaml").write_text(CONFIG.replace("c_name", "c_nam"))
    assert cli.main(["preflight", *base[:4], "--config", "bad.yaml"], spark) == cli.REFUSED and "SKIP propagation" in capsys.readouterr().out
    (tmp_path / "upper.yaml").write_text(CONFIG.replace("c_name", "C_NAME").replace("table: customer", "table: CUSTOMER"))
    assert cli.main(["execute", *base[:4], "--config", "upper.yaml", "--out", "u", "--max-error-rate", "0"], spark) == 0
    names = spark.read.parquet(f"{tmp_path}/u/customer.parquet").select("c_name")
    assert names.count() and names.where("c_name like 'Customer%'").isEmpty()
    assert cli.main(["execute", *base, "--out", "o", "--max-entries", "1"], spark) == 6
    assert cli.main(["execute", *base, "--sink", "JDBC"], spark) == cli.REFUSED
    assert cli.main(["execute", *base, "--sink", "JDBC", "--target-url", "jdbc:mysql://h/d"], spark) == cli.REFUSED
    assert cli.main(["plan", *base[:2], "--data", "jdbc:postgresql://127.0.0.1:1/none", *base[4:]], spark) == 2
    assert cli.main(["execute", *base, "--out", "o", "--timeout", "0.05", "--format", "json"], spark) == 7 and '"exitCode": 7' in capsys.readouterr().err
    assert cli.main(["execute", *base, "--out", "../x"], spark) == cli.REFUSED
    audit = ["audit", "--schema", "schema.yaml", "--data", sf_dir]
    for form in ("text", "json", "markdown"):
        assert cli.main([*audit, "--quasi-id", "customer:c_nationkey,c_mktsegment", "--k-min", "10000", "--format", form], spark) == cli.VIOLATED
    assert cli.main([*audit, "--quasi-id", "customer:c_nationkey", "--k-min", "1", "--sample-rate", "0.9"], spark) == 0
    assert cli.main([*audit, "--quasi-id", "customer:nope"], spark) == cli.REFUSED
    assert cli.main(["diag", "--schema", "schema.yaml", "--data", sf_dir], spark) == 0 and "orders" in capsys.readouterr().out
    assert cli.main(["diag", "--schema", "none.yaml", "--data", sf_dir], spark) == cli.FAILED


def test_estimate_counts_whole_tables(star):
    src, cat, rules = star
    plan = planned(src, cat, rules, PlanMode.ESTIMATE)
    assert plan.total >= planned(src, cat, rules).total and Extraction(src, cat, rules).tables()[0] == "part" or plan.notes


def test_refused_rows_are_counted_and_kept(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else f"v{i}") for i in range(1, 21)], "id long, v string")
    src = Source(spark, {"t": df})
    cat = introspect(src, {"t": ["id"]}, [])
    table = cat.table("t")
    cat.tables["t"] = replace(table, columns=tuple(replace(c, nullable=c.name == "id") for c in table.columns))
    rules = RuleSet(extract=(ExtractTable("t"),), rules=(ColumnRule("t", "v", Strategy.HASH),))
    out = execute(src, cat, rules, q.SECRETS, ParquetSink(str(tmp_path / "o")), tolerance=Tolerance(0.25, str(tmp_path / "r")))
    assert (out.tables[0].inserted, out.tables[0].batch_errors, out.tables[0].rows) == (15, 5, 20) and out.warnings
    assert spark.read.parquet(f"{tmp_path}/r/t.parquet").count() == 5 and spark.read.parquet(f"{tmp_path}/o/t.parquet").where("v is null").isEmpty()
    with pytest.raises(RuleError, match="WRITE_BATCH_ERROR_RATE"):
        execute(src, cat, rules, q.SECRETS, NoSink(), tolerance=Tolerance(0.2))
    with pytest.raises(RuleError, match="GUARDRAIL"):
        execute(src, cat, rules, q.SECRETS, NoSink(), tolerance=Tolerance(2))


def test_a_run_removes_its_key_tables(spark, star):
    import os

    src, cat, rules = star
    from lamina.sources.scan import shared_dir

    folder = f"{shared_dir(spark).removeprefix('file:')}/lamina"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    execute(src, cat, rules, q.SECRETS, NoSink())
    assert set(os.listdir(folder)) == before


def test_timeout_cancels(spark):
    slow = spark.range(0, 10**12, 1, 8).selectExpr("sum(length(sha2(cast(id as string), 512)))")
    began = time.monotonic()
    with pytest.raises(RuleError, match="TIMEOUT_TABLE"), bounded(spark, 2, "TIMEOUT_TABLE", "t"):
        slow.collect()
    assert time.monotonic() - began < 60
    with bounded(spark, 100, "TIMEOUT_TABLE", "t"):
        assert spark.range(3).count() == 3


def test_names_in_any_case(spark, sf_dir):
    src = q.source(spark, sf_dir, *q.STAR)
    cat = q.catalog(src)
    given = RuleSet(extract=(ExtractTable("ORDERS", "o_totalprice > 480000"),), rules=(ColumnRule("CUSTOMER", "C_NAME", Strategy.HASH), ColumnRule("Customer", "c_CUSTKEY", Strategy.FPE_ID), ColumnRule("x", "Y", Strategy.KEEP)))
    rules = resolved(given, cat)
    assert [(r.table, r.column) for r in rules.rules] == [("customer", "c_name"), ("customer", "c_custkey"), ("x", "Y")]
    assert ("orders", "o_custkey") in {(r.table, r.column) for r in propagate(given, cat).rules}
    assert "c_name" not in {f.column for f in personal_columns(cat, given)}
    assert Extraction(src, cat, given).rows("orders").count() == Extraction(src, cat, rules).rows("orders").count() > 0
    with pytest.raises(RuleError, match="CONFIG_UNKNOWN_TABLE"):
        compiled(given, cat, q.SECRETS)
