"""Golden vectors and edge cases of the column transforms."""

import hashlib
import hmac
import json
import uuid

import pytest
from pyspark.sql import functions as F

from lamina.functions import crypto
from lamina.functions.fake import fake
from lamina.functions.jsonpath import rewrite, segments
from lamina.functions.mask import mask
from lamina.functions.text import copy_rows, escaped
from lamina.model import ColumnRule, JsonPath, RuleError, RuleSet, Secrets, SemanticType, Strategy
from lamina.operators.pseudonymize import pseudonymized, transformed

SECRETS = Secrets("test-hmac-secret-deterministic-v1.0-DO-NOT-CHANGE", "0123456789abcdef", locale="fr")

# Input and expected output of the deterministic transforms.
GOLDEN = [
    (Strategy.HASH, None, "iban-1234-5678", "077db2873166d760d25197124c2f950faae714a4de005c0365a6417cce9b3c6d"),
    (Strategy.HASH, None, "secret-token-abc", "83c113a2127f88cfdcd8943509d755be490923fb510d1593d3e19f1b55b35f0b"),
    (Strategy.HASH, None, "Voldemort", "62639486cdf4b1876fc8725e57037961cb2c09fad06d637a310fb030ad4ddab4"),
    (Strategy.HASH, None, "", "71a9a3e1ab32db961f8c829e3baad61b34f968f57688494994c20db0e384ca61"),
    (Strategy.HASH, None, "🔐 unicode 漢字", "d63c10daa9349cbd412e6b5512dec566cdd676435a21c969ec16724e3d42b0c2"),
    (Strategy.FPE_ID, None, "0", "1052068199"),
    (Strategy.FPE_ID, None, "1", "12227206"),
    (Strategy.FPE_ID, None, "12345", "1977275239"),
    (Strategy.FPE_ID, None, "2147483647", "810606478"),
    (Strategy.FPE_ID, None, "2147483648", "669670335384499127"),
    (Strategy.FPE_ID, None, "999999999999999999", "916190997715510029"),
    (Strategy.FPE_UUID, None, "550e8400-e29b-41d4-a716-446655440000", "d812e7ac-b87b-40e4-9888-743ec5975671"),
    (Strategy.FPE_UUID, None, "00000000-0000-0000-0000-000000000000", "4ec178b9-c553-490e-9209-79fbdc1f7d9e"),
    (Strategy.FPE_UUID, None, "550E8400-E29B-41D4-A716-446655440000", "d812e7ac-b87b-40e4-9888-743ec5975671"),
    (Strategy.MASK, SemanticType.PHONE, "0612345678", "061*****78"),
    (Strategy.MASK, SemanticType.PHONE, "12345", "*****"),
    (Strategy.MASK, SemanticType.IP_ADDRESS, "192.168.1.42", "192.168.*.*"),
    (Strategy.MASK, SemanticType.IP_ADDRESS, "1.2", "1.2.*.*"),
    (Strategy.MASK, SemanticType.EMAIL, "alice@example.com", "a***"),
    (Strategy.MASK, SemanticType.EMAIL, "x", "x***"),
    (Strategy.FAKE, SemanticType.IP_ADDRESS, "192.168.1.42", "216.75.143.106"),
    (Strategy.FAKE, SemanticType.IP_ADDRESS, "10.0.0.1", "216.177.92.82"),
    (Strategy.NULLIFY, None, "secret-value", None),
    (Strategy.KEEP, None, "preserve-me-verbatim", "preserve-me-verbatim"),
]
EMAIL_SUFFIX = [("alice@example.com", "934b0e"), ("ALICE@EXAMPLE.COM", "934b0e"), ("müller@österreich.at", "e037e3")]


@pytest.mark.parametrize("strategy", sorted({g[0] for g in GOLDEN}, key=str))
def test_golden_vectors(spark, strategy):
    for kind in {g[1] for g in GOLDEN if g[0] == strategy}:
        rows = [(v, w) for s, k, v, w in GOLDEN if s == strategy and k == kind]
        df = spark.createDataFrame(rows, "v string, w string")
        got = df.select("w", transformed(F.col("v"), strategy, kind, SECRETS).cast("string").alias("x")).collect()
        assert [r.x for r in got] == [r.w for r in got]


def test_email_suffix(spark):
    df = spark.createDataFrame(EMAIL_SUFFIX, "v string, w string")
    for r in df.select("w", fake(F.col("v"), SemanticType.EMAIL, SECRETS).alias("x")).collect():
        user, domain = r.x.split("@")
        assert user.endswith("." + r.w) and user == user.lower() and "." in domain


@pytest.mark.parametrize("strategy", list(Strategy))
def test_null_stays_null(spark, strategy):
    for kind in [None] if strategy != Strategy.FAKE else [k for k in SemanticType if k != SemanticType.JSONB]:
        df = spark.createDataFrame([(None,)], "v string")
        assert df.select(transformed(F.col("v"), strategy, kind, SECRETS).alias("x")).first().x is None


@pytest.mark.parametrize("algorithm,name", [("HmacSHA256", "sha256"), ("HmacSHA512", "sha512"), ("HmacSHA1", "sha1")])
@pytest.mark.parametrize("secret", ["s" * 16, "é" * 90])
def test_hmac_against_library(spark, algorithm, name, secret):
    keys = Secrets(secret, "0" * 16, algorithm)
    values = ["", "a", "Ünï", "x" * 500]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", crypto.hmac_hex(F.col("v"), keys).alias("h"), crypto.long_key(F.col("v"), keys).alias("k"), crypto.fingerprint(F.col("v"), keys).alias("f")).collect()
    for r in got:
        d = hmac.new(secret.encode(), r.v.encode(), name).digest()
        assert (r.h, r.k, r.f) == (d.hex(), int.from_bytes(d[:8], "big", signed=True), d.hex()[:8])
    null = hmac.new(secret.encode(), b"null", name).hexdigest()[:8]
    assert spark.range(1).select(crypto.fingerprint(F.lit(None), keys).alias("f")).first().f == null


def test_fpe_is_a_bijection_on_a_range(spark):
    df = spark.range(50_000).select(crypto.encrypt_id(F.col("id"), SECRETS).alias("x"))
    assert df.distinct().count() == 50_000 and df.where("x < 0 or x > 2147483647").count() == 0
    text = spark.createDataFrame([(" 12345 ",)], "v string").select(crypto.encrypt_id(F.col("v"), SECRETS).alias("x"))
    assert text.first().x == 1977275239


@pytest.mark.parametrize("bad", ["-1", "1000000000000000000", "abc", "", "1.5", "99999999999999999999"])
def test_fpe_refuses(spark, bad):
    with pytest.raises(Exception, match="ANON_FPE_ID_OUT_OF_RANGE"):
        spark.createDataFrame([(bad,)], "v string").select(crypto.encrypt_id(F.col("v"), SECRETS)).collect()


def test_longer_fpe_keys(spark):
    for size in (24, 32):
        got = spark.range(2000).select(crypto.encrypt_id(F.col("id"), Secrets("h" * 16, "k" * size)).alias("x"))
        assert got.distinct().count() == 2000


def test_fakes_have_their_formats(spark):
    df = spark.range(300).select(F.concat(F.lit("Value "), F.col("id")).alias("v"))
    for locale in ("fr", "en", "xx"):
        keys = Secrets(SECRETS.hmac_secret, SECRETS.fpe_key, locale=locale)
        got = df.select(*(fake(F.col("v"), k, keys).alias(k.name) for k in SemanticType if k != SemanticType.JSONB)).collect()
        for r in got:
            assert all(r) and r.IBAN[:2] == "FR" and len(r.IBAN) == 27
            assert int(r.IBAN[4:] + "1527" + r.IBAN[2:4]) % 97 == 1
            parts = list(map(int, r.IP_ADDRESS.split(".")))
            assert 1 <= parts[0] <= 223 and 1 <= parts[3] <= 254 and max(parts) < 256
    with pytest.raises(RuleError):
        fake(F.col("v"), SemanticType.JSONB, SECRETS)


def test_mask_edges(spark):
    df = spark.createDataFrame([("",), ("abcdef",), ("héllo",)], "v string")
    got = [tuple(r) for r in df.select(mask(F.col("v")), mask(F.col("v"), SemanticType.PHONE), mask(F.col("v"), SemanticType.IP_ADDRESS)).collect()]
    assert got == [("", "", "*.*.*.*"), ("a***", "abc*ef", "*.*.*.*"), ("h***", "*****", "*.*.*.*")]


def test_json_leaves(spark):
    docs = [None, "nope", "[1]", "3", "{}", '{"a":null}', '{"a":{"b":5,"z":[1,{"q":2.5}]},"f":1.5,"t":true,"s":"x","o":{"p":1}}']
    mark = lambda text, typed=False: lambda v: (F.lit(text) if isinstance(text, str) else text, typed)
    paths = [("$.a.b", mark("77")), ("f", mark("2.25")), ("t", mark("FALSE")), ("$.s", lambda v: (F.concat(v, v), False)), ("$.o", lambda v: (F.concat(v, F.lit("!")), False)), ("$.s.deep", mark("no")), ("$.missing", mark("no")), (" ", mark("no"))]
    got = [r.x for r in spark.createDataFrame([(d,) for d in docs], "d string").select(rewrite(F.col("d"), paths).alias("x")).collect()]
    assert got[:4] == docs[:4] and json.loads(got[4]) == {} and json.loads(got[5]) == {"a": None}
    assert json.loads(got[6]) == {"a": {"b": 77, "z": [1, {"q": 2.5}]}, "f": 2.25, "t": False, "s": "xx", "o": "!"}
    drift = spark.createDataFrame([('{"n":5,"t":true}',)], "d string").select(rewrite(F.col("d"), [("n", mark("abc")), ("t", mark("maybe"))]).alias("x")).first().x
    assert json.loads(drift) == {"n": "abc", "t": "maybe"}
    null = spark.createDataFrame([('{"n":5}',)], "d string").select(rewrite(F.col("d"), [("n", lambda v: (F.lit(None).cast("string"), False))]).alias("x")).first().x
    assert json.loads(null) == {"n": None}
    typed = spark.createDataFrame([('{"n":5}',)], "d string").select(rewrite(F.col("d"), [("n", lambda v: (v.cast("long") + 1, True))]).alias("x")).first().x
    assert json.loads(typed) == {"n": 6}
    assert segments("$.a.b") == ["a", "b"] and segments("a") == ["a"] and segments(None) == []


def test_json_failure_fails_the_run(spark):
    rules = RuleSet(rules=(ColumnRule("t", "d", Strategy.FAKE, SemanticType.JSONB, (JsonPath("$.id", Strategy.FPE_ID),)),))
    df = spark.createDataFrame([('{"id":"abc"}',)], "d string")
    with pytest.raises(Exception, match="ANON_FPE_ID_OUT_OF_RANGE"):
        pseudonymized(df, "t", rules, SECRETS).collect()


def test_projection_keeps_types_and_other_columns(spark):
    df = spark.createDataFrame([(1, 2, "n", 3.5, str(uuid.UUID(int=7)))], "a int, b long, c string, d double, e string")
    rules = RuleSet(rules=(ColumnRule("t", "A", Strategy.FPE_ID), ColumnRule("t", "b", Strategy.FPE_ID), ColumnRule("t", "d", Strategy.NULLIFY), ColumnRule("t", "e", Strategy.FPE_UUID), ColumnRule("x", "c", Strategy.HASH)))
    out = pseudonymized(df, "t", rules, SECRETS)
    assert out.dtypes == df.dtypes
    r = out.first()
    assert r.a == 12227206 and r.c == "n" and r.d is None and uuid.UUID(r.e).version == 4
    assert "MapInArrow" not in out._jdf.queryExecution().toString() and "PythonUDF" not in out._jdf.queryExecution().toString()


def test_copy_text(spark):
    df = spark.createDataFrame([(1, "a\tb\\c\nd\re", None, bytearray(b"x"))], "i int, s string, n string, b binary")
    with pytest.raises(RuleError):
        copy_rows(df)
    assert copy_rows(df, drop_binary=True).first().line == "1\ta\\tb\\\\c\\nd\\re\t\\N\t\\N"
    assert df.select(escaped(F.col("n")).alias("x")).first().x == "\\N"


def test_secrets_do_not_show():
    assert "hmac" not in repr(SECRETS).split("algorithm")[0].replace("hmac_secret", "") and SECRETS.fpe_key not in repr(SECRETS)
    import re

    assert re.search(crypto.REDACTION, "X'" + "5c" * 64 + "'")
    assert hashlib.sha256(b"").hexdigest()
