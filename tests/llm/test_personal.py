import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.llm import personal as p
from lamina.llm.queries import op2_personal

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        x = int(c) * (1 + i % 2)
        total += x // 10 + x % 10
    return total % 10 == 0


def plain(text):
    spans = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(spans)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="aZ09.@+-_% (),é\n", max_size=60))
def test_base_spans(text):
    assert p.base_spans(text) == plain(text)


def test_base_spans_of_planted_values():
    rng = random.Random(2)
    parts = ["a@b.co", "x@y", "1.2.3.4", "1.2.3.256", "001.2.3.4.5", "+1 (555) 123-4567", "4111 1111 1111 1111", "4111-1111-1111-1112", "@q.r", "é@b.c", "12", "+", ", ", " ", "\n", "u@v.w@x.y.z"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 9)))
        assert p.base_spans(text) == plain(text)


def test_long_runs_are_linear():
    for text in ("a" * 400_000 + "@", "1" * 400_000, "1." * 200_000, "a@" * 200_000, "+1" * 200_000, ("b" * 300_000) + "@x.y"):
        p.base_spans(text)
    assert p.base_spans("b" * 300_000 + "@x.y") == [(0, 0, 300_004)]


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"some words here call me at +1 555 000 {1000 + i} today please") for i in range(8)]
    rows += [(20, "now call me at 555.0199 today please"), (21, "version 555.0199 of it"), (22, "see page 77777 today"), (23, None), (24, ""), (25, "no data")]
    rows.append((20, rows[8][1]))
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, base string, value int")
    got = p.find_personal(docs).select("doc_id", p.spelled("base").alias("b"), p.spelled("spans").alias("s")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[20].b == "" and by[20].s == "phone:15:23"
    assert by[22].s == by[23].s == by[24].s == by[25].s == "" and by[0].b == by[0].s != ""


def test_redaction_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co or +1 555 000 1234.", "k"), (2, None, "k"), (3, "plain", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in p.redacted(docs).collect()}
    assert got[1].text == "mail [EMAIL] or [PHONE]." and got[2].text is None and got[3].text == "plain" and got[1].lang == "k"
    assert p.find_personal(docs.limit(0)).count() == 0 and p.redacted(docs.limit(0)).count() == 0


def digest(text):
    """Counts and base_sha256 of one text by the plain patterns."""
    spans = plain(text or "")
    spelled = ",".join(f"{p.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return (*(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(spelled.encode()).hexdigest())


def test_query_against_plain_patterns(spark, tmp_path):
    for where in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        want = {r.doc_id: digest(r.text) for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()}
        got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in op2_personal(spark, where).collect()}
        assert got == want and len({w[:4] for w in want.values()}) > 4
    rows = [(None, "a@b.co"), (None, "1.2.3.4 and 5.6.7.8"), (1, None), (2, ""), (3, "+44 20 7946 0958"), (3, "+44 20 7946 0958"), (3, "c@d.org e@f.org"), (4, "word " * 60_000 + "4111 1111 1111 1111 " + "tail " * 60_000)]
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, row string, more int").write.parquet(str(tmp_path / "documents.parquet"))
    got = op2_personal(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted((i or 0, *digest(t)) for i, t in rows)
    assert {r.spans for r in got if r.doc_id == 4} == {"card:300000:300019"}


def test_accepted_values_induce_further_patterns(spark):
    """Seeds vouch for one pattern; what it discovers vouches for a second one, which no seed has; that discovers more."""
    rows = [(v, 3, "first") for v in ("s1", "s2", "s3", "s4", *(f"t{i}" for i in range(30)))] + [(f"n{i}", -1, "first") for i in range(5)]
    rows += [(f"n{i}", -1, "second") for i in range(5)] + [("far", -1, "second")]
    rows += [("s1", 3, "mixed"), *((f"x{i}", -1, "mixed") for i in range(9)), ("lone", -1, "none"), (None, -1, "first"), ("lone", -1, None)]
    seen = spark.createDataFrame(rows, "value string, kind int, pattern string")
    one = {(r.value, r.kind) for r in p.discover(seen, rounds=1).collect()}
    assert one == {(f"n{i}", 3) for i in range(5)}
    assert {(r.value, r.kind) for r in p.discover(seen, least_share=0.7, least_score=0.7).collect()} == one | {("far", 3)}
    assert p.discover(seen.limit(0)).count() == 0


def test_discovery_precision_and_recall(spark):
    """Phones without a plus sign after the words that lead to phones are found; numbers elsewhere are not."""
    rng = random.Random(5)
    rows, want = [], set()
    for i in range(400):
        noise = " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=6))
        if i % 4 == 0:
            rows.append((i, f"{noise} please call us on 555-{rng.randint(1000, 9999)}-{i:04d} {noise}"))
            want.add(i) if i % 20 == 0 else None
            if i % 20:
                rows[-1] = (i, f"{noise} please call us on +1 555 {rng.randint(100, 999)} {i + 1000} {noise}")
        else:
            rows.append((i, f"{noise} invoice {rng.randint(10000, 99999)} of {noise}"))
    got = p.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.doc_id for r in got if len(r.spans) > len(r.base)}
    assert found == want


def test_redaction_of_clashing_names(spark):
    docs = spark.createDataFrame([(None, "a@b.co", "k", "u", 1), (None, "plain", "k", "u", 2), (5, "c@d.org", None, "u", 3), (5, "c@d.org", None, "u", 3)], "doc_id long, text string, _id string, spans string, row int")
    out = p.redacted(docs)
    assert out.schema == docs.schema
    assert sorted((r.doc_id or 0, r.text, r._id or "", r.spans, r.row) for r in out.collect()) == [(0, "[EMAIL]", "k", "u", 1), (0, "plain", "k", "u", 2), (5, "[EMAIL]", "", "u", 3), (5, "[EMAIL]", "", "u", 3)]
