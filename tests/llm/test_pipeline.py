import re

import corpus_pipeline
import public_tokenizers
import sentencepiece

from lamina.llm import decontaminate, personal
from lamina.llm.pieces import digest_reference
from tests.llm.test_jaccard import brute


def test_pipeline_against_plain_version(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = {r.doc_id: r.text for r in rows if re.search(r"[^\W\d_]", r.text or "")}
    first = brute(list(docs.items()), corpus_pipeline.WIDTH, corpus_pipeline.PERCENT)
    docs = {i: t for i, t in docs.items() if first[i][1] == i}
    # every planted passage here is verbatim
    docs = {i: t for i, t in docs.items() if not any(x in decontaminate.normal(t) for x in items)}
    for i, t in docs.items():
        out, done = [], 0
        for a, kind, b in personal.base_spans(t):
            if a >= done:
                out += [t[done:a], f"[{personal.KINDS[kind].upper()}]"]
            done = max(done, b)
        docs[i] = "".join(out) + t[done:]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: digest_reference(t, sp) for i, t in docs.items()}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out} == want and 0 < len(out) == len(want) < len(rows)
    assert all(r.text == docs[r.doc_id] and len(r.ids) == 4 * r.n_tokens for r in out)


def test_stages_keep_columns_and_take_odd_rows(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the and of it " * 20, "en", None, 5), (3, "the and of it " * 20, "en", None, 5), (4, "77 12 +", "fr", "s", 6), (None, "a text without an id", None, "s", 1)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            out.collect()
    kept = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(odd, schema), sf_dir)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4]
    kept = corpus_pipeline.language_stage(spark, spark.createDataFrame(odd, schema), sf_dir)
    assert {r.doc_id for r in kept.collect()} == {3, None}


def test_rows_without_own_id_are_redacted(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    texts = [(None, "write to a.b@example.com now"), (None, "call +44 20 7946 0958 or 10.1.2.3"), (7, "ask c@d.org"), (7, "of plain words, then e@f.org"), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], schema)
    out = corpus_pipeline.personal_stage(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == [(0, "call [PHONE] or [IP]"), (0, "write to [EMAIL] now"), (7, "ask [EMAIL]"), (7, "of plain words, then [EMAIL]"), (8, "")]
    assert all(r.n_chars == len(r.text) for r in out if r.text)


def test_stages_with_clashing_columns(spark, sf_dir):
    base = "doc_id long, text string, lang string, source string, n_chars long"
    extra = "_k int, row string, `order` string, doc string, component_id string, spans string, more string, `a b` string"
    text = "the and of it in a house by the sea where nobody writes to a@b.co any more"
    rows = [(9, text, "en", "s", 1), (4, text, "en", "t", 1), (None, text, "en", "s", 1), (4, text, "en", "a", 1), (4, "another text of the same number that has nothing in common with it", "en", "s", 1), (None, None, "en", "s", 1), (None, None, "en", "s", 1)]
    docs = spark.createDataFrame([(*r, k, "r", "o", "d", "c", "s", "m", "ab") for k, r in enumerate(rows)], f"{base}, {extra}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert all((r["row"], r["order"], r["doc"], r["a b"]) == ("r", "o", "d", "ab") for r in out.collect())
    first = {tuple(r) for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir).collect()}
    second = {tuple(r) for r in corpus_pipeline.near_duplicate_stage(spark, docs.repartition(5), sf_dir).collect()}
    assert first == second and sorted((r[0] or 0, (r[1] or "")[:3]) for r in first) == [(0, ""), (0, ""), (4, "ano"), (4, "the")]
    redacted = corpus_pipeline.personal_stage(spark, docs, sf_dir).collect()
    assert len(redacted) == len(rows) and sum("[EMAIL]" in (r.text or "") for r in redacted) == 4
