import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.llm import pieces, queries
from lamina.llm.pieces import MARK, ChunkTable, digest_reference, encode_decode, ids_of

PATH = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
TABLE = ChunkTable(open(PATH, "rb").read())


def exact(texts, table=TABLE):
    ids, ends = table.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == SP.encode(texts)


@settings(max_examples=800, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(f" {MARK}\n\t\raé漢🔐.‍́\0"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=4))
def test_chunks_equal_whole_texts(texts):
    assert TABLE.chunked and exact(texts)


def test_awkward_texts():
    assert exact(["", " ", "  ", "\n", " \n ", MARK, f"{MARK}{MARK} {MARK}a", "a" * 50_000, " " * 5000 + "x", "the " * 20_000, "﻿a b　c", "<s> </s> <unk> <0x41>"])


def test_small_table_and_whole_texts():
    table = ChunkTable(open(PATH, "rb").read(), most=3)
    for text in ("one two three four five", "six seven\neight", "one two"):
        assert exact([text], table)
    table.chunked = False
    assert exact(["one two", ""], table)


def test_rows_and_digests(spark):
    rows = [(1, None), (2, ""), (3, "Hello  wörld\n"), (3, "Hello  wörld\n"), (None, f"a{MARK}b"), (5, "x" * 3000)]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, ids long")
    got = sorted(map(tuple, encode_decode(docs, PATH).collect()), key=str)
    want = sorted(((i, bytes(b), d) for i, b, d in ((i, _blob(t), SP.decode(SP.encode(t or "", add_bos=True, add_eos=True))) for i, t in rows)), key=str)
    assert sorted(((i, bytes(b), d) for i, b, d in got), key=str) == want
    assert ids_of(got[0][1])[0] == SP.bos_id()
    assert encode_decode(docs.limit(0), PATH).count() == 0


def _blob(text):
    import numpy as np

    return np.array(SP.encode(text or "", add_bos=True, add_eos=True), "<u4").tobytes()


def test_query(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = queries.op3_sentencepiece(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == {i: digest_reference(t, SP) for i, t in texts.items()}


@pytest.mark.parametrize("most", [1, 2000])
def test_table_starts_anew(most):
    table = ChunkTable(open(PATH, "rb").read(), most)
    for i in range(0, 60, 3):
        assert exact([f"w{k} v{k % 3} " + "y" * (600 if k % 7 == 0 else 5) for k in range(i, i + 3)], table)
        assert table.size <= most + 10 * (pieces.CHUNK_COST + 700)


def test_kept_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "s", [1]), (2, None, None, None)], "doc_id long, text string, _text string, n array<int>")
    out = encode_decode(docs, PATH, keep=("text", "_text", "n"))
    assert out.columns == ["doc_id", "text", "_text", "n", "ids", "decoded"]
    assert sorted((r.doc_id, r.text, r._text, r.decoded) for r in out.collect()) == [(1, "a b", "s", "a b"), (2, None, None, "")]
