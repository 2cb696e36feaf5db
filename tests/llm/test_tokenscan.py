import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lamina.llm import queries, tokenscan
from lamina.llm.tokenscan import file_blocks, named_counts, scan, token_blocks

SEP = 7


def plain(files):
    out = []
    for name, ids in files.items():
        n = k = 0
        for i in ids:
            if i == SEP:
                out.append((name, k, n, True))
                n, k = 0, k + 1
            else:
                n += 1
        if n:
            out.append((name, k, n, False))
    return sorted(out)


@pytest.mark.parametrize("block,run", [(1, 1), (3, 2), (4, 3), (1000, 1024)])
def test_against_plain_scan(spark, block, run):
    rng = random.Random(block)
    files = {f"f{k}": [SEP if rng.random() < p else rng.randrange(8, 99) for _ in range(n)] for k, (n, p) in enumerate([(0, 0), (1, 1), (5, 1), (40, 0.0), (60, 0.1), (61, 0.5), (30, 0.03), (12, 0.9)])}
    rows = [(f, b, bytearray(np.array(ids[b * block : (b + 1) * block], "<u2").tobytes())) for f, ids in files.items() for b in range(-(-len(ids) // block))]
    rng.shuffle(rows)
    blocks = spark.createDataFrame([(*r, 1) for r in rows], "file string, block long, payload binary, n long").repartition(5)
    got = sorted(tuple(r) for r in scan(blocks, SEP, run_blocks=run).select("file", "ordinal", "n_tokens", "terminated").collect())
    assert got == plain(files)


def test_null_payload_and_empty(spark):
    blocks = spark.createDataFrame([("a", 0, bytearray(b"\x07\x00")), ("a", 1, None), ("a", 2, bytearray(b"\x09\x00\x07\x00"))], "file string, block long, payload binary")
    assert sorted((r.ordinal, r.n_tokens) for r in scan(blocks, SEP).collect()) == [(0, 0), (1, 1)]
    assert scan(blocks.limit(0), SEP).count() == 0


@pytest.mark.parametrize("width,arrow", [(2, True), (4, True), (2, False)])
def test_files(spark, tmp_path, width, arrow, monkeypatch):
    monkeypatch.setattr(tokenscan, "RANGE_BYTES", 12)
    if not arrow:
        monkeypatch.setattr(tokenscan, "ARROW_STORES", ())
    files = {"a.bin": [8, 9, SEP, SEP, 10], "b.bin": list(range(8, 40)) + [SEP], "c.bin": []}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, f"<u{width}").tobytes())
    got = scan(file_blocks(spark, str(tmp_path), width, block_ids=3), SEP, width).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.ordinal, r.n_tokens, r.terminated) for r in got) == plain(files)
    assert scan(file_blocks(spark, str(tmp_path), width, block_ids=3), SEP, width).count() == len(plain(files))
    (tmp_path / "_SUCCESS").write_bytes(b"x")
    (tmp_path / "d.bin").write_bytes(b"x")
    with pytest.raises(Exception, match="no whole number"):
        file_blocks(spark, str(tmp_path), width).collect()


def codec():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(queries.BYTE_RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_documents_round_trip(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    enc = codec()
    got = {r.doc_id: r.n_tokens for r in queries.op10_token_counts(spark, sf_dir).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in texts.items()}


@pytest.mark.parametrize("block", [1, 5, 1 << 18])
def test_odd_documents(spark, block, monkeypatch):
    rows = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (None, "<|endoftext|> is text"), (4, "x" * 20_000)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, file int").repartition(2)
    enc = codec()
    monkeypatch.setattr(tokenscan, "RUN_BLOCKS", 2)
    blocks = token_blocks(docs, public_tokenizers.path(queries.BYTE_RANKS), public_tokenizers.PATTERN, queries.BYTE_SEPARATOR, block_ids=block)
    got = named_counts(blocks, queries.BYTE_SEPARATOR).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, len(enc.encode_ordinary(t or ""))) for i, t in rows), key=str)
    assert tokenscan.BLOCK_IDS == 1 << 18
