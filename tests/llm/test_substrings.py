import hashlib
import random

import numpy as np
import pytest

from lamina.llm import common, substrings
from lamina.llm.queries import op6_substrings


def brute(rows):
    """{position of the row: (bytes, spans, kept)} by a table of all windows."""
    L = substrings.LENGTH
    first = {}
    for name, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - L + 1):
            w = data[i : i + L]
            if name is not None:
                first[w] = min(first.get(w, name), name)
    out = []
    for name, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - L + 1):
            if name is not None and first[data[i : i + L]] < name:
                gone[i : i + L] = [True] * L
        spans = [i for i in range(len(data) + 1) if (gone[i - 1] if i else False) != (gone[i] if i < len(data) else False)]
        out.append((name, len(data), list(zip(spans[::2], spans[1::2])), bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(i, "x", t) for i, t in rows], "doc_id long, kept string, text string").repartition(3)
    got = substrings.remove_repeats(docs).collect()
    return sorted([(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got], key=str)


@pytest.mark.parametrize("block", [4 << 20, 600])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(common, "BLOCK_BYTES", block)
    monkeypatch.setattr(substrings, "STEP", 97)
    rng = random.Random(6)
    text = lambda n: "".join(rng.choices("ab é\n", k=n))
    passages = [text(rng.randint(30, 160)) for _ in range(6)] + ["-" * 120, "ab" * 60, "x" * 49, "y" * 50, "z" * 51]
    rows = [(i, rng.choice(["", text(rng.randint(0, 80))]) + "".join(rng.choice(passages) + text(rng.randint(0, 30)) for _ in range(rng.randint(0, 4)))) for i in rng.sample(range(-20, 400), 90)]
    rows += [(500, None), (501, ""), (502, rows[0][1]), (502, rows[0][1]), (None, rows[1][1]), (None, passages[0]), (503, "s" * 3000), (504, "s" * 200)]
    assert run(spark, rows) == brute(rows)


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got, want = run(spark, rows), brute(rows)
    assert got == want and any(spans for _, _, spans, _ in got)
    query = op6_substrings(spark, sf_dir).collect()
    assert sorted(map(tuple, query)) == sorted((i, n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in want)


def test_equal_windows_share_a_cover_position():
    rng = np.random.default_rng(2)
    window = rng.integers(97, 100, substrings.LENGTH).astype(np.uint8)
    offsets = []
    for _ in range(20):
        a, b = rng.integers(97, 100, rng.integers(0, 90)).astype(np.uint8), rng.integers(97, 100, rng.integers(0, 90)).astype(np.uint8)
        at, _ = substrings.cover(np.concatenate([a, window, b]), np.array([0, len(a) + len(window) + len(b)]))
        offsets.append({int(x) - len(a) for x in at if len(a) <= x <= len(a) + substrings.SIDE})
    assert set.intersection(*offsets)


def test_empty(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
