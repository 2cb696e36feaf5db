import os

import numpy as np
import pyarrow as pa

from lamina.llm import common
from lamina.llm.graph import components


def test_run_hashes_depend_on_content_alone():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    data[3000:3400] = data[100:500]
    a, b = np.array([100, 120, 100, 7]), np.array([500, 130, 100, 8])
    shift = np.array([2900, 2900, 2900, 0])
    first, second = common.run_hashes(data, a, b), common.run_hashes(data, a + shift, b + shift)
    assert (first == second).all() and len(set(first.tolist())) == 4
    starts = np.arange(0, 4990)
    assert len(np.unique(common.run_hashes(data, starts, starts + 10))) >= 4990 - 400


def test_words_and_runs():
    texts = common.string_array(pa.array(["One two", None, "", " a\tb\x0bc ", "é ONE"]))
    hashes, owner = common.word_hashes(texts)
    assert owner.tolist() == [0, 0, 3, 3, 3, 4, 4] and hashes[0] == hashes[-1]
    data, starts, stops, owner = common.class_runs(common.string_array(pa.array(["Hi!! you", "", "a.b"])))
    assert [bytes(data[a:b]) for a, b in zip(starts, stops)] == [b"hi", b"!!", b"you", b"a", b".", b"b"] and owner.tolist() == [0, 0, 0, 2, 2, 2]


def test_slices_cover_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["x" * n for n in (0, 5, 1, 50, 2, 2, 0)])], ["i", "t"])
    seen = [(rows.column(0).to_pylist(), texts.to_pylist()) for rows, texts in common.text_slices(batch, 1, limit=8)]
    assert [i for rows, _ in seen for i in rows] == list(range(7)) and all(len(a) == len(b) for a, b in seen)
    assert all(len("".join(t)) <= 8 or len(t) == 1 for _, t in seen)


def test_scratch_goes_when_told(spark):
    with common.ScratchScope() as scope:
        kept = common.written(spark.range(3), "one")
        gone = common.written(spark.range(4), "two")
    where = gone.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    common.discard(gone)
    assert not os.path.exists(where) and kept.count() == 3
    where = kept.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    scope.close(spark)
    assert not os.path.exists(where)
    common.discard(spark.range(1))


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200), (None, 5), (300, 100)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
