import random
import re

import pytest

from lamina.llm import jaccard


def brute(rows, width=4, percent=85):
    """rows of (id, text): {id: (n, component)} by comparing all pairs."""
    sets = {}
    for name, text in rows:
        words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        sets[name] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())
    label = {n: n for n in sets}
    names = sorted(sets)
    changed = True
    links = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if (sets[a] or sets[b]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {n: (len(sets[n]), label[n]) for n in names}


def family(rng, base, size, edits):
    out = []
    for _ in range(size):
        words = base.split()
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def rows_of(seed, groups, edits=3):
    rng = random.Random(seed)
    texts = [None, "", " \n", "one", "One", "one two three", "one two three four", "A  b\tc\nd"]
    hot = " ".join(f"h{i}" for i in range(12))
    for size in groups:
        base = " ".join(f"v{rng.randrange(300)}" for _ in range(rng.randint(30, 60)))
        texts += [t + " " + hot for t in family(rng, base, size, edits)]
    texts += texts[8:14]
    rng.shuffle(texts)
    return list(enumerate(texts))


def run(spark, rows):
    docs = spark.createDataFrame([(i, "x", t) for i, t in rows], "doc_id long, n string, text string").repartition(3)
    got = jaccard.link_components(docs).collect()
    assert len(got) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in got}


@pytest.mark.parametrize("small,block,local,ids,range_bytes", [(32, 512, 10**6, 100, 16 << 20), (3, 7, 10**6, 0, 500), (40, 512, 100, 0, 90), (2, 5, 50, 100, 3000)])
def test_against_brute_force(spark, monkeypatch, small, block, local, ids, range_bytes):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "LOCAL_GRAMS", local)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", ids)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(jaccard, "SLICE_BYTES", min(range_bytes, 400))
    rows = rows_of(5, [1, 1, 2, 3, 5, 40, 8])
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("percent,width", [(80, 5), (50, 2), (100, 4), (67, 3)])
def test_other_thresholds(spark, monkeypatch, percent, width):
    """Sizes that differ as much as the threshold allows, where the prefix filters are tight."""
    monkeypatch.setattr(jaccard, "SMALL", 4)
    rng = random.Random(percent)
    texts = []
    for _ in range(12):
        base = [f"v{rng.randrange(60)}" for _ in range(rng.randint(6, 40))]
        texts += [" ".join(base[: len(base) - k] + [f"t{rng.randrange(9)}" for _ in range(rng.randint(0, 2))]) for k in range(5)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(docs, width=width, percent=percent).collect()}
    assert got == brute(rows, width, percent)


def test_documents_that_share_a_passage_do_not_meet(spark, monkeypatch):
    """Thousands of unlinked documents around one passage: nothing is compared in blocks, and the one near copy is found."""
    rng = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(f"u{rng.randrange(10**7)}" for _ in range(30)) + " " + passage for _ in range(3000)]
    texts.append(texts[7] + " one")
    met = []
    monkeypatch.setattr(jaccard, "_block_links", lambda rows, percent: met.append(rows) or rows.select(rows["id"].alias("a"), rows["id"].alias("b")))
    got = run(spark, list(enumerate(texts)))
    assert not met and {i: c for i, (_, c) in got.items() if c != i} == {3000: 7}


def test_levels_are_counts(spark, monkeypatch):
    """The level of each n-gram is the logarithm of its occurrences over all blocks."""
    import numpy as np

    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words[:8] if k % 3 else words, k=rng.randint(0, 30))) for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    blocks = jaccard.written(jaccard.packed_blocks(docs, "doc_id", "text"), "t")
    counts = {}
    import pyarrow as pa

    h, _ = jaccard.shingles(pa.array(texts, pa.large_string()), 2)
    for k in jaccard._keys(h, 5).tolist():
        counts[k] = counts.get(k, 0) + 1
    offers = {(r.block, r.part): r for r in jaccard._offers(blocks, 2, 5).collect()}
    levels = {(r.block, r.part): r.levels for r in jaccard._levels(jaccard._offers(blocks, 2, 5), 5).collect()}
    _, loose = jaccard.codec()
    seen = set()
    for at, r in offers.items():
        steps = np.frombuffer(loose.decompress(r.grams), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
        keys = np.cumsum(steps, dtype=np.uint32).astype(np.int64) | (r.part << 32)
        got = np.frombuffer(loose.decompress(levels[at]), np.uint8) if at in levels else np.zeros(len(keys), np.uint8)
        assert [int(np.log2(counts[k])) for k in keys.tolist()] == got.tolist()
        seen |= set(keys.tolist())
    assert seen == set(counts)


@pytest.mark.parametrize("one_task", [0, 5, 100_000])
def test_components(spark, monkeypatch, one_task):
    from lamina.llm import graph

    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    rng = random.Random(one_task)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 3), (4, None), (5, 5)]
    label = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in range(200):
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(label) and dict(map(tuple, got)) == label
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_empty_and_null_ids(spark):
    assert jaccard.link_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (2, None), (None, "z")], "doc_id long, text string")
    got = sorted(map(tuple, jaccard.link_components(docs).collect()), key=str)
    assert got == sorted([(None, 2, 3), (3, 2, 3), (2, 0, 2), (None, 1, None)], key=str)


def test_overlaps_by_fragments():
    import numpy as np

    rng = np.random.default_rng(1)
    a = [np.unique(rng.integers(0, 60, 30)) for _ in range(5)]
    b = [np.unique(rng.integers(0, 60, 30)) for _ in range(4)]
    want = [[len(set(x) & set(y)) for y in b] for x in a]
    assert jaccard.overlaps(a, b, columns=7).tolist() == want


@pytest.mark.parametrize("width", [1, 2, 5, 9])
def test_few_words_for_the_width(width):
    import pyarrow as pa

    for texts in (["a b"], ["a"], [""], ["a b c", "", "d"], ["a b c d e f g h i j"], []):
        h, ends = jaccard.shingles(pa.array(texts, pa.large_string()), width)
        counts = [len(t.split()) for t in texts]
        assert (ends[1:] - ends[:-1]).tolist() == [n - width + 1 if n >= width else min(n, 1) for n in counts] and len(h) == ends[-1]


@pytest.mark.parametrize("large", [2, 10**6])
def test_large_classes(spark, monkeypatch, large):
    """Labels of large classes are broadcast, those of others joined; a class without an id keeps its null."""
    monkeypatch.setattr(jaccard, "LARGE", large)
    rows = [(i, "a b c d e f g h" if i % 3 else f"x{i} y z w v u t s") for i in range(60)] + [(60, "a b c d e f g h i"), (61, None)]
    assert run(spark, rows) == brute(rows)
    docs = spark.createDataFrame([(None, "p q r s t")] * 9 + [(1, "other words are here")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.link_components(docs).collect()), key=str) == sorted([(None, 2, None)] * 9 + [(1, 1, 1)], key=str)


def test_query(spark, sf_dir):
    from lamina.llm.queries import op8_jaccard

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = op8_jaccard(spark, sf_dir)
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and {r[0]: (r[1], r[2]) for r in got.collect()} == brute(rows)
