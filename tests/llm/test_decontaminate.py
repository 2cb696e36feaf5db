import random

from lamina.llm import decontaminate as d


def distance_in(pattern, text):
    """Smallest edit distance of pattern to a substring of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


def test_myers_equals_table():
    rng = random.Random(3)
    for _ in range(200):
        p = "".join(rng.choices("abc", k=rng.randint(1, 80)))
        t = "".join(rng.choices("abc", k=rng.randint(0, 100)))
        assert d.myers(p, d._masks(p), t)[0] == distance_in(p, t)


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        i, how = rng.randrange(len(text)), rng.randrange(3)
        text[i : i + 1] = [[], [text[i], rng.choice("qxz")], [rng.choice("qxz")]][how]
    return "".join(text)


def test_matches_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(rng.choice([4, 12, 30])))) for i in range(12)] + [(12, None), (13, ""), (14, "hi"), (None, "a b c")]
    items.append((15, items[0][1]))
    docs = [(0, None), (1, ""), (2, " ".join(word() for _ in range(3000)))]
    for k in range(60):
        _, text = items[rng.randrange(12)]
        filler = " ".join(word() for _ in range(rng.randint(0, 40)))
        docs.append((len(docs), f"{filler}, {edited(rng, text, rng.randint(0, 25))}! {filler}".upper() if k % 2 else f"{filler} {text}"))
    docs.append((7, docs[7][1]))
    got = d.find_items(spark.createDataFrame([(i, t, "own") for i, t in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = []
    for i, t in docs:
        for n, x in items:
            p, text = d.normal(x), d.normal(t)
            if p and n is not None and (best := distance_in(p, text)) <= d.budget(len(p)) and (d.budget(len(p)) or f" {p} " in f" {text} "):
                want.append((i, n, best))
    assert sorted((r[0], r[1], r.distance) for r in got) == sorted(want)
    names, texts = dict((n, d.normal(x)) for n, x in items), dict(docs)
    for r in got:
        part = d.normal(texts[r[0]])[r.start : r.stop]
        assert distance_in(names[r[1]], part) == r.distance and abs(len(part) - len(names[r[1]])) <= r.distance


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert d.find_items(docs, items).count() == 0
    assert d.without_items(spark.createDataFrame([(1, "x"), (None, None)], "doc_id long, text string"), items).count() == 2


def test_whole_edit_share(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    items, docs = [], []
    for size in (10, 20, 27, 30, 60, 113, 200, 240, 340) * 3:
        text = " ".join(word() for _ in range(size))[:size].strip()
        n, k = len(items), int(0.10 * len(text))
        items.append((n, text))
        put = list(text)
        for i in rng.sample(range(len(text)), k):  # substitutions spread over the item: the most that a tenth allows
            put[i] = "z"
        filler = " ".join(word() for _ in range(20))
        docs.append((n, f"{filler} {''.join(put)} {filler}"))
        docs.append((1000 + n, f"{filler} {edited(rng, text, k)} {filler}"))
    found = d.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: r.distance for r in found.where("doc_id % 1000 = item_id").collect()}
    own = {i: (d.normal(items[i % 1000][1]), d.normal(t)) for i, t in docs}
    want = {i: best for i, (x, t) in own.items() if (best := distance_in(x, t)) <= int(0.10 * len(x))}
    assert got == want
    assert sum(got[n] == int(0.10 * len(x)) for n, x in items if n in got) > 15


def test_blocks_of_items_and_short_items(spark, monkeypatch):
    """Many blocks find what one block finds; an item without edits needs whole words; odd rows and columns stay."""
    rng = random.Random(33)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 8, 20])))) for i in range(30)] + [(30, "x"), (31, None), (None, "zzz")]
    docs = [(i, " ".join(word() for _ in range(30)) + f" {edited(rng, items[i % 30][1], i % 3)} end") for i in range(90)]
    docs += [(100, "axa xa ax"), (101, "a x b"), (102, None), (103, ""), (None, "X"), (104, "a x b"), (104, "a x b"), (105, "long " * 50_000 + "x.")]
    docs = spark.createDataFrame([(i, t, i, "k") for i, t in docs], "doc_id long, text string, item_id long, distance string")
    items = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, d.find_items(docs, items).collect()), key=str)
    stay = sorted(map(tuple, d.without_items(docs, items).collect()), key=str)
    monkeypatch.setattr(d, "BLOCK_CHARS", 200)
    assert len(list(d._item_blocks(items, "item_id", "text", 0.1))) > 3
    assert sorted(map(tuple, d.find_items(docs, items).collect()), key=str) == one
    assert sorted(map(tuple, d.without_items(docs, items).collect()), key=str) == stay
    by = {r[0] for r in one if r[1] == 30}
    assert by == {101, 104, None, 105} and sum(r[0] == 104 and r[1] == 30 for r in one) == 2
    assert {r[0] for r in stay} >= {100, 102, 103} and all(r[3] == "k" for r in stay)


def test_query(spark, sf_dir):
    from lamina.llm.queries import op1_decontaminate

    items = {r.item_id: d.normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    docs = {r.doc_id: d.normal(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {(r.doc_id, r.item_id): r for r in op1_decontaminate(spark, sf_dir).collect()}
    whole = {(i, n) for i, t in docs.items() for n, x in items.items() if x and f" {x} " in f" {t} "}
    assert whole and whole <= {k for k, r in got.items() if r.distance == 0}
    for (i, n), r in got.items():
        assert distance_in(items[n], docs[i][r.start : r.stop]) == r.distance <= d.budget(len(items[n]))
