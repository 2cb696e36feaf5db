import itertools
import zlib

import numpy as np
import public_tokenizers

from lamina.llm import language, queries
from lamina.llm.language import MARK, Lattice, held_out, in_known_language, predict, train, vocabulary

PIECES = [MARK, "a", "b", "ab", f"{MARK}a", "ba", f"{MARK}ab", "abab"]


def segmentations(word):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in PIECES or n == 1:
            for rest in segmentations(word[n:]):
                yield [PIECES.index(word[:n]) if word[:n] in PIECES else len(PIECES), *rest]


def test_forward_and_expected_sum_all_segmentations():
    rng = np.random.default_rng(0)
    p = rng.random((len(PIECES) + 1, 2))
    words = ["".join(w) for n in range(1, 6) for w in itertools.product("abz", repeat=n)]
    lattice = Lattice(PIECES)
    total = np.exp(lattice.log_totals(words, p))
    weights = rng.random((len(words), 2))
    counts = np.zeros((len(PIECES) + 1, 2))
    for i, w in enumerate(words):
        ways = list(segmentations(MARK + w))
        assert np.allclose(total[i], sum(p[s].prod(0) for s in ways))
        mass = [p[s, 0].prod() for s in ways]
        for s, m in zip(ways, mass):
            for k in s:
                counts[k] += m / sum(mass) * weights[i]
    assert np.allclose(lattice.expected(words, weights, p[:, :1]), counts)


def plain_log_total(pieces, p, word):
    """log of the forward probability, one position after another with logarithms."""
    number = {x: i for i, x in enumerate(pieces)}
    longest = max(map(len, pieces))
    marked = MARK + word
    alpha = [np.zeros(p.shape[1])]
    for j in range(1, len(marked) + 1):
        ways = []
        for l in range(1, min(j, longest) + 1):
            at = number.get(marked[j - l : j], len(pieces) if l == 1 else None)
            if at is not None:
                ways.append(alpha[j - l] + np.log(p[at]))
        alpha.append(np.logaddexp.reduce(ways))
    return alpha[-1]


def test_long_words_and_whole_vocabulary():
    """Words of any length over all pieces of any length, where a product would underflow."""
    rng = np.random.default_rng(3)
    pieces = vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    p = rng.dirichlet(np.full(len(pieces) + 1, 0.3), 2).T + 1e-10
    lattice = Lattice(pieces)
    runs = [x.strip(MARK) for x in pieces if len(x) > 11]
    words = ["a", "zu", "internationalization", "漢字" * 30, "".join(runs[:40]), "x" * 700] + ["".join(rng.choice(list("abcdeäñ"), n)) for n in (23, 24, 25, 47, 48, 49, 96, 300)] + runs[:60]
    words = list(dict.fromkeys(words))
    got = {w: x for part in language.batches_of(words) for w, x in zip(part, lattice.log_totals(part, p))}
    assert got.keys() == set(words)
    for w in words:
        assert np.allclose(got[w], plain_log_total(pieces, p, w), rtol=1e-9), w


def test_expected_counts_of_long_words():
    """Every segmentation covers the marked word once, so expected counts weighted by piece length give its length; a word's counts do not depend on its batch."""
    rng = np.random.default_rng(4)
    pieces = vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    p = (rng.dirichlet(np.full(len(pieces) + 1, 0.5)) + 1e-9)[:, None]
    lattice = Lattice(pieces)
    sizes = np.array([*map(len, pieces), 1])
    words = ["the", "x" * 23, "y" * 24, "z" * 25, "wörter" * 30, "ab" * 24, "q" * 500, "a"]
    every = lattice.expected(words, np.eye(len(words)), p)
    assert np.allclose(sizes @ every, [len(w) + 1 for w in words])
    for i, w in enumerate(words):
        assert np.allclose(lattice.expected([w], np.ones((1, 1)), p)[:, 0], every[:, i])


def test_vocabulary_is_whole():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = vocabulary(path)
    able = {x for x in map(sp.id_to_piece, range(sp.get_piece_size())) if (x.strip(MARK) or x == MARK) and x == x.lower() and (x == MARK or language.LETTERS.fullmatch(x.removeprefix(MARK)))}
    assert len(pieces) == len(set(pieces)) and able - {"<unk>", "<s>", "</s>"} == set(pieces) and max(map(len, pieces)) > 12


def test_held_out_accuracy_and_contract(spark, sf_dir):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op9_language(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == rows[r.doc_id].lang for r in held]) >= 0.97


def test_odd_rows(spark):
    train_rows = [(i, "the cat and the dog", "en") for i in range(8)] + [(i, "der hund und die katze", "de") for i in range(20, 28)]
    odd = [(100, None, "en"), (101, "", None), (102, "12 34 _ ²", "en"), (103, "the dog", None), (103, "the dog", None), (None, "und die", "xx"), (105, "katze" * 4000, "en"), (106, "漢字", "de")]
    docs = spark.createDataFrame([(*r, 1.0, "c") for r in train_rows + odd], "doc_id long, text string, lang string, score double, source string")
    pieces = vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    langs, p = train(docs.where("doc_id < 50").where(~held_out()), pieces)
    assert langs == ["de", "en"] and np.allclose(p.sum(0), 1)
    got = [(r.doc_id, r.lang_pred) for r in predict(docs, pieces, langs, p).collect()]
    assert len(got) == docs.count()
    by = dict(got)
    assert (by[100], by[101], by[102], by[103], by[None], by[105]) == ("und", "und", "und", "en", "de", "de")
    kept = in_known_language(docs, pieces, langs, p)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint({100, 101, 102})
    langs, p = train(docs.limit(0), pieces)
    assert langs == [] and {r.lang_pred for r in predict(docs, pieces, langs, p).collect()} == {"und"}
    assert predict(docs.limit(0), pieces, ["de"], p[:, :0]).count() == 0
    twice, q = train(docs.where("doc_id < 50"), pieces, passes=2)
    assert twice == ["de", "en"] and np.allclose(q.sum(0), 1)
