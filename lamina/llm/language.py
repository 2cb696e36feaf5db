"""Language identification: unigram pieces of a fixed public vocabulary, all segmentations summed."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import lean, text_slices

MARK = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
FLOOR = 1e-7
#: Positions of a word between two rescalings of its probabilities, and cells (words x positions) of a batch of words of like length.
STEP, CELLS = 24, 4096 * 24
#: Distinct words that a worker counts before it sums them up, and words and characters of words that it keeps scored.
COUNT_WORDS, TABLE_WORDS, TABLE_CHARS = 250_000, 400_000, 6_000_000


def held_out(id_col: str = "doc_id") -> Column:
    """True for rows whose crc32(id as text) mod 3 is 1; false for a null id."""
    return F.coalesce((F.crc32(F.col(id_col).cast("string").cast("binary")) % 3) == 1, F.lit(False))


def vocabulary(tokenizer_path: str) -> list[str]:
    """All pieces that can occur in a marked word of lower-case letters, of any length, in the order of the model's ids.

    Texts are lowered and cut into runs of letters, so no segmentation could hold another piece.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path)
    names = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)))
    return list(dict.fromkeys(p for p in names if p == p.lower() and re.fullmatch(rf"{MARK}?[^\W\d_]*", p) and p))


_BASE = np.uint64(0x100000001B3)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a polynomial hash over the leading bits."""
    with np.errstate(over="ignore"):
        return h * np.uint64(0x9E3779B97F4A7C15)


def batches_of(words: list[str]) -> Iterator[list[str]]:
    """Distinct words by length, cut so that a batch has about CELLS positions; a longer word stands alone."""
    words = sorted(words, key=len)
    start = 0
    while start < len(words):
        stop = start + 1
        while stop < len(words) and (stop + 1 - start) * (len(words[stop]) + 1) <= CELLS:
            stop += 1
        yield words[start:stop]
        start = stop


class Lattice:
    """All segmentations of a batch of words. Words of any length are walked STEP positions at a time, with probabilities rescaled in between."""

    def __init__(self, pieces: list[str]):
        self.n, self.longest = len(pieces), max(map(len, pieces), default=1)
        keys = mixed(np.array([self._key(p) for p in pieces], np.uint64))
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.known = np.zeros(1 << 20, bool)  # leading bits of any key: most substrings are no piece
        self.known[(keys >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
        return h

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths with the marker, and a matrix of characters (plus one; 0 behind a word)."""
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        codes = np.zeros((len(words), int(length.max())), np.uint64)
        flat = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le"), np.uint32)
        codes[np.arange(codes.shape[1]) < length[:, None]] = flat.astype(np.uint64) + np.uint64(1)
        return length, codes

    def arcs(self, codes: np.ndarray, start: int, stop: int) -> list[np.ndarray]:
        """For each piece length l an array (word, start..stop) of the pieces that begin there: n for an unknown character, -1 for none."""
        n, wide = stop - start, codes.shape[1]
        most = min(self.longest, wide - start)
        part = codes[:, start : stop + most - 1]
        if part.shape[1] < n + most - 1:
            part = np.pad(part, ((0, 0), (0, n + most - 1 - part.shape[1])))
        out, h = [], np.zeros((len(codes), n), np.uint64)
        with np.errstate(over="ignore"):
            for l in range(1, most + 1):
                last = part[:, l - 1 : l - 1 + n]
                h = h * _BASE + last
                ids = np.full(h.shape, self.n if l == 1 else -1, np.int64)
                some = np.nonzero(self.known[(mixed(h) >> np.uint64(44)).astype(np.int64)] & (last > 0))
                if len(some[0]):
                    sought = mixed(h[some])
                    at = np.minimum(np.searchsorted(self.keys, sought), self.n - 1)
                    hit = self.keys[at] == sought
                    ids[some[0][hit], some[1][hit]] = self.order[at[hit]]
                out.append(ids)
        return out

    def _walk(self, words: list[str], p: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Forward in steps: (first position a, alpha (word, back + positions, language) scaled, its logarithm of scale, lengths).

        alpha[:, back + t] belongs to position a + t, with back = longest; a step ends at position a + STEP at most.
        """
        length, codes = self.codes(words)
        wide, back = codes.shape[1], self.longest
        held = np.zeros((len(words), back + 1, p.shape[1]))
        held[:, back] = 1
        scale = np.zeros((len(words), p.shape[1]))
        for a in range(0, wide, STEP):
            n, low = min(STEP, wide - a), max(0, a - back + 1)
            arcs = self.arcs(codes, low, a + n)
            alpha = np.concatenate([held, np.zeros((len(words), n, p.shape[1]))], 1)
            for t in range(1, n + 1):
                j = a + t
                for l in range(1, min(j, len(arcs)) + 1):
                    ids = arcs[l - 1][:, j - l - low]
                    if l == 1:
                        alpha[:, back + t] += alpha[:, back + t - 1] * p[ids]
                    elif len(some := np.flatnonzero(ids >= 0)):
                        alpha[some, back + t] += alpha[some, back + t - l] * p[ids[some]]
            yield a, alpha, scale, length
            held = alpha[:, n:]
            most = held.max(1)
            most[most == 0] = 1
            held = held / most[:, None, :]
            scale = scale + np.log(most)

    def log_totals(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Logarithm of the summed probability of all segmentations (word, language); p has a row for each piece and one for an unknown character."""
        out = np.zeros((len(words), p.shape[1]))
        for a, alpha, scale, length in self._walk(words, p):
            ends = np.flatnonzero((length > a) & (length <= a + STEP))
            out[ends] = np.log(alpha[ends, self.longest + length[ends] - a]) + scale[ends]
        return out

    def expected(self, words: list[str], weights: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected piece counts (piece + 1, language) over all segmentations of words; p has one column, weights (word, language)."""
        back, steps, scales, total = self.longest, [], [], np.zeros(len(words))
        for a, alpha, scale, length in self._walk(words, p):
            steps.append(alpha[:, back:-1, 0])
            scales.append(scale[:, 0])
            ends = np.flatnonzero((length > a) & (length <= a + STEP))
            total[ends] = np.log(alpha[ends, back + length[ends] - a, 0]) + scale[ends, 0]
        length, codes = self.codes(words)
        wide, out = codes.shape[1], np.zeros((self.n + 1, weights.shape[1]))
        # beta[:, t] belongs to position a + t, scaled by exp(rest); a word's own end counts 1, and nothing behind it counts
        held, rest = np.zeros((len(words), back)), np.zeros(len(words))
        for k in reversed(range(len(steps))):
            a = k * STEP
            n = min(STEP, wide - a)
            arcs = self.arcs(codes, a, a + n)
            beta = np.concatenate([np.zeros((len(words), n)), held], 1)
            ends = np.flatnonzero((length >= a) & ((length < a + n) | (a + n == wide)))
            beta[ends, length[ends] - a] = 1
            factor = np.exp(np.clip(scales[k] + rest - total, -600, 600))
            for t in range(n - 1, -1, -1):
                for l in range(1, min(wide - a - t, len(arcs)) + 1):
                    ids = arcs[l - 1][:, t]
                    some = np.flatnonzero((ids >= 0) & (a + t + l <= length))
                    if len(some):
                        way = p[ids[some], 0] * beta[some, t + l]
                        beta[some, t] += way
                        share = steps[k][some, t] * way * factor[some]
                        for g in range(weights.shape[1]):
                            out[:, g] += np.bincount(ids[some], share * weights[some, g], self.n + 1)
            most = beta[:, :back].max(1)
            most[most == 0] = 1
            held = beta[:, :back] / most[:, None]
            rest = rest + np.log(most)
        return out


def _words(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def train(docs: DataFrame, pieces: list[str], text_col: str = "text", lang_col: str = "lang", passes: int = 1) -> tuple[list[str], np.ndarray]:
    """Piece probabilities per language from all labelled rows of docs: (languages, array (piece + 1, language)).

    Each pass is one step of expectation-maximisation over all segmentations, begun from a Zipf prior on the
    vocabulary's order. Tasks sum expected counts of their own rows; what reaches the driver is at most a row for
    each piece and language, both fixed by the vocabulary and the labels. Rows without text or label are left out.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    p = np.append(1.0 / (np.arange(len(pieces)) + 50.0), 0.0)
    p[-1] = 1e-6 * p[:-1].sum()
    shared = (p / p.sum())[:, None]
    found: tuple[list[str], np.ndarray] = ([], np.zeros((len(pieces) + 1, 0)))
    for _ in range(passes):

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice, sums, counts, held = Lattice(pieces), {}, {}, 0

            def flush() -> None:
                langs = list(counts)
                for part in batches_of(list(dict.fromkeys(w for c in counts.values() for w in c))):
                    weights = np.array([[counts[g][w] for g in langs] for w in part], float)
                    got = lattice.expected(part, weights, shared)
                    for k, g in enumerate(langs):
                        sums[g] = sums.get(g, 0) + got[:, k]
                counts.clear()

            for batch in batches:
                for rows, texts in text_slices(batch, 1):
                    for g, text in zip(rows.column(0).to_pylist(), texts.to_pylist()):
                        counts.setdefault(g, Counter()).update(_words(text))
                if sum(map(len, counts.values())) > COUNT_WORDS:
                    flush()
            if counts:
                flush()
            for g, s in sums.items():
                at = np.flatnonzero(s)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(s[at])], ["lang", "piece", "n"])

        got = rows.mapInArrow(lean(step), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        langs = sorted(got["lang"].unique())
        if not langs:
            break
        c = np.zeros((len(pieces) + 1, len(langs)))
        c[got["piece"].to_numpy(), [langs.index(g) for g in got["lang"]]] = got["n"].to_numpy()
        c = c + 0.01
        found = (langs, c / c.sum(0))
        shared = found[1].mean(1, keepdims=True)
    return found


class _Scorer:
    """Language and posterior of texts, with a table of the distinct words met so far (begun anew beyond TABLE_WORDS)."""

    def __init__(self, pieces: list[str], langs: list[str], p: np.ndarray):
        self.lattice, self.langs, self.p = Lattice(pieces), langs, np.maximum(p, FLOOR * 1e-3)
        self.index: dict[str, int] = {}
        self.chars = 0
        self.scores = np.zeros((1 << 12, len(langs)))

    def __call__(self, texts: list[str]) -> tuple[list[str], list[float]]:
        lists = [_words(t) for t in texts]
        if len(self.index) > TABLE_WORDS or self.chars > TABLE_CHARS:
            self.index.clear()
            self.chars = 0
        new = list({w for words in lists for w in words if w not in self.index}) if self.langs else []
        while len(self.index) + len(new) > len(self.scores):
            self.scores = np.vstack([self.scores, np.zeros_like(self.scores)])
        for part in batches_of(new):
            n = len(self.index)
            self.scores[n : n + len(part)] = self.lattice.log_totals(part, self.p)
            self.index.update(zip(part, range(n, n + len(part))))
            self.chars += sum(map(len, part))
        names, values = [], []
        for words in lists:
            if not self.langs or not any(c.isalpha() for w in words for c in w):
                names.append("und")
                values.append(0.0)
                continue
            total = self.scores[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))].sum(0)
            best = int(total.argmax())
            names.append(self.langs[best])
            values.append(float(1 / np.exp(total - total[best]).sum()))
        return names, values


def predict(docs: DataFrame, pieces: list[str], langs: list[str], p: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predicted language of every whole text: (id_col, lang_pred string, score double).

    A text's score for a language is the sum over its words of the log of the forward probability over all
    segmentations; lang_pred is the largest (ties: first in order of name) and score its posterior under equal
    priors. Texts that are null, empty or without a letter give ('und', 0.0), as does everything when no language
    was learned. Repeated rows are kept; other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(pieces, langs, p)
        for batch in batches:
            for rows, texts in text_slices(batch, 1):
                names, values = scorer(texts.to_pylist())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names, pa.string()), pa.array(values, pa.float64())], [id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(lean(run), f"`{id_col}` {id_type}, lang_pred string, score double")


def in_known_language(docs: DataFrame, pieces: list[str], langs: list[str], p: np.ndarray, least_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose text has a predicted language ('und' goes) of at least least_score; if no language was learned, those with a letter."""
    at, columns = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(pieces, langs, p)
        for batch in batches:
            for rows, texts in text_slices(batch, at):
                names, values = scorer(texts.to_pylist())
                keep = [n != "und" and v >= least_score for n, v in zip(names, values)] if langs else [any(map(str.isalpha, t)) for t in texts.to_pylist()]
                yield rows.filter(pa.array(keep, pa.bool_())).rename_columns(columns)

    return docs.mapInArrow(lean(run), docs.schema)
