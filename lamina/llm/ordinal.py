"""Quality classifier: cumulative-link (ordinal logistic) regression over hashed words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import _CLASS, class_runs, lean, mix64, run_hashes, text_slices, written

#: Buckets of hashed words, and the most labelled rows and features of rows that a fit reads (taken by hash of the id).
BUCKETS, MOST_ROWS, MOST_FEATURES = 1 << 18, 24_000, 10_000_000
#: Bytes of a run's beginning that are a feature of their own.
PREFIX = 5
#: A feature that n fitted rows hold counts n / (n + SHRINK): the rarer, the less one row can say about it.
SHRINK = 10.0
#: Least distance of two thresholds.
GAP = 1e-3
REPEATS = (1, 2, 4, 8, 16, 32)


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade > k) = sigmoid(score - threshold[k]); thresholds rise, weights are shared by all grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def _features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features (text number, bucket), in that order: runs of letters, runs of signs, the first PREFIX bytes of longer runs, and how often a run follows itself and a sign occurs (a feature for each count in REPEATS reached)."""
    data, starts, stops, owner = class_runs(texts)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    runs = run_hashes(data, starts, stops)
    long = stops - starts > PREFIX
    again = np.flatnonzero((runs[1:] == runs[:-1]) & (owner[1:] == owner[:-1]) & (stops[1:] - starts[1:] > 1))
    counts = np.bincount(owner[again])
    levels = [np.flatnonzero(counts >= n) for n in REPEATS]
    signs = _CLASS[data[starts]] == 2
    pair, seen = np.unique(np.stack([owner[signs].astype(np.uint64), runs[signs]]), axis=1, return_counts=True)
    often = [pair[:, seen >= n] for n in REPEATS[1:]]
    hashes = np.concatenate([runs, ~run_hashes(data, starts[long], starts[long] + PREFIX), *(np.full(len(x), mix64(np.uint64([n]))[0]) for x, n in zip(levels, REPEATS)), *(mix64(x[1] + np.uint64(n)) for x, n in zip(often, REPEATS[1:]))])
    key = np.unique(np.concatenate([owner, owner[long], *levels, *(x[0].astype(np.int64) for x in often)]) * buckets + (hashes % np.uint64(buckets)).astype(np.int64))
    return key // buckets, key % buckets


def likelihood(z: np.ndarray, cuts: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cumulative link: logarithm of P(grade = y) = P(> y - 1) - P(> y) for scores z, and its slopes by z and by each cut (row, cut)."""
    above = 1 / (1 + np.exp(np.clip(cuts[None, :] - z[:, None], -50, 50)))
    full = np.hstack([np.ones((len(z), 1)), above, np.zeros((len(z), 1))])
    row = np.arange(len(z))
    low, high = full[row, y], full[row, y + 1]
    p = np.maximum(low - high, 1e-12)
    by_cut = np.zeros((len(z), len(cuts) + 2))
    by_cut[row, y] -= low * (1 - low) / p
    by_cut[row, y + 1] += high * (1 - high) / p
    return np.log(p), 1 - low - high, by_cut[:, 1:-1]


def fit(docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", buckets: int = BUCKETS, most_rows: int = MOST_ROWS, most_features: int = MOST_FEATURES, epochs: int = 12, shrink: float = SHRINK, seed: int = 7) -> OrdinalModel:
    """Fit on at most most_rows labelled rows with at most most_features features, taken by hash of the id; grades has (id_col, grade_col: 0, 1, ... as integers).

    Rows with a null id or grade are left out; a null text counts as empty; of repeated ids the lowest grade counts, and of
    repeated document rows one (the smallest set of features, as bytes). With fewer than two grades all weights are 0.
    The fit is stochastic gradient descent with per-weight step sizes on the negative logarithm of the cumulative-link likelihood, on
    the driver. No feature is left out: one that n rows hold counts n / (n + shrink), in the fit as in the weights.
    """
    wanted = grades.where(F.col(id_col).isNotNull() & F.col(grade_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(grade_col).cast("int").alias("grade"))
    wanted = wanted.withColumn("place", F.xxhash64("id")).orderBy("place", "id").limit(most_rows)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, 2):
                owner, bucket = _features(texts, buckets)
                cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
                blobs = [bucket[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(blobs, pa.binary())], ["id", "grade", "x"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(wanted), "id")  # at most most_rows ids
    id_type = docs.schema[id_col].dataType.simpleString()
    found = picked.select("id", "grade", "text").mapInArrow(lean(hashed), f"id {id_type}, grade int, x binary")
    found = written(found.groupBy("id", "grade").agg(F.min("x").alias("x")).withColumn("place", F.xxhash64("id")), "features")
    sizes = found.select("place", (F.octet_length("x") / 4).cast("long").alias("n")).orderBy("place").collect()
    total = np.cumsum([r["n"] for r in sizes])
    until = int(np.searchsorted(total, most_features, "right"))
    if until < len(sizes):
        found = found.where(F.col("place") < sizes[until]["place"])
    order = np.random.default_rng(seed)
    got = sorted((r["grade"], r["x"]) for r in found.select("grade", "x").collect())
    y = np.array([g for g, _ in got], int)
    xs = [np.frombuffer(x, "<i4") for _, x in got]
    weights = np.zeros(buckets)
    if len(set(y.tolist())) < 2:
        top = int(y.max()) if len(y) else 1
        return OrdinalModel(weights, np.arange(max(top, 1), dtype=float) - 100.0)
    df = np.bincount(np.concatenate(xs), minlength=buckets)
    value = df / (df + shrink)
    n_cuts = int(y.max())
    share = np.clip([(y > k).mean() for k in range(n_cuts)], 1e-4, 1 - 1e-4)
    levels = GAP * np.arange(n_cuts)
    cuts = np.maximum.accumulate(-np.log(share / (1 - share)) - levels) + levels
    g2, c2 = np.ones(buckets), np.ones(n_cuts)
    mean, mean_cuts, steps = np.zeros(buckets), np.zeros(n_cuts), 0
    for epoch in range(epochs):
        todo = order.permutation(len(y))
        for i in range(0, len(todo), 32):
            part = todo[i : i + 32]
            size = np.array([len(xs[j]) for j in part])
            at = np.concatenate([xs[j] for j in part])
            owner = np.repeat(np.arange(len(part)), size)
            z = np.bincount(owner, weights[at] * value[at], len(part))
            _, by_score, by_cut = likelihood(z, cuts, y[part])
            g = np.bincount(at, -by_score[owner] * value[at], buckets)
            some = np.flatnonzero(g)
            g2[some] += g[some] ** 2
            weights[some] -= 0.1 * (g[some] + 0.2 * weights[some]) / np.sqrt(g2[some])
            gc = -by_cut.sum(0)
            c2 += gc**2
            cuts = np.maximum.accumulate(cuts - 0.1 * gc / np.sqrt(c2) - levels) + levels
            if 2 * epoch >= epochs:  # the mean of the later steps is steadier than the last
                mean, mean_cuts, steps = mean + weights, mean_cuts + cuts, steps + 1
    return OrdinalModel(mean / steps * value, mean_cuts / steps)


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Grade every whole text: (id_col, expected_grade double, p_top double: P(highest grade), p_pass double: P(above the lowest grade)).

    Null and empty texts hold no words and get the thresholds' own probabilities. Repeated rows are kept, other
    columns are not read, an empty table gives an empty result. The model is a fixed number of floats.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    buckets = len(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, 1):
                owner, bucket = _features(texts, buckets)
                tails = model.tails(np.bincount(owner, model.weights[bucket], len(texts)))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, 0])], [id_col, "expected_grade", "p_top", "p_pass"])

    return docs.select(id_col, text_col).mapInArrow(lean(run), f"`{id_col}` {id_type}, expected_grade double, p_top double, p_pass double")
