"""Exact top-k inner products: vectors in buckets of like length, pruned by bucket with local cosine thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import lean, written

#: Vectors in a bucket and queries in a block, coordinates looked at when a local threshold is high, and the cosine from which it is.
BUCKET, QUERIES, FOCUS, HIGH = 4096, 512, 4, 0.6
#: Bytes of buckets that one task holds (a shard: buckets that follow each other by length), and query blocks that it meets them with.
SHARD_BYTES, TASK_BLOCKS = 16 << 20, 256
#: Parts that the rows of one dimension are dealt to: all vectors may have the same.
SALTS = 32


def quantised(table: DataFrame, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, dim int, v array of long, norm2 double): floor(scale * x) of each component as double.

    Rows with a null id or vector, or with a null or non-finite component, are left out.
    """
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(fine)
    v = F.transform(x, lambda c: F.floor(c * scale).cast("long"))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return rows.select("id", F.size("v").alias("dim"), "v", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")).alias("norm2"))


def _small(v: np.ndarray) -> np.ndarray:
    """v in the narrowest integers that hold it."""
    kinds = (np.int8, np.int16, np.int32, np.int64)
    return v.astype(next(t for t in kinds if not v.size or (np.iinfo(t).min <= v.min() and v.max() <= np.iinfo(t).max)))


_PACKED = "dim int, shard long, bucket int, longest double, ids binary, vectors binary, width int, norms binary"


def _packed(rows: DataFrame, size: int, shard_bytes: int) -> DataFrame:
    """Rows (id, dim, v, norm2) packed by falling length: a row for each bucket of at most `size` vectors of one dimension, norms falling inside.

    Columns are _PACKED; buckets that follow each other share a shard of about shard_bytes. A range partition packs its own rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, held_bytes, bucket, last = TaskContext.get().partitionId() << 24, 0, 0, None
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            nonlocal shard, held_bytes, bucket, last
            dim = held[0][1]
            ids, v = np.array([h[0] for h in held], np.int64), _small(np.array([h[2] for h in held], np.int64).reshape(len(held), dim))
            norms = np.sqrt(np.array([h[3] for h in held]))
            held.clear()
            if last is not None and (last != dim or held_bytes >= shard_bytes):
                shard, held_bytes, bucket = shard + 1, 0, 0
            last, held_bytes, bucket = dim, held_bytes + v.nbytes + 16 * len(ids), bucket + 1
            numbers = [pa.array([x], t) for x, t in ((dim, pa.int32()), (shard, pa.int64()), (bucket, pa.int32()), (float(norms.max()), pa.float64()))]
            blobs = [pa.array([x.tobytes()], pa.binary()) for x in (ids, v, norms)]
            return pa.RecordBatch.from_arrays([*numbers, blobs[0], blobs[1], pa.array([v.itemsize], pa.int32()), blobs[2]], ["dim", "shard", "bucket", "longest", "ids", "vectors", "width", "norms"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and (held[0][1] != row[1] or len(held) == size):
                    yield out()
                held.append(row)
        if held:
            yield out()

    ordered = rows.repartitionByRange("dim", F.desc("norm2"), "id").sortWithinPartitions("dim", F.desc("norm2"), "id")
    return ordered.mapInArrow(lean(run), _PACKED)


def _exact(q: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    """Integer inner products; float matrices where every partial sum is exact in them."""
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    return (q.astype(kind) @ c.astype(kind).T).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def candidates(q: np.ndarray, length: float, least: float, c: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Positions in one bucket (norms falling) that may reach the score least with the query q: all that do are among them.

    The local cosine threshold is least / (length * longest). Above 1 the bucket falls whole; a high one prunes by the
    range that the query's largest coordinates then allow; a low one by length alone.
    """
    if least <= 0 or length == 0:
        return np.arange(len(c)) if least <= 0 else np.zeros(0, np.int64)
    until = int(np.searchsorted(-norms, -least / length * (1 - 1e-9), "right"))  # |q| |c| >= least
    if not until:
        return np.zeros(0, np.int64)
    cosine = least / (length * norms[0]) * (1 - 1e-9)
    keep = np.ones(until, bool)
    if cosine >= HIGH:
        unit = q / length
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            spread = np.sqrt(max(0.0, 1 - unit[f] ** 2) * (1 - cosine**2))
            low, high = unit[f] * cosine - spread - 1e-9, unit[f] * cosine + spread + 1e-9
            # beyond these a unit vector cannot have that cosine, unless the bound turns over at the pole
            own = c[:until, f] / np.maximum(norms[:until], 1e-300)
            keep &= (own >= (-1 if unit[f] <= -cosine else low)) & (own <= (1 if unit[f] >= cosine else high))
    return np.flatnonzero(keep)


class _Block:
    """Packed vectors of one dimension as arrays."""

    def __init__(self, row: dict):
        self.ids, self.norms = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["norms"], float)
        self.vectors = np.frombuffer(row["vectors"], f"<i{row['width']}").reshape(len(self.ids), row["dim"])


def _meet(block: _Block, least: np.ndarray, last: np.ndarray, buckets: list[_Block], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query of block the (ids, scores) of its best k in the buckets that beat its least score, or reach it with an id below last; best first."""
    found: list[list] = [[] for _ in block.ids]
    for bucket in buckets:
        bound = float(block.norms.max() * bucket.norms[0]) * 1.01 + 1
        near = [candidates(block.vectors[n].astype(float), block.norms[n], least[n], bucket.vectors, bucket.norms) for n in range(len(block.ids))]
        many = np.array([len(at) * 4 > len(bucket.ids) for at in near], bool)
        until = max([int(at[-1]) + 1 for at, m in zip(near, many) if m], default=0)
        dense = _exact(block.vectors[many], bucket.vectors[:until], bound) if until else None
        row = np.cumsum(many) - 1
        for n, at in enumerate(near):
            if len(at):
                score = dense[row[n], at] if many[n] else _exact(block.vectors[n : n + 1], bucket.vectors[at], bound)[0]
                fit = (bucket.ids[at] != block.ids[n]) & ((score > least[n]) | (score == least[n]) & (bucket.ids[at] < last[n]))
                at, score = at[fit], score[fit]
                best = _best(score, bucket.ids[at], k)
                found[n].append((bucket.ids[at][best], score[best]))
    out = []
    for parts in found:
        ids, score = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts) if parts else ((), ())))
        best = _best(score, ids, k)
        out.append((ids[best], score[best]))
    return out


def _hits(block: _Block, best: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    lengths = [len(ids) for ids, _ in best]
    ids, scores = (np.concatenate([x[i] for x in best]) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(block.ids, lengths)), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])


_HITS = "query_id long, vec_id long, score long"


def _pilot(pairs: DataFrame, k: int) -> DataFrame:
    """For rows of a query block (q_ columns) with the longest bucket: the block, each query's score to beat (minus infinity below k hits) and the last id that has it, the least score, and the hits."""
    head = ["block", "dim", "q_longest", "q_ids", "q_vectors", "q_width", "q_norms"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                block = _Block({"dim": row["dim"], "ids": row["q_ids"], "vectors": row["q_vectors"], "width": row["q_width"], "norms": row["q_norms"]})
                best = _meet(block, np.full(len(block.ids), -np.inf), np.zeros(len(block.ids), np.int64), [_Block(row)], k)
                least = np.array([s[-1] if len(s) == k else -np.inf for _, s in best], float)
                last = np.array([ids[-1] if len(ids) == k else 0 for ids, _ in best], np.int64)
                hits = pa.array([_hits(block, best).to_pylist()], pa.list_(pa.struct([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])))
                yield pa.RecordBatch.from_arrays([*(batch.column(name).slice(i, 1) for name in head), pa.array([least.tobytes()], pa.binary()), pa.array([last.tobytes()], pa.binary()), pa.array([float(least.min())]), hits], [*head, "least", "last", "floor", "hits"])

    return pairs.mapInArrow(lean(run), "block long, dim int, q_longest double, q_ids binary, q_vectors binary, q_width int, q_norms binary, least binary, last binary, floor double, hits array<struct<query_id:long,vec_id:long,score:long>>")


def _search(rows: DataFrame, k: int) -> DataFrame:
    """Hits of tasks whose rows stand together, buckets (no least) before query blocks: a task's buckets are held, blocks pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, buckets = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if (row["shard"], row["part"]) != task:
                    task, buckets = (row["shard"], row["part"]), []
                if row["least"] is None:
                    buckets.append(_Block(row))
                else:
                    block = _Block(row)
                    hits = _hits(block, _meet(block, np.frombuffer(row["least"], float), np.frombuffer(row["last"], np.int64), buckets, k))
                    if hits.num_rows:
                        yield hits

    return rows.mapInArrow(lean(run), _HITS)


def top_products(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """The k highest integer inner products of each query row with every row but its own id: (query_id, rank int, vec_id, score).

    vectors comes from quantised(); is_query is a condition on id. Ties go to the smaller vec_id; fewer than k other
    rows give all. Vectors of another dimension are no candidates; empty vectors meet each other with score 0. Rows that repeat an
    id are one candidate each, and one query (the smallest vector, component by component); with the query's own id they are left out.
    Empty tables give no rows. Products must fit 63 bits.

    Buckets hold BUCKET vectors of like length (equal ones go by id, so a hot vector spreads), packed where a range sort by dimension and
    length leaves them. Each block of queries first meets the longest bucket of its dimension, which gives every query a score to beat, and then
    only shards of buckets whose length can reach it. A task holds one shard (SHARD_BYTES) and TASK_BLOCKS blocks pass by it, so neither
    a hot dimension nor a shard that every query reaches goes to one task. What goes by dimension are small rows without vectors, or dealt to SALTS parts.
    """
    buckets = written(_packed(vectors.select("id", "dim", "v", "norm2"), BUCKET, SHARD_BYTES), "buckets")
    queries = vectors.where(is_query).groupBy("id").agg(F.min(F.struct("dim", "v", "norm2")).alias("q")).select("id", "q.*")
    blocks = written(_packed(queries, QUERIES, SHARD_BYTES), "queries")
    salt = lambda key: F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("salt")
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    asked = blocks.select((F.col("shard") * (1 << 16) + F.col("bucket")).alias("block"), "dim", F.col("longest").alias("q_longest"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("width").alias("q_width"), F.col("norms").alias("q_norms"))
    # the longest bucket of each dimension: found on rows without vectors, then fetched, one copy for each part
    first = buckets.groupBy("dim").agg(F.max(F.struct("longest", "shard", "bucket")).alias("m")).select("m.shard", "m.bucket")
    head = buckets.join(first, ["shard", "bucket"]).select("*", every_salt)
    pilot = written(_pilot(asked.select("*", salt("block")).join(head.drop("shard", "bucket", "longest"), ["dim", "salt"]).drop("salt"), k), "pilot")
    # which block can reach which shard: rows without vectors
    shards = buckets.join(first.withColumn("head", F.lit(True)), ["shard", "bucket"], "left").where("head is null").groupBy("dim", "shard").agg(F.max("longest").alias("longest"))
    wants = pilot.select("dim", "block", "floor", "q_longest", salt("block"))
    reach = (F.col("floor") <= 0) | (F.col("longest") * F.col("q_longest") * (1 + 1e-9) >= F.col("floor"))
    pairs = wants.join(shards.select("*", every_salt), ["dim", "salt"]).where(reach)
    parts = F.ceil(F.lit(pilot.count()) / TASK_BLOCKS).cast("long")
    pairs = written(pairs.select("shard", "block", F.pmod(F.xxhash64("block", F.lit(1)), parts).alias("part")), "pairs")
    # payloads: a shard's buckets once for each of its tasks, a block once for each shard it reaches
    columns = ["shard", "part", "bucket", "dim", "ids", "vectors", "width", "norms", "least", "last"]
    held = buckets.join(first.withColumn("head", F.lit(True)), ["shard", "bucket"], "left").where("head is null").join(pairs.select("shard", "part").distinct(), "shard")
    passing = pilot.select("block", "dim", F.col("q_ids").alias("ids"), F.col("q_vectors").alias("vectors"), F.col("q_width").alias("width"), F.col("q_norms").alias("norms"), "least", "last").join(pairs, "block")
    rows = held.withColumn("least", F.lit(None).cast("binary")).withColumn("last", F.lit(None).cast("binary")).select(*columns).unionByName(passing.withColumn("bucket", F.lit(1 << 30)).select(*columns))
    rest = _search(rows.repartition("shard", "part").sortWithinPartitions("shard", "part", "bucket"), k)
    hits = pilot.select(F.explode("hits").alias("h")).select("h.*").unionByName(rest)
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
