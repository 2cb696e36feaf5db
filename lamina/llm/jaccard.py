"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

Two orders of all n-grams are used. By how often they occur, counted exactly over all rows, and then by hash: a document's first n-grams in this
order are enough to meet every partner. By hash alone: this one is cut into fragments, whose overlaps are counted apart and summed for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import SLICE_BYTES, by_part, codec, discard, lean, mix64, packed_blocks, salted, text_slices, unpacked_block, word_hashes, written
from lamina.llm.graph import components

WIDTH, PERCENT = 4, 85
#: Bytes of text behind one range of n-gram hashes, and the level (logarithm of the occurrences) from which an n-gram is hot.
RANGE_BYTES, HOT_LEVEL = 16 << 20, 12
#: Fragments of the order; holders up to which a prefix n-gram gives pairs.
FRAGMENTS, SMALL = 4, 32
#: Documents, and n-grams of documents, that one task compares with as many others where more hold a prefix n-gram.
BLOCK, BLOCK_GRAMS = 512, 2_000_000
#: N-grams of a cluster of pairs up to which it is verified in one place, and of the clusters that one place takes.
LOCAL_GRAMS, PLACE_GRAMS = 4_000_000, 200_000
#: Wanted ids (a few bytes each) that are broadcast; more are joined by a shuffle of the texts that pass the bit filter.
BROADCAST_IDS = 200_000
#: Classes of equal sets that hold more than one row in so many have their labels broadcast.
LARGE = 1000
#: Bits of the filter that keeps most unwanted texts out of a shuffle (a fixed 4 MB), and rows it travels in.
FILTER_BITS, PARTS = 1 << 25, 64


def shingles(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of all texts in order, and the n + 1 offsets of the texts in them.

    A text with fewer words than width has one for its whole sequence; one without words has none.
    """
    words, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    salt = [np.uint64(2 * k + 3) for k in range(width)]
    with np.errstate(over="ignore"):
        h = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            h = mix64(h + words[k : k + len(h)] * salt[k])
        whole = owner[: len(h)] == owner[width - 1 :] if len(h) else np.zeros(0, bool)
        h, at = h[whole], owner[: len(h)][whole]
        few = np.flatnonzero((counts > 0) & (counts < width))
        starts = np.concatenate([[0], np.cumsum(counts)])
        short = np.zeros(len(few), np.uint64)
        for i, t in enumerate(few):
            s = np.uint64(0xABCDEF + int(counts[t]))
            for w in words[starts[t] : starts[t + 1]]:
                s = mix64(np.atleast_1d(s * np.uint64(31) + w))[0]
            short[i] = s
    if len(few):
        h, at = np.concatenate([h, short]), np.concatenate([at, few])
        order = np.argsort(at, kind="stable")
        h, at = h[order], at[order]
    return h, np.searchsorted(at, np.arange(len(texts) + 1))


def _merged(rows: DataFrame, tally, size: int, kind: str, finish) -> np.ndarray:
    """Fixed-size tallies of all tasks, added up by slices: `size` bytes on the driver, whatever the input.

    tally(batches) gives one array for a task; slices travel compressed and finish(sum) gives a slice's bytes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1)
        total = tally(batches)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([squeeze.compress(r.tobytes()) for r in total.astype(kind).reshape(PARTS, -1)], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        loose, sums = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(loose.decompress(blob), kind).astype(np.int64)
        for part, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([finish(s).astype(np.uint8).tobytes()], pa.binary())], ["part", "sums"])

    got = rows.mapInArrow(lean(count), "part int, counts binary").repartition("part").mapInArrow(lean(add), "part int, sums binary").collect()
    out = np.zeros((PARTS, size // PARTS), np.uint8)
    for r in got:
        out[r["part"]] = np.frombuffer(r["sums"], np.uint8)
    return out.ravel()


def _keys(grams: np.ndarray, ranges: int) -> np.ndarray:
    """Range (in front) and the 32 bits of each n-gram's hash by which its occurrences are counted; two n-grams that share them count together."""
    return ((grams >> np.uint64(33)) % np.uint64(ranges)) << np.uint64(32) | (grams & np.uint64(0xFFFFFFFF))


def _block_grams(row: dict, loose, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of a block's texts in order, the offsets of the texts in them, and the ids."""
    data, ends, ids = unpacked_block(row, loose)
    grams, until, start = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    while start < len(ids):  # about SLICE_BYTES of text at once: hashing takes many times its size
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + SLICE_BYTES, "right")) - 1)
        texts = pa.LargeStringArray.from_buffers(stop - start, pa.py_buffer(ends[start : stop + 1] - ends[start]), pa.py_buffer(data[ends[start] : ends[stop]]))
        h, at = shingles(texts, width)
        grams.append(h)
        until.append(at[1:] + until[-1][-1])
        start = stop
    return np.concatenate(grams), np.concatenate(until), ids


def _offers(blocks: DataFrame, width: int, ranges: int) -> DataFrame:
    """Each block's distinct n-grams by hash range, with how often they occur in it: (part, block, grams, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, loose = codec()
        for batch in batches:
            for row in batch.to_pylist():
                keys, n = np.unique(_keys(_block_grams(row, loose, width)[0], ranges), return_counts=True)
                cuts = np.searchsorted(keys >> np.uint64(32), np.arange(ranges + 1))
                n = np.minimum(n, 255).astype(np.uint8)
                parts, grams, counts = np.flatnonzero(np.diff(cuts)), [], []
                for p in parts:
                    steps = np.diff(keys[cuts[p] : cuts[p + 1]].astype("<u4"), prepend=np.zeros(1, "<u4")).astype("<u4")
                    grams.append(squeeze.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()))
                    counts.append(squeeze.compress(n[cuts[p] : cuts[p + 1]].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([row["block"]] * len(parts), pa.int64()), pa.array(grams, pa.binary()), pa.array(counts, pa.binary())], ["part", "block", "grams", "counts"])

    return blocks.mapInArrow(lean(run), "part long, block long, grams binary, counts binary")


def _levels(offers: DataFrame, ranges: int) -> DataFrame:
    """For each offer the level of its n-grams over all blocks, 0 for those that occur once: (block, part, levels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, loose = codec()
        for part, rows in by_part(batches):
            grams = [np.cumsum(np.frombuffer(loose.decompress(r["grams"]), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.uint32) for r in rows]
            counts = np.concatenate([np.frombuffer(loose.decompress(r["counts"]), np.uint8) for r in rows])
            cuts = np.cumsum([len(g) for g in grams])
            _, back = np.unique(np.concatenate(grams), return_inverse=True)
            level = np.log2(np.bincount(back, counts)).astype(np.uint8)[back]
            for row, own in zip(rows, np.split(level, cuts[:-1])):
                if own.any():
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([part], pa.int64()), pa.array([squeeze.compress(own.tobytes())], pa.binary())], ["block", "part", "levels"])

    dealt = offers.repartition(ranges, "part").sortWithinPartitions("part", "block")
    return dealt.mapInArrow(lean(run), "block long, part long, levels binary")


def _bit(ids: pa.Array) -> np.ndarray:
    return (mix64(ids.to_numpy(zero_copy_only=False).astype(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs (id, text) joined with wanted (integer id, more columns); a bit filter of fixed size keeps most others from being shuffled."""

    def tally(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        bits = np.zeros(FILTER_BITS, np.uint8)
        for batch in batches:
            bits[_bit(batch.column(0))] = 1
        return bits

    bits = _merged(wanted.select("id"), tally, FILTER_BITS // 8, "u1", lambda s: np.packbits(s > 0))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.filter(batch.column(0).is_valid())
            at = _bit(rows.column(0))
            yield rows.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))

    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    some = docs.mapInArrow(lean(keep), docs.schema).join(wanted, "id")
    return some


def _profiles(blocks: DataFrame, width: int, percent: int, ranges: int) -> DataFrame:
    """Of blocks with the levels of their n-grams: (id, n, s1, s2: order-free hashes of the set, first: those of its first n-grams in the order that occur elsewhere, lead: how many of these lead, hot: how many, at the end, are hot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, loose = codec()
        for batch in batches:
            for row in batch.to_pylist():
                h, ends, ids = _block_grams(row, loose, width)
                keys = _keys(h, ranges)
                known = np.unique(keys)
                levels = np.zeros(len(known), np.uint8)
                for m in row["marks"] or ():
                    at = np.searchsorted(known, np.uint64(m["part"] << 32))
                    own = np.frombuffer(loose.decompress(m["levels"]), np.uint8)
                    levels[at : at + len(own)] = own
                every = levels[np.searchsorted(known, keys)]
                n, s1, s2, first, lead, hot = [], [], [], [], [], []
                for a, b in zip(ends[:-1], ends[1:]):
                    own, at = np.unique(h[a:b], return_index=True)
                    level = every[a:b][at]
                    n.append(len(own))
                    with np.errstate(over="ignore"):
                        s1.append(mix64(own).sum(dtype=np.uint64).astype(np.int64))
                        s2.append(mix64(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))
                    probe, index = fronts(len(own), percent)
                    front = np.argsort(level, kind="stable")[:probe]
                    shared = level[front] > 0
                    first.append(own[front[shared]].astype(np.int64))
                    lead.append(np.count_nonzero(shared[:index]))
                    hot.append(np.count_nonzero(level[front] >= HOT_LEVEL))
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(lead, pa.int32()), pa.array(hot, pa.int32())], ["id", "n", "s1", "s2", "first", "lead", "hot"])

    return blocks.mapInArrow(lean(run), "id long, n long, s1 long, s2 long, first array<long>, lead int, hot int")


def fronts(n: int, percent: int) -> tuple[int, int]:
    """How many n-grams in front of a set of size n no partner can miss: any partner, and one at least as large."""
    if not n:
        return 0, 0
    return n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1


def _packed(grams: np.ndarray) -> bytes:
    return grams.astype("<u8").tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u8")


def _fragments(docs: DataFrame, width: int, fragments: int = FRAGMENTS) -> DataFrame:
    """Sets of docs (id, text, more columns), cut into equal stretches of the hash order: (more columns, id, fragment, grams binary)."""
    more = [c for c in docs.columns if c not in ("id", "text")]
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in [*more, "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, 0):
                h, ends = shingles(texts, width)
                at, number, grams = [], [], []
                for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                    own = np.unique(h[a:b])
                    cuts = np.searchsorted((own >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32), np.arange(fragments + 1))
                    for f in range(fragments):
                        at.append(i)
                        number.append(f)
                        grams.append(_packed(own[cuts[f] : cuts[f + 1]]))
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(rows.column(k + 1).take(at) for k in range(len(more) + 1)), pa.array(number, pa.int32()), pa.array(grams, pa.binary())], [*more, "id", "fragment", "grams"])

    return docs.select("text", *more, "id").mapInArrow(lean(run), f"{kinds}, fragment int, grams binary")


def _partial_overlaps(grams: DataFrame, pairs: DataFrame) -> DataFrame:
    """Overlaps of pairs (key, a, b, na, nb) within one fragment whose sets (key, id, grams) stand in the same group: (a, b, na, nb, part)."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(sets: pa.Table, wanted: pa.Table) -> pa.Table:
        own = {i: _unpacked(g) for i, g in zip(sets["id"].to_pylist(), sets["grams"].to_pylist())}
        part = [len(np.intersect1d(own[a], own[b], assume_unique=True)) for a, b in zip(wanted["a"].to_pylist(), wanted["b"].to_pylist())]
        return pa.table([wanted[c] for c in ("a", "b", "na", "nb")] + [pa.array(part, pa.int64())], names=["a", "b", "na", "nb", "part"])

    return grams.groupBy("key").cogroup(pairs.groupBy("key")).applyInArrow(run, f"a {kind}, b {kind}, na long, nb long, part long")


def _pair_overlaps(rows: DataFrame) -> DataFrame:
    """The same of rows (a, b, na, nb, ga, gb) that bring their sets along."""
    kind = rows.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            part = [len(np.intersect1d(_unpacked(x), _unpacked(y), assume_unique=True)) for x, y in sets]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(part, pa.int64())], ["a", "b", "na", "nb", "part"])

    return rows.mapInArrow(lean(run), f"a {kind}, b {kind}, na long, nb long, part long")


def _verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) that link: partial overlaps of each fragment, counted apart and summed.

    Pairs are dealt by the cluster they are in, so that a document's fragments travel once; pairs of a cluster of more than
    LOCAL_GRAMS n-grams, which no task should hold, each fetch their two sets instead.
    """
    sizes = pairs.select(F.col("a").alias("node"), F.col("na").alias("n")).unionByName(pairs.select(F.col("b").alias("node"), F.col("nb").alias("n"))).groupBy("node").agg(F.max("n").alias("n"))
    label = written(components(pairs.select("a", "b")).join(sizes, "node"), "labels")
    weight = label.groupBy("label").agg(F.sum("n").alias("weight"))
    places = max(1, -(-(label.agg(F.sum("n")).first()[0] or 0) // PLACE_GRAMS))
    label = label.join(weight, "label").select(F.col("node").alias("id"), F.when(F.col("weight") <= LOCAL_GRAMS, F.pmod(F.xxhash64("label"), F.lit(places))).alias("place"))
    label = written(label, "places")
    placed = pairs.join(label.select(F.col("id").alias("a"), "place"), "a")
    grams = _fragments(_texts_of(docs, label.where("place is not null")), width)
    key = lambda fragment: (F.col("place") * FRAGMENTS + fragment).alias("key")
    each = F.explode(F.array(*map(F.lit, range(FRAGMENTS)))).alias("f")
    near = placed.where("place is not null").select("*", each)
    parts = _partial_overlaps(grams.select(key(F.col("fragment")), "id", "grams"), near.select(key(F.col("f")), "a", "b", "na", "nb"))
    wide = label.where("place is null")
    if not wide.isEmpty():
        grams = _fragments(_texts_of(docs, wide.select("id")), width)
        grams = written(grams.select("id", "fragment", "grams").dropDuplicates(["id", "fragment"]), "grams")
        left = placed.where("place is null").join(grams.select(F.col("id").alias("a"), "fragment", F.col("grams").alias("ga")), "a")
        both = left.join(grams.select(F.col("id").alias("b"), "fragment", F.col("grams").alias("gb")), ["b", "fragment"])
        parts = parts.unionByName(_pair_overlaps(both.select("a", "b", "na", "nb", "ga", "gb")))
    sums = parts.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("overlap"))
    return sums.where(F.col("overlap") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of two lists of sets: partial counts for each fragment of the n-gram order, summed."""
    out = np.zeros((len(left), len(right)), np.float32)
    l, r = np.concatenate(left), np.concatenate(right)
    li = np.repeat(np.arange(len(left)), [len(x) for x in left])
    ri = np.repeat(np.arange(len(right)), [len(x) for x in right])
    common = np.intersect1d(l, r)
    if not len(common):
        return out
    for known, vals, own in ((0, l, li), (1, r, ri)):
        at = np.minimum(np.searchsorted(common, vals), len(common) - 1)
        keep = common[at] == vals
        if known:
            ra, ro = at[keep], own[keep]
        else:
            la, lo = at[keep], own[keep]
    lorder, rorder = np.argsort(la, kind="stable"), np.argsort(ra, kind="stable")
    la, lo, ra, ro = la[lorder], lo[lorder], ra[rorder], ro[rorder]
    for c in range(0, len(common), columns):
        x = np.zeros((len(left), min(columns, len(common) - c)), np.float32)
        y = np.zeros((len(right), x.shape[1]), np.float32)
        a, b = np.searchsorted(la, [c, c + columns])
        x[lo[a:b], la[a:b] - c] = 1
        a, b = np.searchsorted(ra, [c, c + columns])
        y[ro[a:b], ra[a:b] - c] = 1
        out += x @ y.T
    return out


def _forest(a: np.ndarray, b: np.ndarray, nodes: int) -> list[int]:
    """Positions of edges that join what was apart."""
    root = list(range(nodes))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            kept.append(k)
    return kept


def _block_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links in groups (key, side 0 or 1, id, label, grams of all fragments): between sides, or within side 0 if there is no side 1; a spanning forest of them."""
    id_type = rows.schema["id"].dataType.simpleString()

    def run(_: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["side", "id"])
        sides = [frame[frame.side == s] for s in (0, 1)]
        left, right = sides[0], sides[1] if len(sides[1]) else sides[0]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []})
        x, y = [[_unpacked(g) for g in s.grams] for s in (left, right)]
        n, m = np.array([len(g) for g in x]), np.array([len(g) for g in y])
        linked = overlaps(x, y) * (100 + percent) >= percent * (n[:, None] + m[None, :])
        linked &= left.label.to_numpy()[:, None] != right.label.to_numpy()[None, :]
        i, j = np.nonzero(linked)
        _, number = np.unique(np.concatenate([left.id.to_numpy(), right.id.to_numpy()]), return_inverse=True)
        kept = _forest(number[i], number[len(left) + j], len(number))
        return pd.DataFrame({"a": left.id.to_numpy()[i[kept]], "b": right.id.to_numpy()[j[kept]]})

    return rows.groupBy("key").applyInPandas(run, f"a {id_type}, b {id_type}")


def _wide_links(docs: DataFrame, wide: DataFrame, width: int, percent: int) -> DataFrame:
    """Links among documents that share a prefix n-gram with many others: (a, b).

    wide has (token, id, n: size, leads: whether the n-gram leads the document to partners of its size or more, hub: the smallest holder that it leads). Documents
    that share such n-grams form clusters; a cluster is dealt into blocks by hash and each block compared within itself, which joins nearly all
    that link at all. A pair of unlike labels that is left has a document outside the cluster's largest component, and one that leads: so
    those outside that lead meet the whole cluster, block by block, and the others outside meet those that lead. A cluster of one block is done after the first step.
    """
    cluster = components(wide.select(F.col("hub").alias("a"), F.col("id").alias("b"))).withColumnRenamed("node", "id").withColumnRenamed("label", "cluster")
    cluster = cluster.join(wide.groupBy("id").agg(F.max("n").alias("n"), F.max("leads").alias("leads")), "id")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_GRAMS))
    sized = cluster.join(cluster.groupBy("cluster").agg(blocks.alias("blocks")), "cluster")
    dealt = written(sized.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))), "dealt")
    inner = _fragments(_texts_of(docs, dealt.select("id", F.concat_ws("/", "cluster", "block").alias("key"))), width, 1)
    links = written(_block_links(inner.select("key", F.lit(0).alias("side"), "id", F.col("id").alias("label"), "grams"), percent), "links")
    large = dealt.where(F.col("blocks") > 1)
    if large.isEmpty():
        return links
    labels = components(links).withColumnRenamed("node", "id")
    large = written(large.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "labelled")
    sizes = large.groupBy("cluster", "label").agg(F.count("*").alias("k"))
    main = sizes.groupBy("cluster").agg(F.max(F.struct("k", "label")).alias("m"), F.count("*").alias("labels")).where("labels > 1")
    open_ = large.join(main.select("cluster", F.col("m.label").alias("main")), "cluster")
    apart = open_.where("label <> main")

    def met(first: DataFrame, second: DataFrame, name: str) -> DataFrame:
        """Rows of the groups that compare all of first with all of second, cluster by cluster and block by block."""
        count = lambda rows, number: rows.groupBy("cluster").agg(blocks.alias(number))
        both = count(first, "firsts").join(count(second, "seconds"), "cluster")
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
        key = F.concat_ws("/", F.lit(name), "cluster", "one", "two").alias("key")
        one = first.join(both, "cluster").withColumn("one", F.pmod(F.xxhash64("id", F.lit(1)), F.col("firsts"))).withColumn("two", upto("seconds"))
        two = second.join(both, "cluster").withColumn("two", F.pmod(F.xxhash64("id"), F.col("seconds"))).withColumn("one", upto("firsts"))
        return one.select("id", "label", key, F.lit(0).alias("side")).unionByName(two.select("id", "label", key, F.lit(1).alias("side")))

    tasks = met(apart.where("leads"), open_, "a").unionByName(met(apart.where("not leads"), open_.where("leads"), "b"))
    # each document's set once, then to the tasks that compare it
    sets = _fragments(_texts_of(docs, open_.select("id").distinct()), width, 1).select("id", "grams").dropDuplicates(["id"])
    return links.unionByName(_block_links(tasks.join(sets, "id").select("key", "side", "id", "label", "grams"), percent))


def _holders(classes: DataFrame) -> DataFrame:
    """(token, id, n, leads, holders, hub) for the prefix n-grams that two classes share and that lead at least one of them to partners of its size or more.

    A hot n-gram may stand in a third of all classes: those are counted by aggregation and the counts joined to salted rows. Any other occurs
    less than 2 ** HOT_LEVEL times, and a window counts it.
    """
    rows = classes.select(F.posexplode("first").alias("place", "token"), "n", F.col("rep").alias("id"), "lead", F.size("first").alias("size"), "hot")
    rows = rows.select("token", "n", "id", (F.col("place") < F.col("lead")).alias("leads"), (F.col("place") >= F.col("size") - F.col("hot")).alias("hot"))
    counts = {"holders": F.count("*"), "hub": F.min(F.when(F.col("leads"), F.col("id")))}
    few, hot = rows.where("not hot").drop("hot"), rows.where("hot").drop("hot")
    for name, count in counts.items():
        few = few.withColumn(name, count.over(Window.partitionBy("token")))
    hubs = hot.groupBy("token").agg(*(count.alias(name) for name, count in counts.items())).where("holders > 1 and hub is not null")
    return few.where("holders > 1 and hub is not null").unionByName(salted(hot, "token", hubs).select(*few.columns))


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Documents linked by Jaccard similarity of their word n-gram sets, one row for each input row: (id_col, n_shingles long, component_id).

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lowered; a text of fewer than width words has its whole sequence as one n-gram. Two documents
    link when 100 * intersection >= percent * union; component_id is the smallest id reachable by links, the document's own
    included. Null texts and texts without words have no n-grams and link with nothing. Equal sets are one class from the start, so copies
    are never expanded; repeated rows are copies. Ids are integers; rows that share an id should share the text. Rows with a null id get the component of their class (null if nobody else is in it).
    Words and n-grams are compared as 64-bit hashes. Only the named columns are read; an empty table gives an empty result.

    Every pair that links shares an n-gram among the first of each, and among the fewer that lead the smaller one to partners of its size or more (prefix
    filters; no cap): up to SMALL holders give pairs, counted by fragments of the order and summed; more holders are compared in blocks, which emit a
    spanning forest only. Documents that merely share a passage do not meet: its n-grams are frequent and come last in the order. Blocks offer their n-grams by hash range and get
    back how often each occurs; those that occur once lead to nobody and never travel again.
    """
    spark = docs.sparkSession
    blocks = written(packed_blocks(docs, id_col, text_col), "texts")
    total = blocks.agg(F.sum(F.element_at("ends", -1))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    marks = _levels(_offers(blocks, width, ranges), ranges).groupBy("block").agg(F.collect_list(F.struct("part", "levels")).alias("marks"))
    profiles = written(_profiles(blocks.join(marks, "block", "left"), width, percent, ranges), "profiles")
    discard(blocks)
    keys = ["n", "s1", "s2"]
    classes = profiles.where("n > 0").groupBy(*keys).agg(F.min("id").alias("rep"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("first", "lead", "hot")))
    held = written(_holders(classes.where("rep is not null")), "tokens")
    small = held.where(F.col("holders") <= SMALL).groupBy("token").agg(F.array_sort(F.collect_list(F.struct("n", "id", "leads"))).alias("m")).select("m").distinct()
    later = lambda x, i: F.transform(F.filter("m", lambda y, j: (j > i) & x["leads"] & (x["n"] * 100 >= y["n"] * percent)), lambda y: F.struct(x["id"].alias("a"), x["n"].alias("na"), y["id"].alias("b"), y["n"].alias("nb")))
    # m is by n: a partner further on is at least as large, and must not be too large
    pairs = small.select(F.explode(F.flatten(F.transform("m", later))).alias("p")).select("p.*").distinct()
    pairs = written(pairs, "pairs")
    wide = written(held.where(F.col("holders") > SMALL).select("token", "id", "n", "leads", "hub"), "wide")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    links = None
    if not wide.isEmpty():
        # large groups first: pairs inside what they have joined need no look
        links = written(_wide_links(texts, wide, width, percent), "links")
        label = components(links)
        one, two = (label.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in ("a", "b"))
        pairs = pairs.join(one, "a", "left").join(two, "b", "left")
        pairs = written(pairs.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "na", "b", "nb"), "pairs")
    verified = _verified(texts, pairs, width, percent)
    links = verified if links is None else links.unionByName(verified)
    found = components(links).select(F.col("node").alias("rep"), "label")
    for table in (held, pairs, wide):
        discard(table)
    named = classes.select(*keys, "rep", "copies").join(found, "rep", "left").select(*keys, "copies", F.coalesce("label", "rep").alias("label"))
    named = written(named, "named")
    # a class of copies may hold a third of all rows: those with more than one row in LARGE are at most LARGE classes, and broadcast
    large = F.broadcast(named.where(F.col("copies") * LARGE > profiles.count()).select(*keys, F.col("label").alias("large")))
    marked = profiles.select("id", *keys).join(large, keys, "left")
    others = marked.where("large is null").drop("large").join(named.drop("copies"), keys, "left")
    out = marked.where("large is not null").withColumnRenamed("large", "label").unionByName(others.select("id", *keys, "label"), allowMissingColumns=False)
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("label", "id").cast(docs.schema[id_col].dataType).alias("component_id"))
