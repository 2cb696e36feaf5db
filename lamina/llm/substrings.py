"""Exact substring dedup: windows grouped by a content-chosen cover, one bucket at a time. No suffix array is built.

Cover positions are chosen by content: a gram of GRAM bytes whose hash is least in some window of LENGTH bytes. They have
the property a difference cover is used for - two equal windows hold a cover position at the same offset, here for any
alignment of any two documents - at about one position in fourteen. A bucket is all windows that hold the same cover
gram at the same offset. Windows of a bucket are told apart by the rank of the bytes before the gram and, where these tie, by the rank of
the bytes behind it, both sorted once for all offsets of the bucket's contexts. A cover by position with stored suffix ranks would
ship several times more: see the README for figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import NO_ID, by_part, codec, lean, mix64, packed_blocks, unpacked_block, written

#: Bytes of a window, of a cover gram, and on either side of a gram in its context.
LENGTH, GRAM = 50, 24
SIDE = LENGTH - GRAM
#: Positions hashed at once, and bytes of text behind one suffix bucket range.
STEP, RANGE = 1 << 18, 32 << 20

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_RECORD = np.dtype([("context", f"V{LENGTH + SIDE}"), ("left", "u1"), ("right", "u1"), ("least", "<i8"), ("most", "<i8")])
_ANSWER = np.dtype([("number", "<u4"), ("first", "u1"), ("last", "u1"), ("doc", "<i8")])


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or largest of each width neighbours x[i : i + width], by doubling."""
    pick = np.minimum if least else np.maximum
    done = 1
    while done * 2 <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    return pick(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def cover(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cover positions of texts end to end (ends: n + 1 offsets), rising, and the hashes of their grams."""
    windows = SIDE + 1
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = np.ones(n, bool)  # windows inside one text
    for a, b in zip(ends[:-1], ends[1:]):
        whole[max(a, b - LENGTH + 1) : b] = False
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data),), "<u8", padded, strides=(1,))
    at, hashes = [], []
    for a in range(0, n, STEP):
        b = min(n, a + STEP)
        m = b - a + windows - 1  # grams of these windows
        with np.errstate(over="ignore"):
            h = words[a : a + m] * _ODD[0]
            for k in (1, 2):
                h += words[a + 8 * k : a + 8 * k + m] * _ODD[k]
        h = mix64(h) | np.uint64(1)
        least = np.where(whole[a:b], _sliding(h, windows, True), np.uint64(0))
        edge = np.zeros(windows - 1, np.uint64)
        chosen = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), windows, False) == h)
        at.append(chosen + a)
        hashes.append(h[chosen])
    at, first = np.unique(np.concatenate(at), return_index=True)
    return at, np.concatenate(hashes)[first]


#: Bits of a gram's hash that are offered; the range holds more of it.
OFFER_BITS, OFFER_BYTES = 32, 4


def _keys(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Range (in front) and offered bits of each hash."""
    low = (hashes >> np.uint64(1)) & np.uint64((1 << OFFER_BITS) - 1)
    return ((hashes >> np.uint64(OFFER_BITS + 1)) % np.uint64(ranges)) << np.uint64(OFFER_BITS) | low


def _wanted(hashes: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct keys, those met more than once twice, in order: (keys, cuts of the ranges)."""
    keys, counts = np.unique(_keys(hashes, ranges), return_counts=True)
    keys = np.repeat(keys, np.minimum(counts, 2))
    return keys, np.searchsorted(keys >> np.uint64(OFFER_BITS), np.arange(ranges + 1))


def _trimmed(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :OFFER_BYTES]).tobytes()


def _untrimmed(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // OFFER_BYTES, 8), np.uint8)
    out[:, :OFFER_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, OFFER_BYTES)
    return out.view("<u8").ravel()


def _columnar(rec: np.ndarray) -> bytes:
    """Records field by field, which compresses better."""
    return b"".join(np.ascontiguousarray(rec[name]).tobytes() for name in rec.dtype.names)


def _records(blob: bytes, dtype: np.dtype) -> np.ndarray:
    n, at = len(blob) // dtype.itemsize, 0
    out = np.zeros(n, dtype)
    for name in dtype.names:
        kind = dtype[name]
        out[name] = np.frombuffer(blob, kind, n, at)
        at += n * kind.itemsize
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """Rising numbers as their steps."""
    return np.diff(x, prepend=0).astype("<u4")


def _offers(blocks: DataFrame, ranges: int) -> DataFrame:
    """Each block's cover grams by hash range: (part, block, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, loose = codec()
        for batch in batches:
            for row in batch.to_pylist():
                data, ends, _ = unpacked_block(row, loose)
                values, cuts = _wanted(cover(data, ends)[1], ranges)
                parts = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([row["block"]] * len(parts), pa.int64()), pa.array([_trimmed(values[cuts[p] : cuts[p + 1]]) for p in parts], pa.binary())], ["part", "block", "grams"])

    return blocks.mapInArrow(lean(run), "part long, block long, grams binary")


def _repeats(offers: DataFrame, ranges: int) -> DataFrame:
    """Which of a block's offered grams occur twice anywhere: (block, part, marks: packed bits in the offer's order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in by_part(batches):
            lists = [_untrimmed(r["grams"]) for r in rows]
            _, back, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
            marks = np.split(counts[back] > 1, np.cumsum([len(x) for x in lists])[:-1])
            some = [i for i, m in enumerate(marks) if m.any()]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([rows[i]["block"] for i in some], pa.int64()), pa.array([part] * len(some), pa.int64()), pa.array([np.packbits(marks[i]).tobytes() for i in some], pa.binary())], ["block", "part", "marks"])

    dealt = offers.repartition(ranges, "part").sortWithinPartitions("part", "block")
    return dealt.mapInArrow(lean(run), "block long, part long, marks binary")


def _contexts(blocks: DataFrame, ranges: int) -> DataFrame:
    """Distinct contexts of a block's repeated grams for the bucket sort (part >= 0), and where they occur (part < 0): (part, block, base: number of the payload's first context, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, loose = codec()
        for batch in batches:
            for row in batch.to_pylist():
                data, ends, ids = unpacked_block(row, loose)
                at, hashes = cover(data, ends)
                values, cuts = _wanted(hashes, ranges)
                repeated = np.zeros(len(values), bool)
                for m in row["marks"]:
                    a, b = cuts[m["part"]], cuts[m["part"] + 1]
                    repeated[a:b] = np.unpackbits(np.frombuffer(m["marks"], np.uint8), count=b - a).astype(bool)
                at = at[np.isin(_keys(hashes, ranges), values[repeated])]
                doc = np.searchsorted(ends, at, "right") - 1
                at, doc = at[ids[doc] != NO_ID], doc[ids[doc] != NO_ID]  # a document without an id is compared with none
                if not len(at):
                    continue
                left = np.minimum(at - ends[doc], SIDE)
                right = np.minimum(ends[doc + 1] - at - GRAM, SIDE)
                padded = np.concatenate([np.zeros(SIDE, np.uint8), data, np.zeros(LENGTH, np.uint8)])
                span = np.lib.stride_tricks.sliding_window_view(padded, LENGTH + SIDE)[at]  # begins SIDE before the gram
                column = np.arange(LENGTH + SIDE)
                full = (column >= SIDE - left[:, None]) & (column < LENGTH + right[:, None])
                key = np.zeros((len(at), LENGTH + SIDE + 2), np.uint8)
                key[:, :-2] = span * full
                key[:, -2], key[:, -1] = left, right
                first_of = np.argsort(ids[doc], kind="stable")
                distinct, first, back = np.unique(key[first_of].view(f"V{key.shape[1]}").ravel(), return_index=True, return_inverse=True)
                number = np.empty(len(at), np.int64)
                number[first_of] = back
                most = np.full(len(distinct), np.iinfo(np.int64).min)
                np.maximum.at(most, number, ids[doc])
                raw = distinct.view(np.uint8).reshape(len(distinct), -1)
                part = (_hash_grams(raw[:, SIDE:LENGTH]) % np.uint64(ranges)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                renumbered = np.empty(len(order), np.int64)
                renumbered[order] = np.arange(len(order))  # contexts are numbered in the order they travel
                rec = np.zeros(len(distinct), _RECORD)
                rec["context"] = np.ascontiguousarray(raw[:, :-2]).view(f"V{LENGTH + SIDE}").ravel()
                rec["left"], rec["right"] = raw[:, -2], raw[:, -1]
                rec["least"], rec["most"] = ids[doc][first_of][first], most
                rec = rec[order]
                cuts = np.searchsorted(part[order], np.arange(ranges + 1))
                parts = np.flatnonzero(np.diff(cuts))
                payloads = [squeeze.compress(_columnar(rec[cuts[p] : cuts[p + 1]])) for p in parts]
                places = squeeze.compress(np.concatenate([_steps(at), renumbered[number].astype("<u4")]).tobytes())
                keys = pa.array([*parts.tolist(), -1 - row["block"]], pa.int64())
                bases = pa.array([*cuts[parts].tolist(), 0], pa.int64())
                yield pa.RecordBatch.from_arrays([keys, pa.array([row["block"]] * len(keys), pa.int64()), bases, pa.array([*payloads, places], pa.binary())], ["part", "block", "base", "payload"])

    return blocks.mapInArrow(lean(run), "part long, block long, base long, payload binary")


def _hash_grams(grams: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(grams).view("<u8")
    with np.errstate(over="ignore"):
        return mix64(words[:, 0] * _ODD[0] + words[:, 1] * _ODD[1] + words[:, 2] * _ODD[2])


def _columns(raw: np.ndarray) -> list[np.ndarray]:
    """Big-endian 64-bit columns whose order is the bytes' order, least significant first as lexsort wants."""
    wide = np.zeros((len(raw), -(-raw.shape[1] // 8) * 8), np.uint8)
    wide[:, : raw.shape[1]] = raw
    words = wide.view(">u8")
    return [words[:, k].astype(np.uint64) for k in range(words.shape[1] - 1, -1, -1)]


def _ranks(gram: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by gram and then by bytes, and for each in that order how many bytes it shares with the one before it (-1: another gram)."""
    order = np.lexsort([*_columns(raw), gram])
    a, b = raw[order[1:]], raw[order[:-1]]
    differ = a != b
    shared = np.where(differ.any(1), differ.argmax(1), raw.shape[1])
    shared[gram[order[1:]] != gram[order[:-1]]] = -1
    return order, np.concatenate([[-1], shared])


def first_documents(context: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For contexts (rows of LENGTH + SIDE bytes) the smallest document with the same window at each offset, as far as these rows tell.

    Returns (row, SIDE + 1): window s starts s bytes into the context; NO_ID where it does not fit the context's text.
    """
    n = len(context)
    _, gram = np.unique(np.ascontiguousarray(context[:, SIDE:LENGTH]).view(f"V{GRAM}").ravel(), return_inverse=True)
    by_right, share_right = _ranks(gram, context[:, LENGTH:])
    by_left, share_left = _ranks(gram, context[:, :SIDE][:, ::-1])
    out = np.full((n, SIDE + 1), NO_ID, np.int64)
    order = np.argsort(doc, kind="stable")
    for s in range(SIDE + 1):
        fits = (left >= SIDE - s) & (right >= s)
        if not fits.any():
            continue
        # the bucket (gram, s): rank of the bytes before the gram, then the cover position's rank to the bytes after it
        before, after = np.empty(n, np.int64), np.empty(n, np.int64)
        before[by_left] = np.cumsum(share_left < SIDE - s)
        after[by_right] = np.cumsum(share_right < s)
        rows = order[fits[order]]
        _, first, back = np.unique(before[rows] * (n + 1) + after[rows], return_index=True, return_inverse=True)
        out[rows, s] = doc[rows[first]][back]
    return out


def _answers(contexts: DataFrame, ranges: int) -> DataFrame:
    """Sort one bucket range at a time and tell each block which windows begin in an earlier document: (block, answers, places as they came)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, loose = codec()
        for part, rows in by_part(batches):
            if part < 0:
                yield pa.RecordBatch.from_arrays([pa.array([r["block"] for r in rows], pa.int64()), pa.nulls(len(rows), pa.binary()), pa.array([r["payload"] for r in rows], pa.binary())], ["block", "answers", "places"])
                continue
            recs = [_records(loose.decompress(r["payload"]), _RECORD) for r in rows]
            rec = np.concatenate(recs)
            owner = np.repeat(np.arange(len(rows)), [len(x) for x in recs])
            number = np.concatenate([r["base"] + np.arange(len(x)) for r, x in zip(rows, recs)])
            raw = np.ascontiguousarray(rec["context"]).view(np.uint8).reshape(len(rec), -1)
            least = first_documents(raw, rec["left"].astype(int), rec["right"].astype(int), rec["least"])
            hit = least < rec["most"][:, None]
            # runs of offsets with one document
            change = np.ones_like(hit)
            change[:, 1:] = (least[:, 1:] != least[:, :-1]) | (hit[:, 1:] != hit[:, :-1])
            r, s = np.nonzero(change)
            after = np.append(s[1:], SIDE + 1)
            last = np.where(np.append(r[1:], -1) == r, after, SIDE + 1) - 1
            keep = hit[r, s]
            answer = np.zeros(int(keep.sum()), _ANSWER)
            answer["number"], answer["first"], answer["last"], answer["doc"] = number[r[keep]], s[keep], last[keep], least[r[keep], s[keep]]
            cuts = np.searchsorted(owner[r[keep]], np.arange(len(rows) + 1))
            some = [i for i in range(len(rows)) if cuts[i + 1] > cuts[i]]
            for i in some:
                answer["number"][cuts[i] : cuts[i + 1]] = _steps(answer["number"][cuts[i] : cuts[i + 1]].astype(np.int64))
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([rows[i]["block"] for i in some], pa.int64()), pa.array([squeeze.compress(_columnar(answer[cuts[i] : cuts[i + 1]])) for i in some], pa.binary()), pa.nulls(len(some), pa.binary())], ["block", "answers", "places"])

    dealt = contexts.repartition(ranges, "part").sortWithinPartitions("part", "block")
    return dealt.mapInArrow(lean(run), "block long, answers binary, places binary")


def _cut(blocks: DataFrame) -> DataFrame:
    """Removed runs and kept bytes of every document of blocks joined with places and answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, loose = codec()
        for batch in batches:
            for row in batch.to_pylist():
                data, ends, ids = unpacked_block(row, loose)
                edges = np.zeros(len(data) + 1, np.int32)
                if row["places"] is not None and row["answers"]:
                    at, number = np.frombuffer(loose.decompress(row["places"]), "<u4").astype(np.int64).reshape(2, -1)
                    at = np.cumsum(at)
                    found = [_records(loose.decompress(x), _ANSWER) for x in row["answers"]]
                    for x in found:
                        x["number"] = np.cumsum(x["number"].astype(np.int64))
                    answer = np.concatenate(found)
                    answer = answer[np.argsort(answer["number"], kind="stable")]
                    a, b = np.searchsorted(answer["number"], number), np.searchsorted(answer["number"], number, "right")
                    place = np.repeat(np.arange(len(at)), b - a)
                    mine = answer[np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange(len(place))]
                    own = ids[np.searchsorted(ends, at[place], "right") - 1]
                    hit = mine["doc"] < own
                    begin = at[place[hit]] - SIDE
                    np.add.at(edges, begin + mine["first"][hit], 1)
                    np.add.at(edges, begin + mine["last"][hit] + LENGTH, -1)
                gone = np.cumsum(edges[:-1]) > 0
                spans, kept = [], []
                for a, b in zip(ends[:-1], ends[1:]):
                    own = gone[a:b]
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                    spans.append([{"start": x, "stop": y} for x, y in turn.reshape(-1, 2).tolist()])
                    kept.append(data[a:b][~own].tobytes())
                lengths = np.diff(ends)
                step = max(1, len(kept) // (1 + len(data) // (2 << 20)))
                for i in range(0, len(kept), step):
                    yield pa.RecordBatch.from_arrays([pa.array(row["ids"][i : i + step], pa.int64()), pa.array(lengths[i : i + step]), pa.array(spans[i : i + step], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept[i : i + step], pa.binary())], ["id", "n_bytes", "spans", "kept"])

    return blocks.mapInArrow(lean(run), "id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove from every whole text, as UTF-8 bytes, each byte of a LENGTH-byte string that also starts in a document with a smaller id.

    Returns one row for each input row: (id_col, n_bytes long, spans array of (start, stop) of the maximal removed runs, kept binary: the
    remaining bytes). Overlapping strings count and all are judged on the input. Matches never cross documents. Null and empty
    texts, and texts shorter than LENGTH, lose nothing. Rows that repeat an id do not remove from each other; rows
    with a null id lose nothing and remove nothing. Only the named columns are read; an empty table gives no rows.

    Blocks offer their cover grams by hash range; grams met once fall out. For the rest a block sends each distinct context once, with the
    smallest and largest document that has it, to the bucket sort, so a passage in a third of all documents is one
    context a block. Memory of a task is a block or a bucket range. A range is set from the input's size, but one gram's contexts stay together: a gram
    that stands in very many different contexts makes its range larger.
    """
    blocks = written(packed_blocks(docs, id_col, text_col), "bytes")
    total = blocks.agg(F.sum(F.element_at("ends", -1))).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE))
    marks = _repeats(_offers(blocks, ranges), ranges).groupBy("block").agg(F.collect_list(F.struct("part", "marks")).alias("marks"))
    answers = _answers(_contexts(blocks.join(marks, "block"), ranges), ranges)
    answers = answers.groupBy("block").agg(F.collect_list("answers").alias("answers"), F.first("places", ignorenulls=True).alias("places"))
    return _cut(blocks.join(answers, "block", "left")).withColumnRenamed("id", id_col)
