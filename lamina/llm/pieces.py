"""SentencePiece encoding and decoding by a distinct-chunk table."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import gather_ragged, lean, text_slices

MARK = "▁"
#: A chunk is a run of markers with what follows up to the next marker or line feed, or one line feed.
CHUNK = re.compile(rf"[ {MARK}]*[^ {MARK}\n]+|[ {MARK}]+|\n")
#: Bytes that the distinct chunks of a Python worker may take before it starts its table anew, bytes a chunk takes besides its
#: characters and ids, and characters from which a chunk is not kept.
TABLE_BYTES, CHUNK_COST, LONG_CHUNK = 24 << 20, 160, 512


class ChunkTable:
    """Distinct marked words with their piece ids, each segmented once by the library.

    A chunk can be segmented alone when no piece holds a marker after another character and none
    joins a line feed to anything; both are read off the vocabulary, and otherwise whole texts are encoded.
    """

    def __init__(self, model: bytes, most: int = TABLE_BYTES):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.feed = self.sp.encode("\n")
        probe = "  a  b\nc \n\n d"
        self.chunked = not any(re.search(rf"[^{MARK}]{MARK}|.\n|\n.", p, re.S) for p in names) and len(self.feed) == 2 and self.sp.decode(self.sp.encode(probe)) == probe
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 12, np.int64)
        self.size = 0

    def add(self, chunks: list[str]) -> None:
        """Segment chunks that the table does not hold yet."""
        marked = [c[0] in (" ", MARK) for c in chunks]
        # the library puts one marker before a text: take it from the chunk, or hide it before a line feed
        feeds = [c[1:] if m else "\n" + c for c, m in zip(chunks, marked)]
        rows = self.sp.encode(feeds, num_threads=1)
        lone = self.sp.piece_to_id(MARK)
        rows = [(r or [lone]) if m else r[2:] for r, m in zip(rows, marked)]
        n, sizes = len(self.index), np.fromiter(map(len, rows), np.int64, len(rows))
        while n + len(rows) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ends[n + 1 : n + 1 + len(rows)] = self.ends[n] + np.cumsum(sizes)
        while self.ends[n + len(rows)] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.ends[n] : self.ends[n + len(rows)]] = np.fromiter((i for r in rows for i in r), np.uint32, int(sizes.sum()))
        for k, c in enumerate(chunks):
            self.index[c] = n + k
        self.size += sum(map(len, chunks)) + 4 * int(sizes.sum()) + CHUNK_COST * len(chunks)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts end to end, and the n + 1 offsets of the texts in them."""
        if not self.chunked:
            rows = self.sp.encode(texts, num_threads=1)
            ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            return np.fromiter((i for r in rows for i in r), np.uint32, int(ends[-1])), ends
        if self.size > self.most:
            self.clear()
        lists = [CHUNK.findall(" " + t) if t else [] for t in texts]
        new: dict[str, None] = {}
        for chunks in lists:
            new.update(dict.fromkeys(c for c in chunks if c not in self.index))
        if new:
            self.add(list(new))
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        at = np.fromiter((i for chunks in lists for i in map(self.index.__getitem__, chunks)), np.int64, int(counts.sum()))
        sizes = self.ends[at + 1] - self.ends[at]
        ids = self.ids[gather_ragged(self.ends[at], sizes)]
        until = np.concatenate([[0], np.cumsum(sizes)])
        if any(len(c) > LONG_CHUNK for c in new):  # these have served: a few of them would fill the table
            self.clear()
        return ids, until[np.concatenate([[0], np.cumsum(counts)])]


#: This worker's table, kept for its next tasks: {model digest: table}, one at a time.
_tables: dict[str, ChunkTable] = {}


def _table(model: bytes) -> ChunkTable:
    name = hashlib.sha256(model).hexdigest()
    if name not in _tables:
        _tables.clear()
        _tables[name] = ChunkTable(model)
    return _tables[name]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode every whole text exactly as the sentencepiece library does (begin and end ids, no sampling) and decode it again.

    Returns one row per input row: (id_col, the columns of keep as they are, ids binary: little-endian unsigned 32-bit ids, decoded string).
    Null and empty texts give the begin and end ids and an empty decoded text. Repeated rows and null ids
    are kept as they are; other columns are not read. Texts of any length are encoded whole. An empty table
    gives an empty result. The model file is read on the driver and sent with the task (its size bounds it).
    A worker keeps its chunk table from task to task and starts it anew beyond TABLE_BYTES, so memory does not follow the input.
    """
    model = Path(model_path).read_bytes()
    carried = [id_col, *keep]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model)
        bos, eos = np.uint32(table.sp.bos_id()), np.uint32(table.sp.eos_id())
        for batch in batches:
            for rows, texts in text_slices(batch, len(carried)):
                ids, ends = table.encode(texts.to_pylist())
                outs, decoded = [], []
                for a, b in zip(ends[:-1], ends[1:]):
                    own = np.empty(b - a + 2, "<u4")
                    own[0], own[-1] = bos, eos
                    own[1:-1] = ids[a:b]
                    outs.append(own.tobytes())
                    decoded.append(table.sp.decode(own.tolist()))
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in range(len(carried))), pa.array(outs, pa.binary()), pa.array(decoded, pa.string())], [*carried, "ids", "decoded"])

    return docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)), F.col(text_col).alias("t")).mapInArrow(lean(run), f"{kinds}, ids binary, decoded string")


def ids_of(blob: bytes) -> list[int]:
    """The ids column as a list of integers."""
    return np.frombuffer(blob, "<u4").tolist()


def digest_reference(text: str | None, processor) -> tuple[int, str, str]:
    """What the query must return for one text, straight from the library (for tests)."""
    ids = processor.encode(text or "", add_bos=True, add_eos=True)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(processor.decode(ids).encode()).hexdigest()
