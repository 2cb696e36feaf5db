"""Shared plumbing of the training-data operators: Arrow text access and scratch tables."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into numpy arrays at once; one longer text stands alone.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (unset, in a local session as in tests) one in the warehouse; on a cluster it must be set."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return set_dir or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lamina_scratch"


#: Scratch tables made in this process and not yet discarded.
_made: list[str] = []


def written(df: DataFrame, label: str, scratch: bool = True) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lamina/{label}-{uuid.uuid4().hex}"
    if scratch:
        _made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(table: DataFrame) -> None:
    """Delete a scratch table that written() made and nothing will read again."""
    files = table.inputFiles()[:1]
    for path in [p for p in _made if files and p.rsplit("/", 1)[1] in files[0]]:
        _delete(table.sparkSession, path)
        _made.remove(path)


class ScratchScope:
    """Scratch tables made inside the block, which close() deletes once its results are written."""

    def __enter__(self) -> ScratchScope:
        self.start = len(_made)
        return self

    def __exit__(self, *_) -> None:
        self.paths = _made[self.start :]

    def close(self, spark: SparkSession) -> None:
        for path in self.paths:
            if path in _made:
                _delete(spark, path)
                _made.remove(path)
        self.paths = []


def purge_scratch(spark: SparkSession) -> None:
    """Delete every table that written() has made below this session's shared folder."""
    _delete(spark, f"{shared_dir(spark)}/lamina")
    _made.clear()


#: Rows in one Arrow batch between the JVM and a worker: texts are large.
BATCH_ROWS = 2000


def lean_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold few rows, as the session's default suits short rows and would buffer tens of MB of text.

    Plans are run after the call that makes them has returned, so the setting stays for the session; a smaller one is kept.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def lean(run):
    """run for mapInArrow, handing free memory back to the system at its end: workers live on for other operators."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


def string_array(column: pa.Array) -> pa.Array:
    """Strings without nulls (null counts as empty) in one array with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the n + 1 offsets of the texts in them."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def text_slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut a batch by rows so that each part holds about `limit` bytes of text: (rows, their texts)."""
    if not batch.num_rows:
        return
    texts = string_array(batch.column(column))
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start), texts.slice(start, stop - start)
        start = stop


def gather_ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0]..starts[0]+lengths[0]-1, then those of the next run, and so on."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return out + np.arange(total)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the usual xor-shift-multiply avalanche); changes nothing in place."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        base = int(_STEP)
        for k, b in enumerate((base, pow(base, -1, 1 << 64))):
            step = np.full(size, b, np.uint64)
            step[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def run_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, limit: int = 0) -> np.ndarray:
    """64-bit hash of data[start:stop] for each run: polynomial prefix sums, shifted to the run's origin and mixed."""
    up, down = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((mix64(data.astype(np.uint64) + _STEP)) * up[: len(data)], out=prefix[1:])
        raw = (prefix[stops] - prefix[starts]) * down[starts]
    return mix64(raw + mix64((stops - starts).astype(np.uint64)))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ (A-Z lowered) of all texts, and for each the number of its text."""
    data, ends = byte_view(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    inner = ends[1:-1]
    inner = inner[inner < len(data)]
    first[inner] = ~space[inner]
    last = ~space
    last[:-1] &= space[1:]
    edge = inner[inner > 0] - 1
    last[edge] = ~space[edge]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return run_hashes(_LOWER[data], starts, stops), np.searchsorted(ends, starts, "right") - 1


#: Byte classes: 0 white space, 1 letters, digits and all bytes beyond ASCII, 2 other signs.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def class_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters and of signs in all texts: (bytes with A-Z lowered, starts, stops, number of each run's text)."""
    data, ends = byte_view(texts)
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, none
    kind = _CLASS[data]
    turn = np.ones(len(data) + 1, bool)
    turn[1:-1] = kind[1:] != kind[:-1]
    turn[ends[1:-1]] = True
    cuts = np.flatnonzero(turn)
    starts, stops = cuts[:-1], cuts[1:]
    keep = kind[starts] > 0
    starts, stops = starts[keep], stops[keep]
    return _LOWER[data], starts, stops, np.searchsorted(ends, starts, "right") - 1


#: Bytes of text in a block, and the id that a document without one has in it.
BLOCK_BYTES, NO_ID = 4 << 20, np.iinfo(np.int64).max


def codec(level: int = 3):
    import zstandard

    return zstandard.ZstdCompressor(level=level), zstandard.ZstdDecompressor()


def packed_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Whole documents in blocks of about BLOCK_BYTES: (block, ids, ends, data compressed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        squeeze, _ = codec(6)
        number = TaskContext.get().partitionId() << 32
        ids, parts, lengths, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal number, size
            ends = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int64)
            row = [pa.array([number], pa.int64()), pa.array([[i for x in ids for i in x]], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([squeeze.compress(b"".join(parts))], pa.binary())]
            ids.clear(), parts.clear(), lengths.clear()
            number, size = number + 1, 0
            return pa.RecordBatch.from_arrays(row, ["block", "ids", "ends", "data"])

        for batch in batches:
            for rows, texts in text_slices(batch, 1):
                data, ends = byte_view(texts)
                ids.append(rows.column(0).to_pylist())
                parts.append(data.tobytes())
                lengths.append(np.diff(ends))
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield out()
        if ids:
            yield out()

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(lean(run), "block long, ids array<long>, ends array<long>, data binary")


def unpacked_block(row: dict, loose) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a block's texts end to end, their n + 1 offsets, and their ids (NO_ID for none)."""
    data = np.frombuffer(loose.decompress(row["data"], max_output_size=max(1, row["ends"][-1])) if row["ends"][-1] else b"", np.uint8)
    ids = np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)
    return data, np.array(row["ends"], np.int64), ids


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one part after another, from rows sorted by part."""
    part, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["part"] != part:
                yield part, held
                held = []
            part = row["part"]
            held.append(row)
    if held:
        yield part, held


def salted(many: DataFrame, by: str, one: DataFrame, salts: int = 16) -> DataFrame:
    """many joined with one (a row or a few for each key `by`), each key's rows dealt to so many parts: one key may hold a third of all rows."""
    spread = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = many.withColumn("salt", F.pmod(F.xxhash64(*(c for c in many.columns if c != by)), F.lit(salts)).cast("int"))
    return dealt.join(spread, [by, "salt"]).drop("salt")
