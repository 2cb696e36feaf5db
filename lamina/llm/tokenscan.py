"""Token counts of flat token files: separator scan by blocks, stitched with a prefix scan.

A flat token file is a run of fixed-width ids without an index; documents end with one separator id.
It is held as rows (file, block, payload), which is how a scan cuts it anyway; a document may lie across blocks.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm.common import lean, text_slices, written

#: Ids in one block.
BLOCK_IDS = 1 << 18
#: Bytes of a file that one task reads, and schemes that Arrow opens by itself.
RANGE_BYTES, ARROW_STORES = 64 << 20, ("file", "hdfs", "s3", "gs")
#: Blocks that one task of the prefix scan sums before the scan goes over the sums.
RUN_BLOCKS = 1024


def file_blocks(spark: SparkSession, path: str, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks (file string, block long, payload binary) of the flat token files in a folder.

    Tasks read byte ranges, each of a whole number of blocks, so a file may have any length and is never held whole; the driver sees names
    and lengths only. A trailing part of an id is an error; files whose names begin with _ or . are left out, an empty folder gives no rows. Stores
    that Arrow's own file systems cannot open are read through Spark, whose binary rows limit a file to 2 GB.
    """
    step = block_ids * width
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    files = [(f.getPath().toString(), f.getLen()) for f in listed if f.isFile() and f.getPath().getName()[0] not in "_."]
    for name, length in files:
        if length % width:
            raise ValueError(f"{name}: {length} bytes are no whole number of {width}-byte ids")

    def cut(name: str, first: int, raw: pa.Buffer) -> Iterator[pa.RecordBatch]:
        for b in range(-(-len(raw) // step)):
            part = raw[b * step : (b + 1) * step].to_pybytes()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first + b], pa.int64()), pa.array([part], pa.binary())], ["file", "block", "payload"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                store, at = fs.FileSystem.from_uri(row["uri"])
                with store.open_input_file(at) as f:
                    f.seek(row["first"] * step)
                    yield from cut(row["file"], row["first"], f.read_buffer(row["blocks"] * step))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0), batch.column(1)):
                yield from cut(name.as_py(), 0, blob.as_buffer())

    schema = "file string, block long, payload binary"
    if files and files[0][0].split(":")[0] not in ARROW_STORES:
        return spark.read.format("binaryFile").load(path).where(~F.col("path").rlike(r"/[_.][^/]*$")).select("path", "content").mapInArrow(lean(whole), schema)
    count = max(1, RANGE_BYTES // step)
    parts = [(name, re.sub("^file:/+", "file:///", name), first, count) for name, length in files for first in range(0, -(-length // step), count)]
    return spark.createDataFrame(parts, "file string, uri string, first long, blocks long").repartition(max(1, len(parts))).mapInArrow(lean(ranges), schema)


def token_blocks(docs: DataFrame, ranks_path: str, pattern: str, separator: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Tokenise every whole text (null: empty) into flat 16-bit files, one for each input partition: (file int, block long, payload binary, first long, names array of id).

    Rows with a block hold the file itself, which knows nothing of documents. Rows without one (block and payload null) name the documents in their
    order in the file, from number `first` on: what a file's writer knew, kept beside it and never read by the scan.
    """
    raw = Path(ranks_path).read_bytes()
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import TaskContext

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        if max([separator, *ranks.values()]) > 0xFFFF:
            raise ValueError("ids do not fit 16 bits")
        codec = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        file, block, held, size, first = TaskContext.get().partitionId(), 0, [], 0, 0
        head = ["file", "block", "payload", "first", "names"]

        def put(part: np.ndarray) -> pa.RecordBatch:
            nonlocal block
            block += 1
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block - 1], pa.int64()), pa.array([part.tobytes()], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(name_type))], head)

        name_type = None
        for batch in batches:
            name_type = batch.column(0).type
            for rows, texts in text_slices(batch, 1):
                names = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([first], pa.int64()), names], head)
                first += rows.num_rows
                for text in texts.to_pylist():
                    ids = np.array([*codec.encode_ordinary(text), separator], "<u2")
                    held.append(ids)
                    size += len(ids)
                    if size >= block_ids:
                        flat = np.concatenate(held)
                        until = size - size % block_ids
                        for cut in range(0, until, block_ids):
                            yield put(flat[cut : cut + block_ids])
                        held, size = [flat[until:]], size - until
        if size:
            yield put(np.concatenate(held))

    return docs.select(id_col, text_col).mapInArrow(lean(run), f"file int, block long, payload binary, first long, names array<{id_type.simpleString()}>")


def scan(blocks: DataFrame, separator: int, width: int = 2, run_blocks: int = RUN_BLOCKS) -> DataFrame:
    """Token counts of the documents in flat files: (file, ordinal long from 0, n_tokens long without the separator, terminated boolean).

    Each block is searched on its own for separators (one vectorised comparison) and gives its inner counts, the
    ids before its first separator and those after its last. A prefix scan over these summaries, in two levels so
    that no task sees more than a share of one file, numbers the documents and carries open lengths over blocks.
    Two separators in a row are a document of 0 tokens; what follows the last separator is a document with
    terminated = false unless empty. A null payload counts as an empty block; an empty table gives no rows.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = f"<u{width}"
        for batch in batches:
            rows = []
            for payload in batch.column(2):
                ids = np.frombuffer(payload.as_buffer(), kind) if payload.is_valid else np.zeros(0, kind)
                at = np.flatnonzero(ids == separator)
                rows.append((len(at), int(at[0]) if len(at) else len(ids), len(ids) - 1 - int(at[-1]) if len(at) else len(ids), (np.diff(at) - 1).tolist()))
            n, head, tail, inner = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(head, pa.int64()), pa.array(tail, pa.int64()), pa.array(inner, pa.list_(pa.int64()))], ["file", "block", "n", "head", "tail", "inner"])

    file_type = blocks.schema["file"].dataType.simpleString()
    found = blocks.select("file", "block", "payload").mapInArrow(lean(search), f"file {file_type}, block long, n long, head long, tail long, inner array<long>")
    found = written(found, "summaries").withColumn("run", F.floor(F.col("block") / run_blocks))  # the levels of the scan read these, not the tokens
    # Level 2: what lies open before each run of blocks, from the runs' own sums.
    last = F.max_by(F.struct("tail", "block"), F.when(F.col("n") > 0, F.col("block")))
    runs = found.groupBy("file", "run").agg(F.sum("n").alias("rn"), F.sum("tail").alias("all_tail"), last.alias("last"), F.collect_list(F.struct("block", "n", "tail")).alias("sums"))
    after = F.aggregate(F.filter("sums", lambda s: s["block"] > F.col("last.block")), F.lit(0).cast("long"), lambda a, s: a + s["tail"])
    runs = runs.select("file", "run", "rn", F.when(F.col("rn") > 0, F.col("last.tail") + after).otherwise(F.col("all_tail")).alias("open"))
    before = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("closed", F.sum(F.when(F.col("rn") > 0, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("run")))
    runs = runs.withColumn("epoch", F.col("closed") - F.when(F.col("rn") > 0, 1).otherwise(0))
    opened = Window.partitionBy("file", F.col("closed")).orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("open_after", F.sum("open").over(opened))
    base = runs.select("file", "run", F.coalesce(F.sum("rn").over(before), F.lit(0)).alias("run_base"), F.coalesce(F.lag("open_after").over(Window.partitionBy("file").orderBy("run")), F.lit(0)).alias("run_open"), (F.row_number().over(Window.partitionBy("file").orderBy(F.desc("run"))) == 1).alias("last_run"))
    # Level 1: the same within each run.
    own = Window.partitionBy("file", "run").orderBy("block")
    ahead = own.rowsBetween(Window.unboundedPreceding, -1)
    part = found.withColumn("closed", F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(own))
    part = part.withColumn("open_after", F.sum("tail").over(Window.partitionBy("file", "run", "closed").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    part = part.withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0))).withColumn("carried", F.coalesce(F.lag("open_after").over(own), F.lit(0))).withColumn("before_closed", F.col("closed") - F.when(F.col("n") > 0, 1).otherwise(0))
    part = part.withColumn("last_block", F.lead("block").over(own).isNull())
    part = part.join(base, ["file", "run"])
    carried = F.col("carried") + F.when(F.col("before_closed") == 0, F.col("run_open")).otherwise(0)
    first = F.array(carried + F.col("head"))
    start = F.col("base") + F.col("run_base")
    ended = part.where("n > 0").select("file", F.posexplode(F.concat(first, F.col("inner"))).alias("k", "n_tokens"), start.alias("start"))
    ended = ended.select("file", (F.col("start") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("terminated"))
    rest = part.where("last_run and last_block").select("file", (start + F.col("n")).alias("ordinal"), F.when(F.col("n") > 0, F.col("tail")).otherwise(carried + F.col("tail")).alias("n_tokens"), F.lit(False).alias("terminated")).where("n_tokens > 0")
    return ended.unionByName(rest)


def named_counts(tokens: DataFrame, separator: int, id_col: str = "doc_id") -> DataFrame:
    """scan() of written token_blocks() output with each document's id put back by file and number: (id_col, n_tokens).

    Every document has its row: null and empty texts count 0, repeated ids and null ids are kept, an empty table gives no rows.
    """
    counts = scan(tokens.where("block is not null"), separator)
    names = tokens.where("block is null").select("file", "first", F.posexplode("names").alias("k", "name"))
    names = names.select("file", (F.col("first") + F.col("k")).alias("ordinal"), F.col("name").alias(id_col))
    return names.join(counts, ["file", "ordinal"]).select(id_col, "n_tokens")
