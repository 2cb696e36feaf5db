"""A corpus pipeline over documents: each stage's output is written as Parquet and is the next one's input."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import decontaminate, jaccard, language, personal, pieces, queries
from lamina.llm.common import ScratchScope, discard, lean_batches, written

#: No SQL for run(): language scores, edit matching and SentencePiece ids have none. Tested against a plain version instead.
ORACLE_SQL = None
#: Words in a shingle and least similarity of near duplicates.
WIDTH, PERCENT = 5, 80


_last: list[ScratchScope] = []


def _stage(f):
    """A stage whose scratch tables go when the next stage starts: by then its output has been written."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _last:
            _last.pop().close(spark)
        lean_batches(spark)
        with ScratchScope() as scope:
            out = f(spark, docs, sf_dir)
        _last.append(scope)
        return out

    return run_stage


@_stage
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn languages from the labelled rows and drop texts without letters or without a likely language.

    Null, empty and letterless texts go; repeated rows, rows without an id and columns of any name stay as they are. If no row
    has a label, every text with a letter stays. A tie goes to the first language by name. An empty table stays empty.
    """
    vocabulary = language.vocabulary(queries.tokenizer_path(queries.PIECE_MODEL))
    langs, p = language.train(docs.where(~language.held_out()), vocabulary)
    return language.in_known_language(docs, vocabulary, langs, p)


@_stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group that is linked by WIDTH-word n-grams at PERCENT similarity or more.

    Rows are told apart by a key of their own, so one id may stand on several texts and ids may be null. The row kept is the one with
    the smallest id (null last), then the smallest hash of its content; of equal rows one stays. Texts without words are linked with
    nothing and all stay. Columns may have any name. An empty table stays empty.
    """
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    keyed = written(docs.select(F.monotonically_increasing_id().alias("row"), doc.alias("doc")), "rows")
    linked = jaccard.link_components(keyed.select("row", "doc.text"), "row", width=WIDTH, percent=PERCENT)
    order = F.struct(F.col("doc.doc_id").isNull(), F.col("doc.doc_id"), F.xxhash64("doc"), F.col("row"))
    named = keyed.select("row", order.alias("order")).join(linked, "row")
    firsts = named.groupBy("component_id").agg(F.min("order").alias("least")).select(F.col("least.row").alias("row"))
    kept = keyed.join(firsts, "row", "left_semi")
    return kept.select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))


@_stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item within its edits.

    Null and empty texts hold none and stay, as do repeated rows and rows without an id; items that are null or have no word match nothing.
    Columns may have any name; an empty table stays empty and an empty benchmark drops nothing.
    """
    return decontaminate.without_items(docs, queries.table(spark, sf_dir, "benchmark"))


@_stage
def personal_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets and count the characters anew (null for a null text).

    Every row stays, with its own spans even if its id is null or repeated; overlapping spans go together under the first one's kind.
    """
    return personal.redacted(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).cast(docs.schema["n_chars"].dataType))


@_stage
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus: doc_id, lang, source, the redacted text, its ids (little-endian unsigned 32-bit integers, with begin and end), their number, and digests of the ids and of the decoded text.

    A null text is encoded as an empty one; every row stays, repeated ones too.
    """
    out = pieces.encode_decode(docs, queries.tokenizer_path(queries.PIECE_MODEL), keep=("lang", "source", "text"))
    return out.select("doc_id", "lang", "source", "text", "ids", *queries.piece_digests())


STAGES = [
    ("language", language_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal data", personal_stage),
    ("tokens", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; a stage's output goes once the next one's is written, and the last one's stays."""
    docs = queries.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            discard(before)
    return docs
