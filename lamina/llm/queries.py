"""One query for each training-data operator, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File names in the folder of public tokenizers; the folder is found through its package.
PIECE_MODEL, BYTE_RANKS, BYTE_SEPARATOR = "piece_bpe_32k.model", "byte_bpe_50k.tiktoken", 50256


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from lamina.llm.common import lean_batches

    lean_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.decontaminate import find_items

    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.personal import KINDS, find_personal, of_kind, spelled

    found = find_personal(table(spark, sf_dir, "documents"))
    counts = [of_kind("base", k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(spelled("base").cast("binary"), 256).alias("base_sha256"), spelled("spans").alias("spans"))


def piece_digests() -> list[Column]:
    """n_tokens, ids_sha256 and decoded_sha256 of encode_decode()'s columns."""
    n = F.floor(F.octet_length("ids") / 4).cast("long")
    return [n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")]


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.pieces import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL)).select("doc_id", *piece_digests())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.ordinal import fit, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    # graded rating: 0 toxic, 1 poor, 2 good
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    model = fit(docs, labels.select("doc_id", grade.alias("grade")))
    return score(docs, model).withColumn("keep", F.col("p_top") >= 0.5)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.topk import quantised, top_products

    return top_products(quantised(table(spark, sf_dir, "embeddings")), F.col("id") % 20 == 0, 20)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.substrings import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.jaccard import link_components

    return link_components(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.language import held_out, predict, train, vocabulary

    docs = table(spark, sf_dir, "documents")
    pieces = vocabulary(tokenizer_path(PIECE_MODEL))
    langs, p = train(docs.where(~held_out()), pieces)
    return predict(docs, pieces, langs, p).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lamina.llm.common import written
    from lamina.llm.tokenscan import named_counts, token_blocks

    docs = table(spark, sf_dir, "documents")
    blocks = token_blocks(docs, tokenizer_path(BYTE_RANKS), public_tokenizers.PATTERN, BYTE_SEPARATOR)
    return named_counts(written(blocks, "tokens"), BYTE_SEPARATOR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_personal": op2_personal,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_quality": op4_quality,
        "op5_topk": op5_topk,
        "op6_substrings": op6_substrings,
        "op7_licenses": op7_licenses,
        "op8_jaccard": op8_jaccard,
        "op9_language": op9_language,
        "op10_token_counts": op10_token_counts,
    }


OP5_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), e AS (
  SELECT vec_id, len(e) AS dim, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS x FROM v
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM e q JOIN e c ON q.i = c.i AND q.dim = c.dim AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
  GROUP BY ALL
  UNION ALL
  SELECT q.vec_id, c.vec_id, 0 FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 AND len(q.e) = 0 AND len(c.e) = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(words[i + 1 : i + 4], ' ')) AS s
  FROM w, unnest(range(0, CASE WHEN len(words) >= 4 THEN len(words) - 3 WHEN len(words) > 0 THEN 1 ELSE 0 END)) AS r(i)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), c AS (
  SELECT doc_id, doc_id AS root FROM n
  UNION
  SELECT l.b, c.root FROM c JOIN l ON l.a = c.doc_id WHERE c.root < l.b
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(root) AS root FROM c GROUP BY doc_id) m USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    from lamina.llm.licenses import oracle

    return {"op5_topk": OP5_SQL, "op7_licenses": oracle(), "op8_jaccard": OP8_SQL}
