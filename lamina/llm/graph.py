"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lamina.llm.common import discard, lean, written


#: Edges (16 bytes each) that one task joins by itself; more go through rounds until so few are left or nothing changes. The labels are the same.
ONE_TASK = 100_000


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node reachable. No group is ever collected.

    Null ends and loops are left out, repeated edges count once. Each round is written to the shared folder, so a lost
    executor costs one round at most; the number of rounds grows with the logarithm of the longest path.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    edges, mark = _round(edges)
    for _ in range(most_rounds):
        if mark[0] <= ONE_TASK:
            return _joined(edges)
        # large star: every larger neighbour of a node moves to the node's smallest neighbour (itself included)
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select("u", "v", "m")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v")))
        before, was = edges, mark
        edges, mark = _round(small.where("u <> v").distinct())
        discard(before)
        if mark == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _joined(edges: DataFrame) -> DataFrame:
    """Labels of at most ONE_TASK edges by union and find in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                u, v = find(u), find(v)
                root[max(u, v)] = min(u, v)  # the root is the smallest of its group
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], ["node", "label"])

    kind = to_arrow_type(edges.schema["u"].dataType)
    name = edges.schema["u"].dataType.simpleString()
    return edges.select("u", "v").coalesce(1).mapInArrow(lean(run), f"node {name}, label {name}")


def _round(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The written edges, and their number with order-free sums of two hashes: equal for equal sets."""
    edges = written(edges, "edges")
    part = lambda seed: F.sum(F.xxhash64("u", "v", F.lit(seed)).cast("decimal(20,0)"))
    return edges, tuple(edges.agg(F.count("*"), part(1), part(2)).first())
