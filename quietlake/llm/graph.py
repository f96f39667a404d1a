"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, new_dir

#: Edges that one task joins.
FEW = 200_000


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
    return tuple(r)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the node's smallest neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, go to the smallest of them. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges at hand: labels sink along edges and then along one another until nothing moves."""
    tables = list(batches)
    if not sum(t.num_rows for t in tables):
        return
    a, b = (np.concatenate([t.column(i).to_numpy() for t in tables]) for i in (0, 1))
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, before[a], least)
        np.minimum.at(label, before[b], least)
        label = label[label]
        if np.array_equal(label, before):
            break
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge table with columns a and b; the component is its smallest node.

    Only minima and joins by node are used, which combine before the shuffle; a round's edges are a table
    in the shared folder, so lineage stays short and a lost executor costs one round at most. Loops
    and repeated edges are allowed. The number of rounds grows with the logarithm of the longest chain. Up to ``FEW`` different edges, counted
    first, some three megabytes, are joined by one task instead, which costs one job in place of dozens.
    """
    spark = edges.sparkSession
    ordered = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path, before = new_dir(spark, "edges"), None
    ordered.write.parquet(path)
    now = spark.read.schema(ordered.schema).parquet(path)
    if now.count() <= FEW:
        return now.coalesce(1).mapInArrow(_joined, "node long, component long")
    while (state := _state(now)) != before:
        before, old = state, path
        path = new_dir(spark, "edges")
        _small_star(_large_star(now).distinct()).distinct().write.parquet(path)
        drop_written(spark, old)
        now = spark.read.schema(ordered.schema).parquet(path)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
