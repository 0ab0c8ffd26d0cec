"""Connected components by alternating large-star and small-star steps over an edge table.

Each step is an aggregate and an equality join, so no task or driver ever holds
a component. Every round is written to the shared folder, which cuts lineage;
the number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import discard, lean, materialize

#: Edges that one task joins to parts in memory (16 bytes each).
EDGES = 1 << 18


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return r["n"], r["x"] or 0


def forest(ends: np.ndarray) -> np.ndarray:
    """Edges (two rows of ends) that join each node to the smallest one of its part: fewer edges, same components."""
    nodes, inverse = np.unique(ends, return_inverse=True)
    x, y = inverse.reshape(ends.shape)
    label = np.arange(len(nodes))
    while True:  # smallest label over edges, then pointer jumping
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if np.array_equal(before, label):
            break
    far = label != np.arange(len(nodes))
    return np.stack((nodes[far], nodes[label[far]]))


def edge_batch(ends: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1])], ["a", "b"])


@lean
def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace up to EDGES edges by their forest."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.stack((batch.column(0).to_numpy(), batch.column(1).to_numpy())))
        if sum(x.shape[1] for x in held) >= EDGES:
            yield edge_batch(forest(np.concatenate(held, axis=1)))
            held.clear()
    if held:
        yield edge_batch(forest(np.concatenate(held, axis=1)))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) for every node that has an edge.

    edges: two long columns a, b. Null ends, loops and repeated edges are dropped.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a is not null and b is not null and a <> b")
    links = materialize(e, "links")
    parts = max(1, math.ceil(links.count() / EDGES))  # so that a task's links are many of the same nodes
    e = materialize(links.coalesce(parts).mapInArrow(_local_forest, "a bigint, b bigint").distinct(), "edges")
    discard(links)
    mark = _mark(e)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = materialize(low, "least")  # read back, so that the join may split a node of very many edges
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = materialize(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(low)
        discard(e)
        e, old, mark = new, mark, _mark(new)
        if old == mark:
            break
    else:
        raise RuntimeError("the components did not settle")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
