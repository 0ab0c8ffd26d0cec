"""Exact top-k inner-product search with KD-trees per shard.

Candidates are dealt by the hash of their id into shards of bounded size. Each
shard becomes one KD-tree (median splits on the widest side, tight bounding
boxes), written once as a row of the shared folder. Queries are taken in blocks
of bounded size, which are broadcast. A block first visits one tree, whose kth
scores go along with it; then every task walks its trees, carrying each query's
kth score from tree to tree. In a tree, nodes are visited best first by the
largest inner product that their box allows; a query stops when the best bound
left is below its kth score, or equal to it with no smaller id in the box. Each
task returns at most k rows a query.

Scores are exact integers: float64 products while all sums stay below 2**53,
else 64-bit or Python integers (held to the range of a long).

Defined results: vectors that are null, empty or hold null, NaN or infinite
components take no part, neither as query nor as candidate; a candidate of
another length than the query's is no candidate of it; rows with the query's id
are its own; repeated rows are candidates each, but ask once; an id with
several vectors asks with each of them; fewer candidates than k are all
returned; ties go to the smaller id; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import discard, materialize

SHARD_ROWS = 4096
BLOCK_ROWS = 4096
LEAF = 48


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, factor: int = 256) -> DataFrame:
    """vec_id and v (array of whole doubles, floor(factor * x)) of the rows whose vector is whole and finite."""
    ok = f"size(`{vec_col}`) > 0 and not exists(`{vec_col}`, x -> x is null or isnan(x) or abs(x) = double('Infinity'))"
    v = F.transform(F.col(vec_col), lambda x: _floor_double(x.cast("double") * F.lit(float(factor))))
    return rows.filter(f"`{vec_col}` is not null and `{id_col}` is not null").filter(ok).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def _floor_double(x):
    """floor as a double, whatever its size (Spark's floor is a long)."""
    down = F.rint(x)
    return F.when(down > x, down - 1).otherwise(down)


class Tree:
    """A KD-tree over integer vectors; arrays only, so it is stored as bytes."""

    def __init__(self, ids, vecs, lo, hi, first, last, left, right, least) -> None:
        self.ids, self.vecs, self.lo, self.hi = ids, vecs, lo, hi
        self.first, self.last, self.left, self.right, self.least = first, last, left, right, least

    @classmethod
    def build(cls, ids: np.ndarray, vecs: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.arange(len(ids))
        first, last, left, right = [0], [len(ids)], [-1], [-1]
        todo = [0]
        while todo:
            node = todo.pop()
            a, b = first[node], last[node]
            part = vecs[order[a:b]]
            spread = part.max(0) - part.min(0)
            axis = int(spread.argmax())
            if b - a <= leaf or not spread[axis]:
                continue
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, axis], mid)]
            for x, y, side in ((a, a + mid, left), (a + mid, b, right)):
                side[node] = len(first)
                first.append(x)
                last.append(y)
                left.append(-1)
                right.append(-1)
                todo.append(side[node])
        ids, vecs = ids[order], vecs[order]
        spans = list(zip(first, last, strict=True))
        lo = np.array([vecs[a:b].min(0) for a, b in spans])
        hi = np.array([vecs[a:b].max(0) for a, b in spans])
        least = np.array([ids[a:b].min() for a, b in spans])
        return cls(ids, vecs, lo, hi, np.array(first), np.array(last), np.array(left), np.array(right), least)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **vars(self))
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Tree:
        with np.load(io.BytesIO(raw)) as z:
            return cls(**{k: z[k] for k in ("ids", "vecs", "lo", "hi", "first", "last", "left", "right", "least")})

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, best: list[list[tuple]], bound: list[tuple], visits: list[int] | None = None) -> None:
        """Improve best (per query a heap of (score, -id), at most k) and bound (a (score, id) that k candidates reach)."""
        largest = float(np.abs(self.vecs).max()) * float(np.abs(queries).max()) * self.vecs.shape[1]
        if largest < 2.0**53:
            vecs, qs, lo, hi = self.vecs, queries, self.lo, self.hi
        else:
            kind = np.int64 if largest < 2.0**62 else object
            whole = lambda a: np.array([[int(x) for x in r] for r in a], kind)
            vecs, qs, lo, hi = map(whole, (self.vecs, queries, self.lo, self.hi))
        above = np.maximum(qs, 0) @ hi.T + np.minimum(qs, 0) @ lo.T
        first, last, left, right, least = (a.tolist() for a in (self.first, self.last, self.left, self.right, self.least))
        for i in range(len(qs)):
            own, q, row, held = int(query_ids[i]), qs[i], above[i].tolist(), best[i]
            worst = bound[i]  # (score, id) of the kth best known
            todo = [(-row[0], least[0], 0)]
            while todo:
                neg, low, node = heapq.heappop(todo)
                if worst is not None and (-neg < worst[0] or (-neg == worst[0] and low > worst[1])):
                    break
                if left[node] >= 0:
                    for child in (left[node], right[node]):
                        c = row[child]
                        if worst is None or c > worst[0] or (c == worst[0] and least[child] <= worst[1]):
                            heapq.heappush(todo, (-c, least[child], child))
                    continue
                if visits is not None:
                    visits[0] += 1
                a, b = first[node], last[node]
                scores = vecs[a:b] @ q
                picks = range(b - a) if worst is None else np.nonzero(scores >= worst[0])[0].tolist()
                for j in picks:
                    vid = int(self.ids[a + j])
                    if vid == own:
                        continue
                    item = (int(scores[j]), -vid)
                    if len(held) < k:
                        heapq.heappush(held, item)
                    elif item > held[0]:
                        heapq.heapreplace(held, item)
                    if len(held) == k and (worst is None or held[0] > (worst[0], -worst[1])):
                        worst = (held[0][0], -held[0][1])
            bound[i] = worst


def build_trees(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """shard, dim, tree: one row per shard. vectors: vec_id, v.

    Rows alike in id and vector tie with each other, so k of them are as good as
    all: they are counted map-side, k at most go on, each dealt by its own number.
    """
    same = materialize(vectors.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n")).select("vec_id", "v", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("copy")), "vectors")
    shards = max(1, math.ceil(same.count() / shard_rows))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        ids = t.column("vec_id").to_numpy()
        v = t.column("v").combine_chunks()
        vecs = np.asarray(v.flatten()).reshape(len(ids), -1)
        return pa.table({"shard": [key[0].as_py()], "dim": [key[1].as_py()], "tree": [Tree.build(ids, vecs).dump()]}, schema=pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("tree", pa.binary())]))

    dealt = same.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v", "copy"), F.lit(shards))).withColumn("dim", F.size("v"))
    out = materialize(dealt.groupBy("shard", "dim").applyInArrow(run, "shard bigint, dim int, tree binary"), "trees")
    discard(same)
    return out


def _walk(block, number: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs, bound = block.value
        best: dict[int, list] = {}
        bounds: dict[int, list] = {}
        for batch in batches:
            for dim, raw in zip(batch.column("dim").to_pylist(), batch.column("tree"), strict=True):
                if dim not in vecs:
                    continue
                if dim not in best:
                    best[dim] = [[] for _ in ids[dim]]
                    bounds[dim] = list(bound[dim])
                Tree.load(raw.as_py()).search(ids[dim], vecs[dim], k, best[dim], bounds[dim])
        for dim, held in best.items():
            rows = [(int(q), number << 40 | dim << 20 | i, -v, _long(s)) for i, (q, h) in enumerate(zip(ids[dim], held, strict=True)) for s, v in h]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["query_id", "query_row", "vec_id", "score"])

    return run


def _long(score: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, score))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates by integer inner product.

    vectors, queries: vec_id, v as integer_vectors gives them.
    """
    spark = vectors.sparkSession
    trees = build_trees(vectors, k, shard_rows)
    schema = "query_id bigint, query_row bigint, vec_id bigint, score bigint"
    many = queries.count()
    blocks = max(1, math.ceil(many / block_rows))
    asked = materialize(queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))), "queries") if blocks > 1 else queries.withColumn("block", F.lit(0))
    out = None
    for b in range(blocks):
        rows = asked.filter(F.col("block") == b).select("vec_id", "v").distinct().toArrow()
        ids, vecs, bound = {}, {}, {}
        every_id = rows.column("vec_id").to_numpy()
        lengths = rows.column("v").combine_chunks()
        sizes = np.array(lengths.value_lengths().to_pylist(), np.int64)
        for dim in np.unique(sizes).tolist():
            at = np.nonzero(sizes == dim)[0]
            ids[dim] = every_id[at]
            vecs[dim] = np.array([lengths[i].as_py() for i in at.tolist()], np.float64)
            bound[dim] = [None] * len(at)
        if not ids:
            continue
        block = spark.sparkContext.broadcast((ids, vecs, bound))
        seed = trees.filter("shard = 0").mapInArrow(_walk(block, b, k), schema)
        kth: dict[int, list] = {}
        for r in seed.collect():  # k rows at most for each query of the block and task
            kth.setdefault(r.query_row, []).append((-r.score, r.vec_id))
        for dim, own in ids.items():
            for i in range(len(own)):
                found = sorted(kth.get(b << 40 | dim << 20 | i, ()))
                if len(found) >= k:
                    bound[dim][i] = (-found[k - 1][0], found[k - 1][1])
        second = spark.sparkContext.broadcast((ids, vecs, bound))
        part = materialize(trees.mapInArrow(_walk(second, b, k), schema), "best")
        for used in (block, second):
            used.destroy()
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    w = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
