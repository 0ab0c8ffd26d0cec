import math

import numpy as np
import pytest

from inkwell.llm import kdtree


def clip(s):
    return max(-(1 << 63), min((1 << 63) - 1, s))


def brute(rows, queries, k):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for qi, qv in ok:
        if not queries(qi):
            continue
        found = sorted((-clip(sum(a * b for a, b in zip(qv, v, strict=True))), i) for i, v in ok if i != qi and len(v) == len(qv))[:k]
        out |= {(qi, r + 1, i, -s) for r, (s, i) in enumerate(found)}
    return out


def run(spark, rows, queries, k=5, **kw):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, v int").repartition(3)
    vs = kdtree.integer_vectors(df, "vec_id", "embedding")
    return {tuple(r) for r in kdtree.top_k(vs, vs.filter(queries), k, **kw).collect()}


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 8)]) for i in range(700)]
    rows += [(i, rows[3][1]) for i in range(700, 760)]  # ties
    rows += [(800, None), (801, [1.0, None] * 4), (802, [float("nan")] * 8), (803, [float("inf")] + [0.0] * 7), (850, []), (900, [0.5, 0.25]), (None, rows[0][1])]
    assert run(spark, rows, "vec_id % 50 = 0", shard_rows=100, block_rows=5) == brute(rows, lambda i: i % 50 == 0, 5)


def test_few_candidates_and_large_values(spark):
    rows = [(0, [3e18, -2e18]), (1, [1e17, 4e17]), (50, [1.0, 2.0])]
    got = run(spark, rows, "vec_id % 50 = 0")
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == brute(rows, lambda i: i % 50 == 0, 5)
    assert run(spark, [(0, [1.0])], "vec_id % 50 = 0") == set()


def test_pruning_saves_leaves():
    rng = np.random.default_rng(0)
    vecs = np.floor(256 * rng.normal(0, 1, (4000, 4)))
    tree = kdtree.Tree.load(kdtree.Tree.build(np.arange(4000), vecs).dump())
    best, bound, visits = [[]], [None], [0]
    q = np.floor(256 * rng.normal(0, 1, (1, 4)))
    tree.search(np.array([-1]), q, 5, best, bound, visits)
    scores = vecs @ q[0]
    want = sorted(zip((-scores).tolist(), range(4000), strict=True))[:5]
    assert sorted((-s, -v) for s, v in best[0]) == [(int(s), i) for s, i in want]
    assert visits[0] < (tree.left < 0).sum() / 4


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    vs = kdtree.integer_vectors(df, "vec_id", "embedding")
    assert kdtree.top_k(vs, vs).count() == 0


def test_equal_vectors_are_split(spark):
    df = spark.range(20_000).selectExpr("if(id < 10000, id, 7) as vec_id", "array(1.0D, 2.0D) as v").repartition(4)
    trees = kdtree.build_trees(df, 5, shard_rows=500)
    sizes = [len(kdtree.Tree.load(r.tree).ids) for r in trees.collect()]
    assert sum(sizes) == 10_004 and max(sizes) < 700
    got = kdtree.top_k(df, df.filter("vec_id = 9"), 5, shard_rows=500).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4]
    got = kdtree.top_k(df.filter("vec_id in (7, 8)"), df.filter("vec_id = 8"), 5).collect()
    assert [r.vec_id for r in got] == [7] * 5 and sorted(r.rank for r in got) == [1, 2, 3, 4, 5]
