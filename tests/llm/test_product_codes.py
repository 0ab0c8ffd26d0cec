import hashlib
import math
import random

import numpy as np
import pytest

from inkwell.llm import product_codes


def brute(rows, parts=16, entries=64, rounds=2):
    kept = []
    for i, v, label in rows:
        if v and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = next((len(v) for _, v, _ in kept if len(v) % parts == 0), None)
    kept = [r for r in kept if len(r[1]) == dim]
    if not kept:
        return []
    w = dim // parts
    books = [[v[p * w : p * w + w] for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            held = {}
            for _, v, _ in kept:
                x = v[p * w : p * w + w]
                held.setdefault(nearest(p, x)[1], []).append(x)
            new.append([[sum(c) // len(held[k]) for c in zip(*held[k], strict=True)] if k in held else e for k, e in enumerate(books[p])])
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, label in kept:
        found = [nearest(p, v[p * w : p * w + w]) for p in range(parts)]
        out.append([i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label])
    return sorted(((i, c, e, sum(x[2] for x in out if x[3] == label), sha) for i, c, e, label in out), key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "c", 1, 2.0) for r in rows], "vec_id long, embedding array<float>, label int, code string, v int, error double").repartition(3)
    return sorted((tuple(r) for r in product_codes.compress(product_codes.whole_vectors(df), **kw).collect()), key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 0.2, 32))], i % 4 if i % 5 else None) for i in range(5, 400)]
    rows += [(i, rows[3][1], 9) for i in range(400, 450)]  # ties and repeats
    rows += [(3, rows[7][1], 1), (3, rows[8][1], 1), (3, rows[8][1], 1), (None, rows[9][1], 2)]
    rows += [(0, None, 1), (1, [], 1), (2, [0.5] * 31 + [None], 1), (4, [float("nan")] * 32, 1), (4, [float("inf")] * 32, 1), (4, [1.0] * 17, 1), (600, [1.0] * 16, 1)]
    random.Random(1).shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_few_rows_and_empty(spark):
    rows = [(i, [float(i * j % 7) for j in range(16)], None) for i in range(5)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0, 2.0], 1)]) == []


def test_components_out_of_range(spark):
    with pytest.raises(Exception, match="as a whole number"):
        run(spark, [(1, [1e30] * 16, 1)])


@pytest.mark.parametrize("scale", [3, 200, 1 << 25])
def test_tree_equals_all_distances(scale):
    """Ties (small scale) and large numbers; pruning leaves most balls out where entries spread."""
    rng = np.random.default_rng(scale)
    entries = rng.integers(-scale, scale, (64, 4))
    entries[40:50] = entries[5]
    parts = np.concatenate((rng.integers(-scale, scale, (500, 4)), entries))
    tree = product_codes.BallTree(entries)
    which, far = tree.nearest(parts)
    d = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (which == d.argmin(1)).all() and (far == d.min(1)).all()
    if scale > 3:
        assert tree.visits < 0.8 * len(tree.nodes) * len(parts)
