import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import simhash
from inkwell.llm.components import connected_components


def slow_fingerprint(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    import re

    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def slow_components(nodes, linked):
    label = {n: n for n in nodes}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = top(a), top(b)
                label[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


@settings(max_examples=100, deadline=None)
@given(st.none() | st.text(alphabet="aAbÉé \t\n\x0b\xa0\x1c ", max_size=60))
def test_fingerprint_by_hand(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_long_text():
    text = "Some WORDS and é more words " * 20000
    assert simhash.fingerprint(text) == simhash.fingerprint(text, 3)
    assert simhash.fingerprint("a b c d " * 30000) == slow_fingerprint("a b c d " * 30000)


def flips(rng, base, n, most):
    out = []
    for _ in range(n):
        f = int(base)
        for b in rng.choice(64, rng.integers(0, most + 1), replace=False):
            f ^= 1 << int(b)
        out.append(f)
    return out


@pytest.mark.parametrize("bucket", [2048, 3])
def test_links_connect_what_is_near(spark, bucket):
    """With tiny buckets the second and third level do the work."""
    rng = np.random.default_rng(bucket)
    fps = {0, 1, 7, 15, (1 << 64) - 1}
    for base in rng.integers(0, 1 << 63, 12):
        fps |= set(flips(rng, base, 12, 6))
    fps |= set(flips(rng, int(rng.integers(0, 1 << 63)), 60, 2))
    fps = sorted(fps)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    links = [(r.a, r.b) for r in simhash.near_links(df, 3, bucket).collect()]
    unsigned = lambda f: f % (1 << 64)
    assert all((unsigned(a) ^ unsigned(b)).bit_count() <= 3 for a, b in links)
    got = slow_components(fps, lambda a, b: False)
    pairs = {frozenset((unsigned(a), unsigned(b))) for a, b in links}
    assert slow_components(fps, lambda a, b: frozenset((a, b)) in pairs) == slow_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    assert got


def test_near_duplicates_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", "  ", "one", "one two", "ONE two"]
    for _ in range(8):
        base = rng.choice(words, 200).tolist()
        for _ in range(6):
            t = list(base)
            t[int(rng.integers(0, 200))] = "edit"
            texts.append(" ".join(t))
        texts.append(" ".join(base))
        texts.append(" ".join(base))
    texts += ["long words " * 5000] * 3
    rows = [((i * 7) % 50, t, "x", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, root long").repartition(5)
    got = sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect())
    fps = [slow_fingerprint(t) for _, t, _, _ in rows]
    comp = slow_components(sorted(set(fps)), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (d, *_), f in zip(rows, fps, strict=True):
        least[comp[f]] = min(d, least.get(comp[f], d))
    assert got == sorted((r[0], f, least[comp[f]]) for r, f in zip(rows, fps, strict=True))


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, "zz yy xx ww vv")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {(None, 4), (4, 4), (None, None)}


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, **{i: 200 for i in (200, 201, 202)}}
    assert connected_components(df.limit(0)).count() == 0


def test_buckets_stay_whole_when_a_join_is_split(spark):
    """Parts of a merge join that count as skewed are split among tasks; a bucket's members still meet in one."""
    rng = np.random.default_rng(17)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({f for f in flips(rng, base, 3000, 6)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    split = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "0.1",
    }
    old = {k: spark.conf.get(k, None) for k in split}
    try:
        for k, v in split.items():
            spark.conf.set(k, v)
        links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.near_links(df).collect()]
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    near = lambda a, b: (a ^ b).bit_count() <= 3
    pairs = {frozenset(p) for p in links}
    assert all(near(*p) for p in links)
    assert slow_components(fps, lambda a, b: frozenset((a, b)) in pairs) == slow_components(fps, near)
