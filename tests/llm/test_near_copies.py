import random

import numpy as np
import pandas as pd
import pytest

from inkwell.llm import near_copies as nc

N = nc.BITS // 64


def slow(text):
    h = nc.WideHasher()
    words = sorted(set((text or "").encode().lower().split()))
    total = np.zeros(nc.BITS)
    for w in words:
        one = h.widen(h.hasher.hashes([w])[0])
        total += 2.0 * np.unpackbits(one.view(np.uint8), bitorder="little") - 1
    return np.packbits(total > 0, bitorder="little").view(np.uint64)


def differing(a, b):
    return np.nonzero(np.unpackbits((a ^ b).view(np.uint8), bitorder="little"))[0]


def met(a, b, distance=nc.DISTANCE, cuts=nc.CUTS):
    """Within the distance and alike but for one bit at most in some segment of some cut."""
    if len(differing(a, b)) > distance:
        return False
    edges = [nc.BITS * i // nc.SEGMENTS for i in range(nc.SEGMENTS + 1)]
    for cut in range(cuts):
        places = differing(*(nc.reordered(x[None], cut)[0] for x in (a, b)))
        if min(((places >= s) & (places < e)).sum() for s, e in zip(edges, edges[1:], strict=False)) <= 1:
            return True
    return False


def brute(fps, distance=nc.DISTANCE):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in np.nonzero(np.bitwise_count(fps[:i] ^ fps[i]).sum(1) <= distance)[0].tolist():
            a, b = label[i], label[j]
            if a != b and met(fps[i], fps[j], distance):
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def texts():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    out = [None, "", "one", "One"]
    for _ in range(12):
        base = rng.choices(words, k=150)
        out.append(" ".join(base))
        for _ in range(4):
            t = list(base)
            for _ in range(2):
                t[rng.randrange(150)] = "edited"
            out.append(" ".join(t))
    out += [" ".join(rng.choices(words, k=120)) for _ in range(30)]
    return out


def test_fingerprints_by_hand():
    some = texts()
    for t, f in zip(some, nc.WideHasher().fingerprints(some), strict=True):
        assert (f == slow(t)).all()


@pytest.mark.parametrize("bucket", [3])
def test_groups_equal_brute_force(spark, bucket):
    some = texts()
    rows = [((i * 37) % 101, t, i) for i, t in enumerate(some)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep int").repartition(3)
    got = {r.doc_id: r.component_id for r in nc.near_copies(df, bucket=bucket).collect()}
    label = brute(np.array([slow(t) for t in some]))
    want = {}
    for (d, *_), x in zip(rows, label, strict=True):
        want[d] = min(r[0] for r, y in zip(rows, label, strict=True) if y == x)
    assert got == want
    # every edited copy is with its original, and nothing else is
    assert len(set(label)) == 2 + 12 + 30


def test_one_of_each(spark):
    rows = [(5, "a b c", 1), (3, "a b c", 2), (3, "other words here", 3), (None, "a b c", 4), (9, "far away text", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, f0 int")
    kept = nc.one_of_each(df).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [3, 9, None] and all(len(r) == 3 for r in kept)
    assert nc.one_of_each(df.limit(0)).count() == 0


def linked(spark, fps, **kw):
    """The number of each fingerprint's component by near_links."""
    rows = [(i, *f) for i, f in enumerate(fps.view(np.int64).tolist())]
    classes = spark.createDataFrame(rows, "rep long, " + ", ".join(f"f{i} long" for i in range(N))).repartition(3)
    label = list(range(len(fps)))
    for r in nc.near_links(classes, **kw).collect():
        a, b = label[r.a], label[r.b]
        if a != b:
            label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def flipped(rng, f, places):
    bits = np.unpackbits(f.view(np.uint8), bitorder="little")
    bits[places] ^= 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


@pytest.mark.parametrize("sizes", [{"bucket": 3}, {"bucket": 3, "hold": 20, "block": 7}])
def test_crowded_keys_lose_nothing(spark, sizes):
    # all share their first segment; pairs, chains and a hot group differ in every other one, so nothing else is shared
    rng = np.random.default_rng(7)
    cuts = [nc.BITS * i // nc.SEGMENTS for i in range(nc.SEGMENTS + 1)]
    same, out = rng.integers(0, 1 << 63, N, dtype=np.uint64), []
    for k in range(40):
        f = flipped(rng, same, np.arange(cuts[1], nc.BITS)[rng.random(nc.BITS - cuts[1]) < 0.5])
        out.append(f)
        for _ in range(k % 4):
            f = flipped(rng, f, np.concatenate([rng.choice(np.arange(s, e), 4, False) for s, e in zip(cuts[1:], cuts[2:], strict=False)]))
            out.append(f)
    out += [flipped(rng, out[0], rng.choice(np.arange(cuts[1], nc.BITS), 9, False)) for _ in range(30)]
    fps = np.array(out)[rng.permutation(len(out))]
    want = brute(fps)
    assert len(set(want)) == 40
    assert linked(spark, fps, **sizes) == want


def test_every_pair_within_the_certain_distance_is_found(spark):
    rng = np.random.default_rng(8)
    fps, pairs = [], []
    for d in range(20, 2 * nc.SEGMENTS):
        for k in range(20):
            f = rng.integers(0, 1 << 63, N, dtype=np.uint64)
            # half of them spread as evenly as can be, so that few segments are nearly alike
            places = rng.choice(nc.BITS, d, False) if k % 2 else (np.arange(d) * nc.BITS // d + rng.integers(0, nc.BITS)) % nc.BITS
            pairs.append((len(fps), len(fps) + 1))
            fps += [f, flipped(rng, f, places)]
    label = linked(spark, np.array(fps))
    assert [(a, b) for a, b in pairs if label[a] != label[b]] == []
    assert label == brute(np.array(fps))


def test_chance_of_missing():
    rng = np.random.default_rng(9)
    zero = np.zeros(N, np.uint64)
    assert all(nc.chance_of_missing(d) == 0 for d in range(2 * nc.SEGMENTS))
    for d in (30, 40, 51):
        for cuts in (1, nc.CUTS):
            missed = np.mean([not met(zero, flipped(rng, zero.copy(), rng.choice(nc.BITS, d, False)), cuts=cuts) for _ in range(2000)])
            assert abs(missed - nc.chance_of_missing(d, cuts)) < 0.035


def test_one_hot_group_is_one_component(spark):
    # edited copies of one text, some twice edited, under a small bucket: all meet through others
    rng, words = random.Random(2), [f"w{i}" for i in range(5000)]
    base = rng.choices(words, k=200)
    rows = []
    for i in range(300):
        t = list(base)
        for _ in range(rng.randint(1, 6)):
            t[rng.randrange(200)] = rng.choice(words)
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, " ".join(rng.choices(words, k=200))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in nc.near_copies(df, bucket=20).collect()}
    assert all(got[i] == 0 for i in range(300)) and all(got[1000 + i] == 1000 + i for i in range(50))


def test_all_links_take_pairs_without_a_shared_variant_too(spark):
    # 2 to 4 differing bits in every segment of the first cut: no variant of it is shared, up to the distance itself
    rng = np.random.default_rng(10)
    cuts = [nc.BITS * i // nc.SEGMENTS for i in range(nc.SEGMENTS + 1)]
    fps, pairs = [], []
    for d in (24, 32, 40, 48, 50, 51, 52, 60):
        for _ in range(5):
            f = rng.integers(0, 1 << 63, N, dtype=np.uint64)
            each = [d // nc.SEGMENTS + (s < d % nc.SEGMENTS) for s in range(nc.SEGMENTS)]
            places = np.concatenate([rng.choice(np.arange(s, e), c, False) for s, e, c in zip(cuts, cuts[1:], each, strict=False)])
            pairs.append((len(fps), len(fps) + 1, d))
            fps += [f, flipped(rng, f, places)]
    fps = np.array(fps)
    assert not any(met(fps[a], fps[b], cuts=1) for a, b, _ in pairs)
    rows = [(i, *f) for i, f in enumerate(fps.view(np.int64).tolist())]
    classes = spark.createDataFrame(rows, "rep long, " + ", ".join(f"f{i} long" for i in range(N)))
    got = {tuple(sorted(r)) for r in nc.all_links(classes, block=16).collect()}
    assert got == {(a, b) for a, b, d in pairs if d <= nc.DISTANCE}
    label = linked(spark, fps)
    assert label == brute(fps) and all(label[a] == label[b] for a, b, d in pairs if d <= 40)


def test_recall_by_distance_on_many_fingerprints(spark):
    """100,000 fingerprints, 2,000 pairs at each of five distances: what is found is what the chance says."""
    rng = np.random.default_rng(12)
    each, distances = 2000, (20, 32, 40, 44, 51)
    base = rng.integers(0, 1 << 63, (90_000, N), dtype=np.uint64)
    made = [flipped(rng, base[i], rng.choice(nc.BITS, distances[i // each], False)) for i in range(each * len(distances))]
    fps = np.concatenate((base, made)).view(np.int64)
    table = {"rep": np.arange(len(fps))} | {f"f{i}": np.ascontiguousarray(fps[:, i]) for i in range(N)}
    links = nc.near_links(spark.createDataFrame(pd.DataFrame(table))).collect()
    found = {tuple(sorted(r)) for r in links if r.a != r.b}
    for k, d in enumerate(distances):
        recall = np.mean([(i, 90_000 + i) in found for i in range(k * each, (k + 1) * each)])
        assert recall >= 0.9 and abs(recall - (1 - nc.chance_of_missing(d, nc.CUTS))) < 0.02, (d, recall)
    assert all(b - a == 90_000 for a, b in found)


def test_links_of_a_hot_group_are_few(spark):
    # its members share most segments; each step hands on forests, and no links within a component
    rng = np.random.default_rng(11)
    f = rng.integers(0, 1 << 63, N, dtype=np.uint64)
    group = np.unique([flipped(rng, f, rng.choice(nc.BITS, 3, False)) for _ in range(600)], axis=0)
    rows = [(i, *r) for i, r in enumerate(group.view(np.int64).tolist())]
    classes = spark.createDataFrame(rows, "rep long, " + ", ".join(f"f{i} long" for i in range(N))).repartition(3)
    links = nc.near_links(classes)
    assert links.count() < 2 * len(group)
    assert {r.a for r in links.collect()} | {r.b for r in links.collect()} == set(range(len(group)))
