import hashlib
from collections import Counter

import numpy as np
import pytest

from inkwell.llm import sampling


def jaccard(a, b, n=5):
    def terms(t):
        w = t.lower().split()
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or Counter([tuple(w)])

    x, y = terms(a), terms(b)
    return sum((x & y).values()) / sum((x | y).values())


def test_collision_rate_is_generalised_jaccard():
    rng = np.random.default_rng(3)
    s = sampling.Sampler(4096)
    words = [f"w{i}" for i in range(200)]
    base = rng.choice(words, 120).tolist()
    a = " ".join(base * 3)
    b = " ".join(base[:80] * 5 + rng.choice(words, 60).tolist())
    c = " ".join(base + rng.choice(words, 30).tolist())
    for x, y in ((a, b), (a, c), (b, c), (a, a)):
        fx, fy = s.fingerprints([x, y])
        assert abs(sampling.likeness(fx, fy) - jaccard(x, y)) < 0.035
    alone = s.fingerprints([c])[0]
    assert (alone == s.fingerprints([a, b, c])[2]).all()  # company does not matter


@pytest.mark.parametrize("group", [1, 60, 1 << 17])
def test_stream_groups(spark, group):
    texts = [None, "", "a", "some five words are here now", "some five words are here now and more", "ä" * 10, "x y z " * 40, "x y z " * 40]
    want = brute([(i, t) for i, t in enumerate(texts)])
    df = spark.createDataFrame([(i, t, 2) for i, t in enumerate(texts)], "doc_id long, text string, pid int").repartition(3)
    got = sorted(sampling.neighbours(df).collect(), key=lambda r: r.doc_id)
    assert [tuple(r) for r in got] == want


def brute(rows):
    s = sampling.Sampler()
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: -r[0])
    out = []
    for i, (d, t) in enumerate(rows):
        n = rows[(i + 1) % len(rows)][1]
        m = len(t) // 3
        e = t[: len(t) - m] + n[:m]
        fp, fe, fn = (s.fingerprints([x])[0] for x in (t, e, n))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.tobytes().hex(), fe.tobytes().hex(), sampling.likeness(fp, fe), sampling.likeness(fp, fn)))
    return sorted(out)


def test_many_rows_and_repeats(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), " ".join(rng.choice(list("abcdefgh"), rng.integers(0, 40)))) for i in rng.permutation(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, sampling.neighbours(df).collect())) == brute(rows)
    twice = spark.createDataFrame([(1, "a b c d e f")] * 2 + [(None, "z")], "doc_id long, text string")
    got = sampling.neighbours(twice).collect()
    assert len(got) == 3 and sorted(r.near_next for r in got if r.doc_id == 1) == [0.0, 1.0]


def test_one_and_none(spark):
    one = spark.createDataFrame([(5, "hello there")], "doc_id long, text string")
    r = sampling.neighbours(one).collect()[0]
    assert r.near_next == 1.0
    assert sampling.neighbours(one.limit(0)).count() == 0
    fp = sampling.fingerprint_documents(one).collect()[0]
    assert fp.fingerprint == r.fingerprint


def test_long_texts_go_by_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    text = " ".join(f"w{i}" for i in rng.integers(0, 3000, 4000))
    whole = sampling.Sampler().fingerprints([text, "a b", text + " end"])
    monkeypatch.setattr(sampling, "TERMS", 100)
    blocks = sampling.Sampler().fingerprints([text, "a b", text + " end"])
    assert all((x == y).all() for x, y in zip(whole, blocks, strict=True))


def test_memory_of_a_very_long_text():
    import tracemalloc

    text = "some words of a very long text that goes on " * 200_000 + " ".join(map(str, range(300_000)))
    s = sampling.Sampler()
    s.fingerprints(["warm up"])
    tracemalloc.start()
    s.fingerprints([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(text)
