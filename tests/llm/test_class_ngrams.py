import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import class_ngrams as cn

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def plain(rows):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score of every row."""
    texts = [(i, zlib.crc32(str(i).encode()) % 10 == 0 if i is not None else True, WORD.findall(lower(t)) + [0]) for i, t in rows]
    counts = Counter(w for _, held, words in texts if not held for w in words)
    n, v = sum(counts.values()), len(counts)
    low = math.log10(n + 0.1 * (v + 1))
    return [(i, held, len(words), sum(w in counts for w in words), n, sum(math.log10(counts[w] + 0.1) - low for w in words)) for i, held, words in texts]


def text(rng, n):
    """Words of two kinds that take turns, with names of their own now and then."""
    out = []
    for k in range(n):
        out.append(rng.choice(["the", "a", "One", "some"]) if k % 2 == 0 else rng.choice(["dog", "cat", "fish", f"Name{rng.randrange(300)}ing", "Ünïx"]))
    return rng.choice([" ", "\n", " \t "]).join(out)


def documents():
    rng = random.Random(5)
    rows = [(i, text(rng, rng.randrange(1, 60))) for i in range(300)]
    return rows + [(300, None), (301, ""), (302, " \n\t"), (303, "x" * 4000 + " the dog"), (304, "the dog " * 5000), (7, "the cat"), (7, "the cat"), (None, "a fish"), (305, "a\x0bb\x1cc d é")]


def run(spark, rows, parts=3, **kw):
    df = spark.createDataFrame([(i, t, True, 1, "w") for i, t in rows], "doc_id long, text string, train boolean, n long, row string").repartition(parts)
    return cn.score(df, cn.every_tenth_held(), **kw).collect()


def test_counts_and_base_against_plain_version(spark):
    got = run(spark, documents(), classes=8)
    want = plain(documents())
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g)[:5] == w[:5] and math.isclose(g.base_score, w[5], rel_tol=1e-9, abs_tol=1e-9) and math.isfinite(g.score) and g.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_same_scores_however_rows_are_dealt(spark):
    one, two = ({(r.doc_id, r.n_tokens): r.score for r in run(spark, documents(), parts=p, classes=8)} for p in (1, 7))
    assert one.keys() == two.keys() and all(math.isclose(one[k], two[k], rel_tol=1e-9) for k in one)


def test_small_pieces_and_few_units_give_the_same_counts(spark, monkeypatch):
    """Rare words by the table, merges of buckets and pieces of texts."""
    for name, value in (("PIECE", 300), ("CHUNK", 100), ("HELD", 20), ("BUCKET_TOKENS", 400), ("GROUP_TOKENS", 150)):
        monkeypatch.setattr(cn, name, value)
    rows = documents()[:120]
    got = {r.doc_id: r for r in run(spark, rows, classes=4, share=60)}
    for w in plain(rows):
        g = got[w[0]]
        assert tuple(g)[:5] == w[:5] and math.isclose(g.base_score, w[5], rel_tol=1e-9, abs_tol=1e-9)


def test_nothing_to_learn_from_and_empty_table(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    got = run(spark, [(i, "a b") for i in held])
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(True, 3, 0, 0, 0.0, 0.0)] * 3
    assert run(spark, []) == []
    assert len(run(spark, [(1, None)])) == 1


def test_gain_is_the_likelihoods_difference():
    rng = np.random.default_rng(3)
    units, k = 30, 6
    pairs = rng.integers(0, 4, (units, units)) * rng.integers(0, 2, (units, units))
    of = rng.integers(0, k - 1, units)
    of[0] = k - 1

    def bigrams(of):
        n = np.zeros((k, k))
        np.add.at(n, (of[:, None].repeat(units, 1), of[None].repeat(units, 0)), pairs)
        return n

    n = bigrams(of)
    for u in range(1, units):
        follow, lead = np.bincount(of, pairs[u], k), np.bincount(of, pairs[:, u], k)
        best, gain = cn.best_class(int(of[u]), follow, lead, float(pairs[u, u]), n, n.sum(1), n.sum(0))
        each = []
        for c in range(k - 1):
            moved = of.copy()
            moved[u] = c
            each.append(cn.likelihood(bigrams(moved)) - cn.likelihood(n))
        assert math.isclose(gain, max(each), abs_tol=1e-6) and math.isclose(each[best], max(each), abs_tol=1e-6)
    assert (n == bigrams(of)).all()


def test_likelihood_never_falls_and_kinds_part(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, 80)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("train", F.lit(True))
    words = cn.word_counts(df)
    tokens = words.agg(F.sum("c")).first()[0] + 400
    units, _ = cn.choose_units(words, tokens, 400)
    encoded = cn.encode(df, units).cache()
    of, said = cn.cluster(cn.unit_neighbours(encoded, len(units), tokens), units, classes=4)
    assert said == sorted(said) and len(said) > 2
    hashes = {w: _hash(w) for w in ("the", "a", "one", "some", "dog", "cat", "fish")}
    kind = {w: of[1 + int(np.searchsorted(units.words, h))] for w, h in hashes.items()}
    assert not {kind[w] for w in ("the", "a", "one", "some")} & {kind[w] for w in ("dog", "cat", "fish")}


def _hash(word):
    h = cn.Hasher()
    raw = np.frombuffer(word.encode(), np.uint8)
    return h.word_hash(raw, *h.places(raw), 0).view(np.int64)[0]


@pytest.mark.parametrize("classes", [3, 9])
def test_probabilities_of_each_context_sum_to_one(classes):
    rng = np.random.default_rng(classes)
    k, words, forms = classes + 1, 40, 5
    counts = np.concatenate(([50], rng.integers(5, 90, words), rng.integers(5, 60, forms), np.zeros(256, np.int64)))
    types = np.concatenate(([1], np.ones(words, np.int64), rng.integers(2, 5, forms), np.zeros(256, np.int64)))
    units = cn.Units(np.arange(words), np.arange(forms), counts, types)
    of = rng.integers(0, classes, len(units)).astype(np.int16)
    of[1 : k] = np.arange(classes)
    of[0] = classes
    stream = rng.permutation(np.repeat(np.arange(len(units)), counts))
    stream = np.concatenate((stream[stream != 0], [0]))  # classes' counts are those of the words
    counts[0] = 1
    tri = np.bincount(cn._steps(of, stream, k), minlength=k**3).reshape(k, k, k).astype(float)
    d = 0.6
    m = cn.build_model(units, of, tri, d)
    step = 10.0 ** m.step.reshape(k, k, k)
    assert np.allclose(step.sum(2), 1, atol=1e-5)
    mass = np.zeros(k)
    np.add.at(mass, m.of[: 1 + words], 10.0 ** m.emit[: 1 + words])
    for f in range(forms):  # a form's own words, by their counts, and the unknown ones of its class
        at = 1 + words + f
        mass[m.of[at]] += (counts[at] - d * types[at]) * 10.0 ** m.emit[at]
    for c in set(m.of[1 + words :].tolist()):
        mass[c] += 10.0 ** (m.unknown[c] + m.emit[1 + words + int(np.nonzero(m.of[1 + words :] == c)[0][0])])
    assert np.allclose(mass, 1, atol=1e-6)
