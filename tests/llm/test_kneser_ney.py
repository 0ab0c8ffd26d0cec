import math
import random
from collections import Counter, defaultdict

import pytest

from inkwell.llm import kneser_ney as kn


def brute_model(texts):
    """Interpolated modified Kneser-Ney by plain dictionaries."""
    n = kn.ORDER
    c = [None] * (n + 1)
    c[n] = Counter()
    for t in texts:
        for u in kn.units(t):
            s = kn.START * (n - 3) + u + kn.END
            for i in range(n - 1, len(s)):
                c[n][s[i - n + 1 : i + 1]] += 1
    for k in range(n - 1, 0, -1):
        c[k] = Counter(g[1:] for g in c[k + 1])
    p, bow = {}, {}
    for k in range(1, n + 1):
        d = (0, *kn.discounts([sum(v == i for v in c[k].values()) for i in (1, 2, 3, 4)]))
        total, cut = Counter(), defaultdict(float)
        for g, v in c[k].items():
            total[g[:-1]] += v
            cut[g[:-1]] += d[min(v, 3)]
        for h in total:
            bow[h] = max(cut[h] / total[h], 1e-30)
        for g, v in c[k].items():
            low = p[g[1:]] if k > 1 else 1 / (len(c[1]) + 1)
            p[g] = max(v - d[min(v, 3)], 0) / total[g[:-1]] + bow[g[:-1]] * low
    return p, bow, len(c[1]) + 1


def brute_score(model, text):
    p, bow, v = model
    n = kn.ORDER

    def one(g):
        if g in p:
            return p[g]
        return bow[""] / v if len(g) == 1 else bow.get(g[:-1], 1.0) * one(g[1:])

    out = 0.0
    for u in kn.units(text):
        s = kn.START * (n - 3) + u + kn.END
        out += sum(math.log(max(one(s[i - n + 1 : i + 1]), 1e-300)) for i in range(n - 1, len(s)))
    return out


def prose(rng, n):
    return " ".join("".join(rng.choices(["an", "the", "ri", "so", "él", "to"], k=rng.randint(1, 4))) + rng.choice(["", "", ".", ",\n"]) for _ in range(n))


@pytest.mark.parametrize("shard_rows", [10**9, 120])
def test_scores_equal_plain_dictionaries(spark, shard_rows):
    rng = random.Random(1)
    train = [prose(rng, 40) for _ in range(20)]
    test = [*train[:3], prose(rng, 30), "", "QQ!! zz 中文 😀 12", " ", None, "a" * 3000]
    docs = spark.createDataFrame([(t,) for t in train], "text string").repartition(3)
    model = kn.Model(kn.estimate(kn.gram_counts(docs)), shard_rows)
    assert (model.shards > 1) == (shard_rows == 120)
    plain = brute_model(train)
    rows = kn.score(spark.createDataFrame(list(enumerate(test)), "doc_id long, text string"), model).collect()
    for r in rows:
        assert r._kn_logp == pytest.approx(brute_score(plain, test[r.doc_id]) if test[r.doc_id] else 0.0, rel=2e-4, abs=1e-3)
        assert r._kn_n == len(test[r.doc_id] or "") + 1


def test_probabilities_sum_to_one():
    rng = random.Random(2)
    model = brute_model([prose(rng, 50) for _ in range(5)])
    p, bow, v = model
    for h in [g[:-1] for g in list(p)[:40] if len(g) > 1]:
        seen = [g for g in p if len(g) == len(h) + 1 and g[:-1] == h]
        assert sum(p[g] for g in seen) <= 1 + 1e-9


def test_classifier_keeps_prose_and_rejects_junk(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        lang = "aa" if i % 5 else None
        rows.append((i, prose(rng, rng.randint(20, 80)), lang, "s", i))
        if i % 2 == 0:
            labels.append((i, 1, 0))
    junk = {1000: "@@!! %% ##9 " * 30, 1001: "XKCD QWRT ZZZ!! " * 30, 1002: "the " * 300, 1003: "", 1004: None, 1005: " \n "}
    rows += [(i, t, "aa", "s", 0) for i, t in junk.items()]
    labels += [(1000, 0, 0), (2, 0, 0), (None, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, accepted long").repartition(4)
    lb = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = kn.classify(docs, lb, prefix="_kn_").filter("_kn_accepted").select(*docs.columns).collect()
    judged = {r.doc_id: r for r in kn.classify(docs.drop("accepted"), lb).collect()}
    assert {(r.doc_id, r.accepted) for r in kept} == {(i, i if i < 600 else 0) for i, r in judged.items() if r.accepted}
    assert len(judged) == 606
    assert sum(not judged[i].accepted for i in range(600)) <= 3
    assert not any(judged[i].accepted for i in (1000, 1001, 1003, 1004, 1005))
    assert judged[1003].perplexity is None and judged[0].perplexity > 1


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "text", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.accepted for r in kn.classify(docs, none).collect()} == {1: True, 2: False}
    assert kn.classify(docs.limit(0), none).count() == 0


def test_small_languages_have_their_own_limits(spark):
    rng = random.Random(4)
    rows = [(lang, 1000 * (mid + rng.gauss(0, 0.02)), 1000) for lang, mid, n in (("en", -2.0, 400), ("fr", -3.0, 60), ("es", -2.5, 1)) for _ in range(n)]
    rows.append((None, -2000.0, 1000))
    found = {r.lang: r for r in kn.thresholds(spark.createDataFrame(rows, "lang string, _kn_logp double, _kn_n long")).collect()}
    assert set(found) == {"en", "fr", "es", None}
    for lang, mid in (("en", -2.0), ("fr", -3.0), ("es", -2.5)):
        assert found[lang].mid == pytest.approx(mid, abs=0.06)
        assert 0.5 < found[lang].low / found["en"].low < 2
        assert found[lang].low < 0 < found[lang].high


def test_many_languages(spark):
    many = spark.range(10_050).selectExpr("cast(id as string) as lang", "-2000.0D as _kn_logp", "1000L as _kn_n")
    assert kn.thresholds(many).count() == 10_051


def test_one_word_over_and_over_is_rejected(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("aeioubcdfglmnprstv", k=rng.randint(2, 9))) for _ in range(400)]
    text = lambda: " ".join("the" if rng.random() < 0.1 else rng.choice(vocabulary) for _ in range(rng.randint(30, 120)))
    rows = [(i, text(), "en") for i in range(300)] + [(1000, "the " * 300, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(250)], "doc_id long, quality int")
    judged = {r.doc_id: r for r in kn.classify(docs, labels).collect()}
    assert sum(not judged[i].accepted for i in range(300)) <= 3
    assert not judged[1000].accepted
    assert judged[1000].perplexity < min(judged[i].perplexity for i in range(300))
