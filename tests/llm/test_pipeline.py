import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import tokenizers

import corpus_pipeline
from inkwell.llm import kneser_ney
from tests.llm.test_kneser_ney import brute_model, brute_score
from tests.llm.test_near_copies import brute as brute_groups
from tests.llm.test_near_copies import slow as fingerprint
from tests.llm.test_substrings import brute as brute_windows


def test_stages_in_order(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "substring dedup", "best-fit packing"]
    from inkwell.llm.common import materialize

    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, sf), "stage")
        if k < 3:
            assert docs.columns == columns
            now = {r.doc_id for r in docs.select("doc_id").collect()}
            assert now <= ids
            ids = now
    assert {r.doc_id for r in docs.select("doc_id").collect()} == ids
    assert docs.groupBy("sequence_id").sum("length").filter("`sum(length)` > 4096").count() == 0
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, f0 int, accepted boolean, perplexity double"


def prose(rng, n):
    return " ".join("".join(rng.choices(["an", "the", "ri", "so", "él", "to"], k=rng.randint(1, 4))) + rng.choice(["", "", ".", ",\n"]) for _ in range(n))


def corpus():
    """Prose with copies, edited copies and shared passages, junk, nulls, empties, repeats; columns that clash with those of the stages."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(60, 140)) for _ in range(60)]
    passage = prose(rng, 45)
    for i in range(0, 20, 4):
        texts[i] += " " + passage + " " + prose(rng, 5)
    edited = texts[31].split(" ")
    edited[7] = edited[40] = "riél"
    texts += [texts[30], texts[30], " ".join(edited), "zq9#!x " * 80, "QXWZ " * 60, "", "  ", None, passage, prose(rng, 12_000)]
    rows = [(i, t, "fr" if i % 3 else "en", "web", len(t or ""), "clash", 1, False, 0.5) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[8], "en", None, 1, None, None, None, None), (None, None, None, None, None, None, None, None, None), (3, texts[9], "en", "other", 7, None, None, None, None)]
    labels = [(i, 1, 0) for i in range(50)] + [(63, 0, 1), (64, 0, 0), (2, 0, 0), (4, None, None), (None, 1, 0), (999, 1, 0)]
    return rows, labels


def quantile(values, p):
    return sorted(values)[max(0, math.ceil(p * len(values)) - 1)]


def slow_quality(rows, labels, held):
    said = {}
    for i, q, _ in labels:
        said.setdefault(i, []).append(q)
    trusted = [r for r in rows if r[0] in said and 1 in said[r[0]] and all(q == 1 or q is None for q in said[r[0]])]
    model = brute_model([r[1] for r in trusted if r[1] and r[0] not in held])
    scores = {t: brute_score(model, t) if t else 0.0 for t in {r[1] for r in rows}}
    rate = lambda t: scores[t] / (len(t or "") + 1)
    z = lambda t, mid: (rate(t) - mid) * math.sqrt((n := len(t or "") + 1) / (1 + n / (kneser_ney.LENGTH_SCALE * 6)))
    judged = [r for r in trusted if r[0] in held and r[1] and r[1].strip()]
    mids = {lang: quantile([rate(r[1]) for r in judged if r[2] == lang], 0.5) for lang in {r[2] for r in judged}}
    around = [(r[2], z(r[1], mids[r[2]])) for r in judged]
    tails = lambda v: (quantile(v, 0.01), quantile(v, 0.99))
    pooled, whole = tails([x for _, x in around]), quantile([rate(r[1]) for r in judged], 0.5)
    limits = {None: (whole, *tails([z(r[1], whole) for r in judged]))}
    for lang, mid in mids.items():
        own = [x for k, x in around if k == lang]
        share = min(1.0, len(own) / kneser_ney.MIN_DOCUMENTS)
        limits[lang] = (mid, *(share * a + (1 - share) * b for a, b in zip(tails(own), pooled, strict=True)))
    out = []
    for r in rows:
        mid, low, high = limits.get(r[2], limits[None])
        if r[1] and r[1].strip() and low * kneser_ney.MARGIN[0] <= z(r[1], mid) <= high * kneser_ney.MARGIN[1]:
            out.append(r)
    return out


def slow_near_dedup(rows):
    own = [r for r in rows if r[0] is not None]
    label = brute_groups(np.array([fingerprint(r[1]) for r in own]))
    least = {}
    for r, x in zip(own, label, strict=True):
        least[x] = min(least.get(x, r[0]), r[0])
    groups = {}
    for r, x in zip(own, label, strict=True):  # rows of one id are one document
        groups[r[0]] = min(groups.get(r[0], least[x]), least[x])
    return sorted(i for i, root in groups.items() if i == root), sum(r[0] is None for r in rows)


def test_stages_against_slow_versions(spark, tmp_path):
    from inkwell.llm.common import materialize

    rows, labels = corpus()
    sf = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = {r[0] for r in spark.range(100).filter(f"pmod(xxhash64(id), {kneser_ney.FOLDS}) = 0").collect()}
    stages = [f for _, f in corpus_pipeline.STAGES]
    key = lambda r: tuple(str(x) for x in r)

    one = materialize(stages[0](spark, docs, sf), "one")
    got = [tuple(r) for r in one.collect()]
    assert one.columns == docs.columns and sorted(got, key=key) == sorted(slow_quality(rows, labels, held), key=key)
    assert len(got) < len(rows) and not any("QXWZ" in r[1] for r in got)

    two = materialize(stages[1](spark, one, sf), "two")
    kept = [tuple(r) for r in two.collect()]
    ids, nulls = slow_near_dedup(got)
    assert two.columns == docs.columns and sorted(r[0] for r in kept if r[0] is not None) == ids and sum(r[0] is None for r in kept) == nulls
    assert {r for r in kept} <= set(got)

    three = materialize(stages[2](spark, two, sf), "three")
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))
    want = {d: (n - gone, sha) for d, n, gone, sha in brute_windows([(r[0], r[1]) for r in order], 20) if n == 0 or gone < n}
    left = {r.doc_id: r for r in three.collect()}
    assert three.columns == docs.columns and set(left) == set(want)
    for d, (n, sha) in want.items():
        words = WORD.findall(left[d].text or "")
        assert len(words) == n and hashlib.sha256(" ".join(words).encode()).hexdigest() == sha
    assert sum(len(WORD.findall(r[1])) for r in kept) > sum(n for n, _ in want.values())

    pieces = stages[3](spark, three, sf).collect()
    model = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {d: len(model.encode(r.text or "", add_special_tokens=False).ids) + 1 for d, r in left.items()}
    bins, of = {}, {}
    for p in pieces:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
        of.setdefault(p.doc_id, []).append((p.start, p.length))
    assert {d: sum(n for _, n in sorted(v)) for d, v in of.items()} == lengths and max(lengths.values()) > 4096
    for placed in bins.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(bins) == math.ceil(sum(lengths.values()) / 4096)
    assert sorted(map(key, corpus_pipeline.run(spark, sf).drop("sequence_id", "offset").collect())) == sorted(key(tuple(getattr(p, c) for c in p.__fields__ if c not in ("sequence_id", "offset"))) for p in pieces)


def test_an_empty_table_goes_through(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
