"""Registered queries take whole texts, not prefixes."""

import random
import time

import pytest

from inkwell.operators import select
from inkwell.operators.select import diverse_beam, is_alike, similarity
from inkwell.plans import queries


def test_what_stands_late_in_a_text_counts(spark, tmp_path):
    late = "x" * 150 + "\n\n" + "word " * 200 + "\n\n# Late\n\nsee https://example.org/a now"
    rows = [(1, late, "en", "web", len(late)), (2, "short text", "en", "web", 10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    kinds = {r.kind: r.n for r in queries.md_blocks(spark, str(tmp_path)).collect()}
    assert kinds["heading"] == 3  # two titles and the late one
    clipped = queries.regions_clipped(spark, str(tmp_path)).filter("doc_id = 1").collect()
    assert max(r.end for r in clipped) > 1000


def test_bounds_decide_likeness_as_the_alignment_does():
    r = random.Random(3)
    for _ in range(3000):
        a = "".join(r.choices("abc", k=r.randint(0, 14)))
        b = a[::-1] if r.random() < 0.2 else a
        for _ in range(r.randint(0, 3)):
            i = r.randint(0, len(b))
            b = b[:i] + "".join(r.choices("abc", k=r.randint(0, 2))) + b[i + r.randint(0, 1) :]
        for least in (0.5, 0.9, 1.0):
            assert is_alike(a, b, least) == (similarity(a, b) >= least), (a, b, least)


def test_beam_reads_what_stands_late(spark):
    same = "ab" * 100
    rows = [(1, 0, same + "x" * 100), (1, 1, same + "y" * 100), (1, 2, same + "x" * 99 + "z"), (1, 3, "q" * 300), (2, 0, ""), (2, 1, "")]
    got = diverse_beam(spark.createDataFrame(rows, "doc_id long, place int, text string"), 3).collect()
    assert sorted((r.doc_id, r.place) for r in got) == [(1, 0), (1, 1), (1, 3), (2, 0), (2, 1)]


def test_blocks_decide_long_texts_as_the_alignment_does():
    r = random.Random(8)
    words = ["the", "cat", "dog ", "aaaa", "abab", "x", "\U0001f3f4"]
    for k in range(120):
        a = "".join(r.choices(words, k=r.randrange(60, 400)))
        b = a if r.random() < 0.8 else "".join(r.choices(words, k=r.randrange(60, 400)))
        for _ in range(r.randint(1, 6)):
            i, n = r.randrange(len(b)), r.randrange(30)
            b = b[:i] + "".join(r.choices(words, k=r.randrange(8))) + b[i + n :]
        same = similarity(a, b)
        for least in (0.1, 0.5, 0.9, 0.95, same, min(1.0, same + 1e-9)):
            assert is_alike(a, b, least) == (same >= least), (k, least, same)


def test_long_texts_are_compared_in_time():
    r = random.Random(9)
    a = "".join(r.choices("etaoin shrdlu", k=120_000))
    b = a[:50_000] + "changed" + a[50_300:90_000] + "again" + a[90_001:]
    began = time.process_time()
    assert is_alike(a, b, 0.92) and not is_alike(a, b[::-1], 0.92)
    assert time.process_time() - began < 8


def test_unlike_texts_are_told_by_their_short_stretches(monkeypatch):
    """A text and its reverse hold the same characters, but no blocks are matched to tell them apart."""
    r = random.Random(4)
    text = " ".join(r.choices("what stands here is a text of some words that are read but one way, not from their ends".split(), k=500))
    monkeypatch.setattr(select, "reaches", lambda *_: pytest.fail("blocks were matched"))
    assert not is_alike(text, text[::-1] + "1", 0.9)


@pytest.mark.parametrize("rows_a_batch", [1, 3, 1000])
def test_beam_of_groups_across_batches(spark, rows_a_batch):
    r = random.Random(rows_a_batch)
    rows = [(d, place, "".join(r.choices("ab", k=r.randint(0, 5))) * r.choice([1, 90])) for d in (None, 1, 2, 3, 4) for place in range(r.randint(1, 12))]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows_a_batch))
    try:
        got = {(x.doc_id, x.place) for x in diverse_beam(spark.createDataFrame(rows, "doc_id long, place int, text string").repartition(3), 3).collect()}
    finally:
        spark.conf.set(key, old)
    want = set()
    for d in {d for d, _, _ in rows}:
        mine = [(p, t) for e, p, t in rows if e == d]
        chosen = []
        for p, t in mine:
            if len(chosen) < 3 and all(similarity(u, t) < 0.9 for _, u in chosen):
                chosen.append((p, t))
        chosen += [x for x in mine if x not in chosen][: 3 - len(chosen)]
        want |= {(d, p) for p, _ in chosen}
    assert got == want
