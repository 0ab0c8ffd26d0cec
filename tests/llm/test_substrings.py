import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import substrings


def brute(rows, window):
    """rows: (doc_id, text); ids None last, one id's texts by hash order given by the caller's list order."""
    seen, out = set(), []
    for d, t in rows:
        words = re.findall("[^\x20\x09-\x0d]+", t or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((d, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=5, max_size=60), st.integers(1, 5), st.integers(0, 5))
def test_equal_windows_have_equal_grams(ws, gram, more):
    window = gram + more
    h = substrings.Hasher(window, gram)
    words = [b"w%d" % w for w in ws]
    if len(words) < window:
        return
    h1, h2 = h.hashes(words)
    low, place = h.smallest_grams(h1)
    w1, w2 = h.windows(h1, h2)
    n = len(words) - window + 1
    assert len(low) == len(w1) == len(w2) == n
    assert all(i <= p <= i + window - gram for i, p in enumerate(place))
    by = {}
    for i in range(n):
        key = tuple(words[i : i + window])
        assert by.setdefault(key, (low[i], w1[i], w2[i], place[i] - i)) == (low[i], w1[i], w2[i], place[i] - i)
    assert len({v[1] for v in by.values()}) == len(by)


@pytest.mark.parametrize(("batches", "fan_out"), [(1, 2), (3, 2), (4, 9)])
def test_against_brute_force(spark, batches, fan_out):
    rng = np.random.default_rng(batches)
    words = [f"w{i}" for i in range(40)] + ["É", "\xa0", "x\x1cy"]
    passages = [rng.choice(words, 15).tolist() for _ in range(4)]
    rows = [(0, None), (1, ""), (2, "a " * 30), (3, " ".join(passages[0])), (4, "\x0b".join(passages[0]))]
    for i in range(5, 60):
        t = rng.choice(words, rng.integers(0, 30)).tolist()
        for _ in range(rng.integers(0, 3)):
            at = rng.integers(0, len(t) + 1)
            t[at:at] = passages[rng.integers(0, 4)]
        rows.append((i, " \t"[i % 2].join(t)))
    rows.append((60, rows[20][1]))
    rows.append((None, rows[30][1]))
    df = spark.createDataFrame([(d, t, 0, 0) for d, t in rows], "doc_id long, text string, th int, h int").repartition(5)
    got = substrings.dedup(df, window=6, gram=3, batches=batches, fan_out=fan_out).drop("o", "th").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows, 6), key=str)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("inkwell_run")]


def test_repeated_rows_are_one_document(spark):
    a, b = " ".join(map(str, range(30))), " ".join(map(str, range(10, 50)))
    df = spark.createDataFrame([(1, a), (1, a), (1, b), (2, a)], "doc_id long, text string")
    got = sorted(map(tuple, substrings.dedup(df, batches=2).select("doc_id", "n_words", "n_removed").collect()))
    first_a = got[:2] == [(1, 30, 0), (1, 30, 0)]
    assert got in ([(1, 30, 0), (1, 30, 0), (1, 40, 20), (2, 30, 30)], [(1, 30, 20), (1, 30, 20), (1, 40, 0), (2, 30, 30)]), (got, first_a)


def test_empty_and_kept_text(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.dedup(df).count() == 0
    df = spark.createDataFrame([(1, " one  two "), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in substrings.dedup(df, keep_text=True).collect()}
    assert got == {1: " one  two ", 2: None}
    many = " ".join(map(str, range(40)))
    df = spark.createDataFrame([(1, many, 9, "a"), (2, f"x\ny {many}\tz", 9, "b"), (3, many, 9, "c"), (4, "", 0, "d")], "doc_id long, text string, n_chars long, rest string")
    got = {r.doc_id: (r.text, r.n_chars, r.rest) for r in substrings.without_repeats(df).collect()}
    assert got == {1: (many, 9, "a"), 2: ("x\ny z", 5, "b"), 4: ("", 0, "d")}


def test_three_sessions_equal_one_batch(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(30)]
    passage = rng.choice(words, 12).tolist()
    rows = [(i, " ".join(rng.choice(words, 8).tolist() + passage * (i % 3 != 1))) for i in range(45)] + [(45, None)]
    rows.append((46, rows[7][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = substrings.dedup(df, window=6, gram=3, batches=1).drop("o", "th").collect()
    index = substrings.WindowIndex(spark, 6, 3, fan_out=2)
    got = []
    for low, high in ((0, 15), (15, 30), (30, 99)):
        part = substrings.keyed(index.spark.createDataFrame([r for r in rows if low <= r[0] < high], "doc_id long, text string"))
        got += index.add(part).drop("o", "th").collect()
        folder = index.save()
        index.detach()
        assert not [t for t in spark.catalog.listTables() if t.name.startswith("inkwell_run")]
        index = substrings.WindowIndex.open(spark.newSession(), folder)
    assert sorted(map(tuple, got)) == sorted(map(tuple, one)) == sorted(brute(rows, 6))
    assert len(index.runs) == 2  # the first two batches' runs are one since the third came
    index.close()


def test_long_words_and_texts():
    h = substrings.Hasher()
    h.ROOM = 64
    words = [b"a" * n for n in (1, 63, 64, 65, 200)] + [bytes([97 + i % 7]) * (i % 90 + 1) for i in range(300)]
    whole = substrings.Hasher()
    assert all((a == b).all() for a, b in zip(h.hashes(words), whole.hashes(words), strict=True))


def test_clashing_columns(spark):
    many = " ".join(map(str, range(40)))
    df = spark.createDataFrame([(1, many, 5, "k"), (2, "x " + many, 6, "l"), (3, many, 7, "m")], "doc_id long, text string, n_removed long, kept string")
    got = {r.doc_id: (r.text, r.n_removed, r.kept) for r in substrings.without_repeats(df).collect()}
    assert got == {1: (many, 5, "k"), 2: ("x", 6, "l")}
