"""Inspection and sanitation in one pass over each row, against plain versions."""

import random
import re
import time
import unicodedata

from pyspark.sql import functions as F

from inkwell.functions import ucd
from inkwell.operators import inspect, operations, sanitize

MARKS = ["a", "b", " ", "\n", "é", "e", "́", "̧", "​", " ", "\U000e0067", "\U000f0000", "\U0001f3f4", "½", "ﬁ", "\x07", " ", "क"]


def _texts(n: int, most: int) -> list[str]:
    draw = random.Random(7)
    return ["", "́a"] + ["".join(draw.choices(MARKS, k=draw.randrange(most))) for _ in range(n)]


def _all_clusters(text, form, held, edits):
    """Every cluster of the text, one by one."""
    out, at = [], 0
    while at < len(text):
        end = at + 1
        while end < len(text) and unicodedata.combining(text[end]):
            end += 1
        mine = [e for e in edits if at <= e[0] < end]
        if any(a < end and at < b for a, b in held) or unicodedata.is_normalized(form, text[at:end]):
            out += mine
        else:
            new = text[at:end]
            for a, b, t in reversed(mine):
                new = new[: a - at] + t + new[b - at :]
            new = unicodedata.normalize(form, new)
            if new != text[at:end]:
                out.append((at, end, new))
        at = end
    return out


def test_clusters_of_runs_are_all_clusters():
    draw = random.Random(3)
    for text in _texts(300, 60):
        edits = [(i, i + 1, "") for i, c in enumerate(text) if c in "​\x07"]
        held = [(a, a + draw.randrange(1, 9)) for a in range(0, len(text), 11) if draw.random() < 0.4]
        held += [(a + 1, a + 2) for a, _ in held]
        mine = [e for e in edits if not any(a < e[1] and e[0] < b for a, b in held)]
        for form in ("NFC", "NFKC"):
            assert sanitize.clusters(text, form, held, mine) == _all_clusters(text, form, held, mine)


def test_carriers_have_the_offsets_of_code_points(spark):
    one = re.compile(f"[{re.sub(r'x.([0-9A-F]+).', lambda m: 'U' + m[1].zfill(8), ucd.notable_class())}]")
    texts = _texts(20, 3000) + [" " * 1500, "x" * 511 + "​" * 3 + "\U000e0067" * 700, "x" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", inspect.carriers(F.col("text")).alias("c")).collect()
    assert {r.doc_id: [(x.offset, x.char) for x in r.c] for r in rows} == {i: [(m.start(), m[0]) for m in one.finditer(t)] for i, t in enumerate(texts)}


def test_rows_alone_equal_rows_joined(spark):
    """No spans at all and an empty table of spans give the same result; nulls and repeated rows stay."""
    docs = spark.createDataFrame(list(enumerate(_texts(40, 400))) + [(999, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, start int, end int")
    for name in ("report", "safe", "aggressive"):
        policy = inspect.UnicodePolicy(name=name, normalization_form="NFKC")
        alone, joined = (sorted(map(tuple, sanitize.sanitize(docs, policy, h).select("doc_id", "ops", "clean").collect())) for h in (None, none))
        assert alone == joined
    twice = sanitize.sanitize(docs.unionByName(docs)).collect()
    assert len(twice) == 2 * docs.count() and all(r.clean == "" for r in twice if r.doc_id == 999)


def test_apply_joins_parts(spark):
    row = spark.createDataFrame([("abcdef", [(0, 0, "x"), (1, 2, ""), (2, 4, "yz"), (6, 6, "!")])], f"text string, ops array<{operations.OP}>")
    assert row.select(operations.apply("text", "ops")).first()[0] == "xayzef!"


def test_contexts_are_those_of_the_whole_text(spark):
    """Neighbours across blocks, flags and runs of tags at their edges."""
    flag, tag = "\U0001f3f4", "\U000e0067"
    texts = _texts(15, 2500) + ["x" * 500 + flag + tag * 600 + "y" + tag * 3, "x" * 511 + flag + tag, tag * 5 + flag + "​" + tag, flag * 3 + tag + flag, "q" * 30 + "\x07" + "w" * 700 + "\x07" * 60, "\U0010ffff" + flag + tag + "\U0010ffff"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", inspect.carriers(F.col("text")).alias("c")).collect()
    for r in rows:
        t = texts[r.doc_id]
        for x in r.c:
            o = x.offset
            behind_flag = bool(re.search(f"{flag}[\U000e0000-\U000e007f]*\\Z", t[:o])) and 0xE0000 <= ord(t[o]) <= 0xE007F
            assert (x.char, x.left, x.right, x.of_flag) == (t[o], t[max(0, o - 40) : o], t[o + 1 : o + 41], behind_flag)


def test_apply_of_many_operations(spark):
    draw = random.Random(9)
    rows = []
    for n in (0, 5, 511, 512, 513, 1024, 5000):
        text = "".join(draw.choices("abé\U0001f3f4", k=n))
        cuts = sorted(draw.sample(range(n + 1), min(n, 60)))
        ops = [(a, b, draw.choice(["", "-", "new"])) for a, b in zip(cuts[::2], cuts[1::2], strict=False)]
        rows.append((text, ops, "".join(x for x in _applied(text, ops))))
    got = spark.createDataFrame(rows, f"text string, ops array<{operations.OP}>, want string").select("want", operations.apply("text", "ops").alias("got")).collect()
    assert all(r.got == r.want for r in got)


def _applied(text, ops):
    at = 0
    for a, b, t in ops:
        yield from (text[at:a], t)
        at = b
    yield text[at:]


def test_time_in_proportion_to_carriers(spark):
    """192,000 characters with 32,000 carriers, clean in seconds; four times as many take four times as long and not sixteen."""
    took = []
    for n in (8_000, 32_000):
        docs = spark.createDataFrame([(1, "abcd​e" * n), (2, "abc\U0001f3f4\U000e0067 " * n)], "doc_id long, text string").cache()
        docs.count()
        began = time.monotonic()
        got = {r.doc_id: r for r in sanitize.sanitize(docs).select("doc_id", "clean", F.size("ops").alias("n")).collect()}
        took.append(time.monotonic() - began)
        assert got[1].clean == "abcde" * n and got[1].n == n and got[2].n == 0
    assert took[1] < 8 * max(took[0], 0.5), took


def test_inspection_puts_both_kinds_in_one_order(spark):
    rows = [(1, "x​ pаypal​ о Кelvin"), (2, "plain"), (3, None), (4, "а​b")]
    got = inspect.inspection(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "number").collect()
    assert [(r.doc_id, r.number, r.offset, r.kind) for r in got] == [
        (1, 0, 1, "zero_width"), (1, 1, 4, "confusable"), (1, 2, 9, "zero_width"), (1, 3, 13, "confusable"), (4, 0, 1, "zero_width"),
    ]
    assert got[1].codepoint == 0x430 and got[1].protected_by == "substitution_would_change_meaning" and not got[1].removable


def test_all_policies_in_one_pass(spark):
    """The same as each policy on its own, though a text is read and handed to Python once."""
    odd = [(1, None), (2, ""), (3, "éx​ ạ́"), (4, "​" * 40 + "é" * 30), (5, "a‍b  ­́"), (6, "plain"), (None, "́‮a b")]
    docs = spark.createDataFrame(odd, "doc_id long, text string")
    rows = sanitize.all_policies(docs)
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    want = set()
    for name in ("report", "safe", "typographic", "aggressive"):
        alone = sanitize.sanitize(docs, inspect.UnicodePolicy(name=name))
        want |= {(r.doc_id, name, len(r.ops), r.clean) for r in alone.collect()}
    assert {(r.doc_id, r.policy, r.n_ops, r.clean) for r in rows.collect()} == want
