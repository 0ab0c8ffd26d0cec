import pytest

from inkwell.operators import inspect, operations, sanitize, structure
from inkwell.operators.inspect import UnicodePolicy

#: (text, policy, clean text)
GOLDEN = [
    ("hello​world", "safe", "helloworld"), ("﻿hello", "safe", "hello"), ("a⁠b", "safe", "ab"),
    ("\U0001f468‍\U0001f469‍\U0001f467", "safe", None), ("❤️", "safe", None), ("1️⃣", "safe", None),
    ("\U0001f3f4\U000e0067\U000e0062\U000e0073\U000e0063\U000e0074\U000e007f", "safe", None), ("漢\U000e0100字", "safe", None),
    ("plain️ text", "safe", "plain text"), ("می‌خواهم", "safe", None), ("क्‌ष", "safe", None),
    ("سلام‏ ab", "safe", None), ("ab‏cd", "safe", "abcd"), ("file‮txt.exe", "safe", None), ("file‮txt.exe", "aggressive", "filetxt.exe"),
    ("a b", "safe", None), ("a b", "typographic", None), ("a b", "aggressive", "a b"),
    ("a b c　d e", "safe", "a b c d e"), ("Café", "safe", "Café"), ("so­ft", "safe", None), ("so­ft", "typographic", "soft"),
    ("x\U000e0001\U000e0022y", "safe", "xy"), ("a\u0007b\n\t\rc", "safe", "ab\n\t\rc"), ("p", "safe", None), ("p", "aggressive", "p"), ("r�", "safe", None),
    ("hello​world", "report", None), ("a‑b", "aggressive", "a b"), ("ن͏ن", "aggressive", None), ("", "safe", None),
]


@pytest.mark.parametrize("name", ["report", "safe", "typographic", "aggressive"])
def test_golden(spark, name):
    cases = [(i, t, t if c is None else c) for i, (t, p, c) in enumerate(GOLDEN) if p == name]
    df = spark.createDataFrame([(i, t) for i, t, _ in cases], "doc_id long, text string")
    form = "none" if name == "aggressive" else "NFC"
    got = {r.doc_id: r.clean for r in sanitize.sanitize(df, UnicodePolicy(name=name, normalization_form=form)).collect()}
    assert got == {i: c for i, _, c in cases}


def test_finding_fields(spark):
    df = spark.createDataFrame([(1, "ab​cd"), (2, "plain"), (3, None)], "doc_id long, text string")
    rows = inspect.findings(df).collect()
    assert [(r.doc_id, r.offset, r.codepoint, r.kind, r.removable) for r in rows] == [(1, 2, 0x200B, "zero_width", True)]


def test_confusables(spark):
    df = spark.createDataFrame([(1, "The аpple"), (2, "яблоко")], "doc_id long, text string")
    assert [(r.word, r.char, r.latin) for r in inspect.confusables(df).collect()] == [("аpple", "а", "a")]


def test_locked_spans_stay(spark):
    df = spark.createDataFrame([(1, "Café x​y"), (2, "k​k")], "doc_id long, text string")
    held = structure.spans(df, locks=("Caf..", "k.k"))
    got = {r.doc_id: r.clean for r in sanitize.sanitize(df, held=held).collect()}
    assert got == {1: "Café xy", 2: "k​k"}
    assert [r.doc_id for r in sanitize.blocked(df, held).collect()] == [2]
    with pytest.raises(ValueError):
        structure.spans(df, locks=("(",))


def test_apply_invert_and_violations(spark):
    ops = [(0, 1, "X"), (3, 3, "--"), (4, 6, "")]
    df = spark.createDataFrame([(1, "abcdefg", [dict(zip(("start", "end", "text"), o, strict=True)) for o in ops])], f"doc_id long, text string, ops array<{operations.OP}>")
    r = df.withColumn("out", operations.apply("text", "ops")).withColumn("back", operations.apply("out", operations.invert("text", "ops"))).first()
    assert (r.out, r.back) == ("Xbc--dg", "abcdefg")
    bad = spark.createDataFrame(
        [(1, "abcdef", 0, 2, None, "x"), (1, "abcdef", 1, 3, None, "y"), (1, "abcdef", 4, 4, None, "p"), (1, "abcdef", 4, 4, None, "q"), (1, "abcdef", 5, 9, None, "z"), (2, "abc", 0, 1, "q", "r"), (3, "abc", 0, 1, "a", "a")],
        "doc_id long, text string, start int, end int, original string, replacement string",
    )
    got = {(v.doc_id, v.start, v.reason) for v in operations.violations(bad).collect()}
    assert got == {(1, 1, "overlap"), (1, 4, "duplicate_insertion"), (1, 5, "out_of_bounds"), (2, 0, "original_mismatch")}


def test_scripts_and_summary(spark):
    df = spark.createDataFrame([(1, "ab Я\n漢"), (2, ""), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.scripts for r in inspect.scripts(df).collect()} == {1: ["Cyrillic", "Han", "Latin"], 2: [], 3: []}
    assert [(r.n_chars, r.n_lines) for r in inspect.summary(df).orderBy("doc_id").collect()] == [(6, 2), (0, 0), (0, 0)]
