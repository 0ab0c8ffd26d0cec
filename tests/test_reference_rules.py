"""Answers that follow from the rules themselves, written by hand."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from inkwell.operators import attachments, inspect, ledger, metadata, operations, sanitize, structure, voice


def test_scripts_of_single_letters(spark):
    texts = {1: "µ", 2: "ª", 3: "\u1e81", 4: "aЖ", 5: "123 !", 6: "", 7: "日本 Ω x", 8: "\u0301", 9: "é"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.scripts for r in inspect.scripts(df).collect()}
    assert got == {1: ["Latin"], 2: ["Latin"], 3: [], 4: ["Cyrillic", "Latin"], 5: [], 6: [], 7: ["Greek", "Han", "Latin"], 8: [], 9: ["Latin"]}


def test_thresholds_take_equality(spark):
    rows = [("higher", 2.0, 2.0), ("higher", 2.5, 2.0), ("lower", 2.0, 2.0), ("lower", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "direction string, score double, threshold double")
    c = {n: F.col(n) for n in df.columns}
    assert [r[0] for r in df.select(ledger.threshold_met(c["score"], c["threshold"], c["direction"])).collect()] == [True, False, True, False]
    met = ledger.target_met(F.lit("verify_below_threshold"), F.lit("named"), F.lit(9.0), c["score"], c["threshold"], F.lit(0.0), c["direction"])
    assert [r[0] for r in df.select(met).collect()] == [True, False, True, False]
    less = ledger.target_met(F.lit("relative_reduction"), F.lit("named"), F.lit(2.0), c["score"], c["threshold"], F.lit(0.5), c["direction"])
    assert [r[0] for r in df.select(less).collect()] == [False, False, False, False]


def test_refused_requests_spend_nothing(spark):
    rows = [("a", 1, 50), ("a", 2, 90), ("a", 3, 10), ("a", 4, 40), ("a", 5, 1), ("b", 1, 101), ("b", 2, 100), ("b", 3, None), (None, 1, 100)]
    df = spark.createDataFrame(rows, "k string, t int, cost long").repartition(3)
    got = {(r.k, r.t): (r.spent, r.admitted) for r in ledger.admit(df, "k", ["t"], "cost", 100).collect()}
    assert got == {
        ("a", 1): (50, True), ("a", 2): (50, False), ("a", 3): (60, True), ("a", 4): (100, True), ("a", 5): (100, False),
        ("b", 1): (0, False), ("b", 2): (100, True), ("b", 3): (100, True), (None, 1): (100, True),
    }


def test_nfkc_reaches_latin_1(spark):
    df = spark.createDataFrame([(1, "1½"), (2, "plain")], "doc_id long, text string")
    out = {r.doc_id: r.clean for r in sanitize.sanitize(df, inspect.UnicodePolicy(normalization_form="NFKC")).collect()}
    assert out == {1: "11⁄2", 2: "plain"}
    assert sanitize.sanitize(df).filter("doc_id = 1").first().clean == "1½"


def test_operations_by_rule(spark):
    rows = [(1, "abcdef", 0, 2, None, "ab"), (1, "abcdef", 3, 3, None, ""), (2, "abcdef", 1, 1, None, "x"), (2, "abcdef", 1, 1, None, "y"), (3, "abc", 2, 9, None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, end int, original string, replacement string")
    got = sorted((r.doc_id, r.start, r.reason) for r in operations.violations(df).collect())
    assert got == [(1, 3, "no_op"), (2, 1, "duplicate_insertion"), (3, 2, "out_of_bounds")]
    edits = spark.createDataFrame([(1, 1, 2, ""), (1, 2, 4, ""), (1, 5, 5, "zz")], "doc_id long, start int, end int, text string")
    r = operations.collect(edits).withColumn("t", F.lit("abcdef"))
    r = r.withColumn("new", operations.apply("t", "ops")).withColumn("inv", operations.invert("t", "ops"))
    row = r.withColumn("back", operations.apply("new", "inv")).first()
    assert row.new == "aezzf" and [tuple(o) for o in row.inv] == [(1, 1, "bcd"), (2, 4, "")] and row.back == "abcdef"


def test_metadata_patterns(spark):
    pages = {
        1: """<p data-ai-x="one\ntwo">t</p>""",
        2: """<p data-ai-x='a "b" c'>t</p>""",
        3: """<meta name="author' content="x">""",
        4: """<meta property='author' content="x">""",
    }
    df = spark.createDataFrame(list(pages.items()), "page_id long, html string")
    kinds = {r.page_id: (r.kind, r.place) for r in metadata.html_evidence(df).collect()}
    assert kinds == {2: ("unsigned_ai_metadata", "data-ai"), 4: ("embedded_metadata", "meta")}
    clean = {r.page_id: r.clean for r in metadata.clean_html(df).collect()}
    assert clean == {1: pages[1], 2: "<p>t</p>", 3: pages[3], 4: ""}
    docs = spark.createDataFrame([(1, "---\nauthor: me\n\n---\nbody"), (2, "---\ntopic: x\x0cauthor: me\n---\nbody")], "doc_id long, text string")
    assert {r.doc_id: r.clean for r in metadata.clean_front(docs).collect()} == {1: "body", 2: "---\ntopic: x\n---\nbody"}


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def test_files_beyond_bounds_are_refused():
    head = attachments.PNG + chunk(b"IHDR", bytes(13))
    many = head + chunk(b"tEXt", b"Author\0me") * attachments.MOST_CHUNKS + chunk(b"IDAT", b"x") + chunk(b"IEND", b"")
    assert attachments.evidence_of(many)[1] == [("unknown", "png", "unreadable", "png has too many chunks")]
    with pytest.raises(ValueError, match="too many"):
        attachments.clean_png(many)
    with pytest.raises(ValueError, match="header"):
        attachments.png_chunks(attachments.PNG + chunk(b"tEXt", b"a\0b"))


def test_html_and_markdown_files():
    html = b"<!doctype html><html><head><meta name=generator content=ChatGPT><meta name=\"author\" content=\"A\"></head></html>"
    kind, rows = attachments.evidence_of(html)
    assert kind == "html" and [r[0] for r in rows] == ["unsigned_ai_metadata", "embedded_metadata"]
    kind, rows = attachments.evidence_of(b"---\nauthor: me\nmodel: claude\ntopic: x\n---\ntext")
    assert kind == "markdown" and [(r[0], r[2]) for r in rows] == [("embedded_metadata", "author"), ("unsigned_ai_metadata", "model")]
    assert attachments.evidence_of(b"---\ntopic: x\n---\n") == ("markdown", [])


def test_plain_paragraphs():
    cut = lambda t: [t[b[1] : b[2]] for b in structure.plain_blocks(t)]
    assert cut("one\ntwo\n\n\nthree  \n") == ["one\ntwo", "three"]
    assert cut("a\n \t\nb\n   ") == ["a", " \t\nb"]
    assert cut("") == [] and cut("\n\n") == [] and cut("  ") == [] and cut("x\r\n\r\ny") == ["x", "\r\ny"]


def test_straight_quotes_of_long_lines():
    text = '"quoted words" and ' * 20_000 + '\nan "odd" "line'
    found = [s for s in structure.spans_of(text, families=frozenset({"quote"})) if s[3] == "quote:straight"]
    assert len(found) == 20_000


def test_ngrams_of_long_texts(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60_000))), (2, "a b"), (3, None)], "doc_id long, text string")
    sizes = {r.doc_id: r.n for r in df.select("doc_id", F.size(voice.ngrams(F.col("text"), 8)).alias("n")).collect()}
    assert sizes[1] == 59_993 and sizes[2] == 0
