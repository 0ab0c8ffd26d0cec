import random
import re

import pytest

from inkwell.operators import fidelity, localize, structure

MD = "# One\n\ntext\nmore\n- a\n  b\n* c\n> q\n> r\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\n```py\ncode\n```\nend"


def kinds(text, media="text/markdown"):
    return [(k, text[a:b]) for k, a, b, _ in structure.blocks_of(text, media)]


def test_markdown_blocks():
    assert kinds(MD) == [
        ("heading", "# One"), ("paragraph", "text\nmore"), ("list_item", "- a\n  b"), ("list_item", "* c"), ("quote", "> q\n> r"), ("table", "| x | y |\n|---|---|\n| 1 | 2 |"), ("code", "```py\ncode\n```"), ("paragraph", "end"),
    ]
    assert kinds("~~~\na\n```\nb") == [("code", "~~~\na\n```\nb")]
    assert kinds("one\ntwo\n\nthree \n", "text/plain") == [("paragraph", "one\ntwo"), ("paragraph", "three")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("see https://a.org/x?y=1.", [("url", "https://a.org/x?y=1")]), ("mail a.b@c.org now", [("url", "a.b@c.org")]), ("on 2024-03-05", [("date", "2024-03-05")]), ("May 4, 2021", [("date", "May 4, 2021")]),
        ("42% of it", [("unit", "42%")]), ("cost $1.5 million", [("unit", "$1.5 million")]), ("as in (Smith, 2020) and [12]", [("citation", "(Smith, 2020)"), ("citation", "[12]")]), ('he said "hi there"', [("quote", '"hi there"')]),
        ('a 6" pipe', [("number", "6")]), ("call get_id() in my_mod v1.2.3", [("identifier", "get_id()"), ("identifier", "my_mod"), ("identifier", "v1.2.3")]), ("about -3.5e4 or 7", [("number", "-3.5e4"), ("number", "7")]),
    ],
)
def test_spans(text, want):
    assert [(k, text[a:b]) for a, b, k, _ in structure.spans_of(text)] == want


def test_markdown_spans_and_locks():
    text = "use `a b` and [x](http://y.z/q) 42"
    got = [(d, text[a:b]) for a, b, _, d in structure.spans_of(text, "text/markdown")]
    assert got == [("markdown:inline_code", "`a b`"), ("markdown:link_target", "http://y.z/q"), ("number", "42")]
    assert structure.spans_of("x 42", locks=(re.compile("x 4"),))[0][2] == "user_lock"


def test_lines_and_tokens(spark):
    df = spark.createDataFrame([(1, "ab\n\ncd"), (2, "x\n"), (3, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.start, r.end) for r in structure.lines(df).collect()) == [(1, 0, 2), (1, 3, 3), (1, 4, 6), (2, 0, 1)]
    t = structure.tokens(spark.createDataFrame([(1, " a  bc\td")], "doc_id long, text string"))
    assert [(r["index"], r.start, r.end, r.token) for r in t.orderBy("start").collect()] == [(0, 1, 2, "a"), (1, 4, 6, "bc"), (2, 7, 8, "d")]
    w = localize.token_windows(t, 2, 1).orderBy("window").collect()
    assert [(r.token_start, r.token_end, r.start, r.end) for r in w] == [(0, 2, 1, 6), (1, 3, 4, 8)]


def test_gates():
    text = "The measured value is 42 units."
    status = lambda ops, limits=(0.2, 0.25, 0.1): {g: s for g, s, *_ in fidelity.gates_of(text, ops, [(0, len(text))], "text/plain", limits, False)}
    assert status([(22, 24, "41")])["protected_spans"] == "failed"
    assert all(status([(0, 3, "A")])[g] == "passed" for g in fidelity.GATES[:4])
    assert status([(0, 12, "x")])["edit_budgets"] == "failed"
    assert status([(5, 2, "x")]) == {"unicode_materialization": "failed"}
    assert fidelity.gates_of(text, [(0, 3, "A")], [(5, 9)], "text/plain", (1, 1, 1), True)[1][1] == "failed"
    two = fidelity.gates_of("one two", [(3, 4, "\n\n")], [(0, 7)], "text/plain", (1, 1, 1), False)
    assert two[4][1] == "failed"
    for s, c in (("kitten", "sitting"), ("", "x"), ("same", "same")):
        ops = fidelity.diff_operations(s, c)
        out, at = [], 0
        for a, b, t in ops:
            out += [s[at:a], t]
            at = b
        assert "".join([*out, s[at:]]) == c


def test_merge_and_clip(spark):
    df = spark.createDataFrame([(1, 0, 10, 1.0), (1, 6, 14, 3.0), (1, 30, 40, 2.0)], "doc_id long, start int, end int, risk double")
    from pyspark.sql import functions as F

    r = df.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "risk")).alias("r")).select(localize.merge("r", 0.5).alias("m")).first()
    assert [(x.start, x.end, x.risk) for x in r.m] == [(0, 14, 3.0), (30, 40, 2.0)]
    spans = spark.createDataFrame([(1, 2, 4), (1, 8, 12)], "doc_id long, start int, end int")
    got = localize.clip(df, spans).collect()
    assert sorted((x.start, x.end) for x in got) == [(0, 2), (4, 6), (4, 8), (6, 8), (12, 14), (30, 40)] or sorted((x.start, x.end) for x in got) == [(0, 2), (4, 8), (6, 8), (12, 14), (30, 40)]


def test_token_limit_is_decided_as_the_blocks_do():
    r = random.Random(5)
    for _ in range(4000):
        a = r.choices("abcde", k=r.randint(0, 12))
        b = list(a) if r.random() < 0.7 else r.choices("abcde", k=r.randint(0, 12))
        for _ in range(r.randint(0, 3)):
            i = r.randint(0, len(b))
            b[i : i + r.randint(0, 2)] = r.choices("abcde", k=r.randint(0, 2))
        for most in (0.0, 0.1, 0.25, 0.5, 1.0):
            assert fidelity.exceeds(a, b, most) == (fidelity.token_ratio(" ".join(a), " ".join(b)) > most), (a, b, most)


def test_long_texts_need_no_matching_of_blocks(monkeypatch):
    text = "the cat, the dog " * 20_000
    monkeypatch.setattr(fidelity.difflib, "SequenceMatcher", None)  # quadratic on such a text
    for ops, want in (([(0, 1, "T")], ""), ([(1, 2, "9")], ""), ([(len(text) // 2, len(text), "")], "character edit ratio, token edit ratio, length drift")):
        assert fidelity.gates_of(text, ops, [(0, len(text))], "text/plain", (0.2, 0.25, 0.1), False)[2][3] == want


def test_a_documents_spans_are_found_once(monkeypatch):
    text, seen = "It cost $5 on 2024-03-05.", []
    spans_of = structure.spans_of
    monkeypatch.setattr(structure, "spans_of", lambda *a: seen.append(a) or spans_of(*a))
    facts = fidelity._Facts(text, "text/plain")
    got = [fidelity.gates_of(text, [(0, 2, t)], [(0, len(text))], "text/plain", (1, 1, 1), False, facts) for t in ("A", "B")]
    assert len(seen) == 1 and got[0] == fidelity.gates_of(text, [(0, 2, "A")], [(0, len(text))], "text/plain", (1, 1, 1), False)


@pytest.mark.parametrize("mark", ["٣", "7", "www.a.org", "a@b.org", "doi: 10.1234/x", "May 2021", "[١٢]"])
def test_texts_without_a_pattern_s_marks_are_not_searched(mark):
    for text in (f"One {mark} two", "One and two"):
        want = [(a, b, k, n) for k, n, p in structure.PATTERNS for a, b in (m.span() for m in p.finditer(text))]
        assert structure.spans_of(text) == structure.resolve(want)


def test_tokens_after_edits_are_those_of_the_whole_text():
    r = random.Random(9)
    for _ in range(3000):
        text = "".join(r.choices("ab,. \n é", k=r.randint(0, 14)))
        s = r.randint(0, len(text))
        e = r.randint(s, len(text))
        result = text[:s] + "".join(r.choices("ab, ", k=r.randint(0, 3))) + text[e:]
        assert fidelity._Facts(text, "text/plain").tokens_of(result, s, e) == fidelity.TOKEN.findall(result), (text, s, e, result)
    assert fidelity.gates_of("one", [(0, 1, "\ud800")], [(0, 3)], "text/plain", (1, 1, 1), False) == [(fidelity.GATES[0], "failed", True, "not encodable")]
