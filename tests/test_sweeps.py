"""Interval sweeps, lookups by binary search and leases, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import ledger, localize, structure

SPAN = "array<struct<start:int,end:int>>"


def clipped(regions, spans):
    out = []
    for d, start, end, risk in regions:
        parts = [(start, end)] if start < end else []
        for _, s, e in sorted(x for x in spans if x[0] == d):
            parts = [p for a, b in parts for p in ([(a, b)] if e <= a or s >= b else [(a, s), (e, b)])]
        out += [(d, a, b, risk) for a, b in parts if a < b]
    return sorted(out, key=str)


def test_clip_is_the_difference_of_intervals(spark):
    rng = random.Random(1)
    place = lambda n: sorted(rng.choices(range(n), k=2))
    regions = [(d, *place(40), float(rng.randrange(3))) for d in range(12) for _ in range(rng.randrange(1, 7))]
    regions += regions[:3] + [(50, 3, 9, 1.0), (51, 4, 4, 1.0), (None, 1, 5, 1.0)]
    spans = [(d, *place(40)) for d in range(10) for _ in range(rng.randrange(9))] + [(0, 5, 5), (0, 5, 9), (1, 0, 40), (99, 1, 2)]
    got = localize.clip(spark.createDataFrame(regions, "doc_id long, start int, end int, risk double"), spark.createDataFrame(spans, "doc_id long, start int, end int"))
    want = clipped([r for r in regions if r[0] is not None], spans)
    assert sorted((tuple(r) for r in got.filter("doc_id is not null").select("doc_id", "start", "end", "risk").collect()), key=str) == want
    none = localize.clip(spark.createDataFrame(regions, "doc_id long, start int, end int, risk double"), spark.createDataFrame([], "doc_id long, start int, end int"))
    assert none.count() == sum(r[1] < r[2] for r in regions if r[0] is not None) + none.filter("doc_id is null").count()


def test_clip_is_one_sort(spark):
    """A task sorts its rows once, by hash of the document, and holds no window, aggregate or join; a region without an id is whole."""
    rng = random.Random(4)
    regions = [(d, a, a + rng.randrange(1, 30), 1.0) for d in range(3) for a in range(400)]
    spans = [(d, a, a + rng.randrange(0, 4)) for d in range(2) for a in sorted(rng.sample(range(420), 60))]
    made = lambda r, s: localize.clip(spark.createDataFrame(r, "doc_id long, start int, end int, risk double"), spark.createDataFrame(s, "doc_id long, start int, end int"))
    got = made(regions, spans)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect()), key=str) == clipped(regions, spans)
    assert plan.count("Exchange ") == plan.count("Sort ") == 1 and not any(x in plan for x in ("Window", "Aggregate", "Join"))
    alone = made([(None, 1, 5, 1.0)], [(None, 2, 3), (1, 0, 9), (2, 0, 9)])
    assert [tuple(r) for r in alone.collect()] == [(None, 1, 5, 1.0)]


def test_merged_rows_are_the_merged_array(spark):
    rng = random.Random(2)
    rows = []
    for d in range(30):
        at = 0
        for _ in range(rng.randrange(0, 25)):
            at += rng.randrange(0, 12)
            rows.append((d, at, at + rng.randrange(0, 15), float(rng.randrange(5))))
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, risk double").repartition(5)
    got = sorted(map(tuple, localize.merged(df).collect()))
    arrays = df.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "risk")).alias("r"))
    want = sorted(map(tuple, arrays.select("doc_id", F.explode(localize.merge("r")).alias("m")).select("doc_id", "m.start", "m.end", "m.risk").collect()))
    assert got == want and len(got) < len(rows)
    assert localize.merged(df.limit(0)).count() == 0


def test_sweeps_take_large_documents(spark):
    """One document of 200,000 spans and regions."""
    spans = spark.range(200_000).selectExpr("1L as doc_id", "cast(id * 10 as int) as start", "cast(id * 10 + 4 as int) as end")
    regions = spark.range(200_000).selectExpr("1L as doc_id", "cast(id * 10 + 2 as int) as start", "cast(id * 10 + 12 as int) as end", "1.0D as risk")
    r = localize.clip(regions, spans).agg(F.count("*"), F.sum(F.col("end") - F.col("start"))).first()
    assert r[0] == 200_000 and r[1] == 199_999 * 6 + 8
    assert localize.merged(regions.withColumn("end", F.col("end") + 3), 0.1).count() == 1


def test_lookup_by_binary_search(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        cuts = sorted(rng.sample(range(60), 2 * rng.randrange(0, 12)))
        spans = list(zip(cuts[::2], cuts[1::2], strict=True))
        for _ in range(8):
            a, b = sorted(rng.choices(range(62), k=2))
            rows.append((spans, a, rng.choice([a, b])))
    df = spark.createDataFrame(rows, f"spans {SPAN}, a int, b int")
    got = df.select("*", localize.span_index(F.col("spans"), F.col("a")).alias("i"), localize.overlapping(F.col("spans"), F.col("a"), F.col("b")).alias("over"), localize.is_protected(F.col("spans"), F.col("a"), F.col("b")).alias("held")).collect()
    for r in got:
        spans = [tuple(s) for s in r.spans]
        inside = [k for k, (s, e) in enumerate(spans) if s <= r.a < e]
        assert r.i == (inside[0] if inside else None)
        over = [(s, e) for s, e in spans if (s < r.a < e if r.a == r.b else s < r.b and r.a < e)]
        assert [tuple(s) for s in r.over] == over and r.held == bool(over)


def test_eligible_and_editable_regions(spark):
    ddl = f"regions {SPAN}, ops {SPAN}, n int"
    rows = [([(0, 5), (5, 9), (20, 25)], [(4, 6)], 30), ([(0, 5)], [], 30), ([], [(1, 2)], 30), ([(0, 5)], [(0, 1)], 30), ([(3, 6)], [(3, 3), (6, 6), (30, 30)], 30), ([], [(0, 0)], 0), ([(3, 6)], [(4, 4)], 9)]
    got = spark.createDataFrame(rows, ddl).select(localize.eligible_region(F.col("regions"), F.col("ops")).alias("e"), localize.editable_regions(F.col("ops"), F.col("n")).alias("w")).collect()
    assert [r.e for r in got] == [2, 0, None, None, 0, None, None]
    assert [[tuple(w) for w in r.w] for r in got] == [[(4, 6)], [], [(1, 2)], [(0, 1)], [(3, 4), (6, 7), (29, 30)], [], [(4, 5)]]


@pytest.mark.parametrize("limit", [10, 10.5])
def test_leases(spark, limit):
    said = [
        ("reserve", "a", 6, "ok", 0, 6), ("reserve", "b", 5, "refused", 0, 6), ("settle", "b", 1, "unknown", 0, 6), ("settle", "a", 7, "overrun", 0, 6), ("settle", "a", 4, "ok", 0, 6),
        ("reserve", "a", 1, "duplicate", 0, 6), ("close", "a", None, "ok", 4, 0), ("close", "a", None, "unknown", 4, 0), ("reserve", "b", 6, "ok", 4, 6), ("close", "b", None, "ok", 4, 0),
        ("reserve", "c", -1, "negative", 4, 0), ("reserve", "d", None, "ok", 4, 0), ("settle", "d", 1, "overrun", 4, 0), ("wait", "d", 1, "unknown", 4, 0), ("settle", "d", -1, "negative", 4, 0),
    ]
    kind = "long" if limit == 10 else "double"
    rows = [(run, n, a, x, None if c is None else c if kind == "long" else float(c), 0) for run in ("r", "s", None) for n, (a, x, c, *_) in enumerate(said)]
    df = spark.createDataFrame(rows, f"run_id string, n int, action string, lease string, amount {kind}, extra int").repartition(4)
    got = ledger.leases(df, "run_id", ["n"], limit).orderBy("run_id", "n").collect()
    assert [(r.outcome, r.spent, r.reserved, r.remaining) for r in got] == [(o, s, h, limit - s - h) for _, _, _, o, s, h in said] * 3
    assert ledger.leases(df.limit(0), "run_id", ["n"], limit).count() == 0


def test_windows_in_the_row_are_those_of_tokens(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choices("ab\U0001f3f4   \n\t\x0b\x1c", k=rng.randrange(120)))) for i in range(60)] + [(90, None), (91, ""), (92, " \n"), (93, "word " * 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size, stride in ((4, 2), (5, 5), (3, 7)):
        a = localize.windows_of(docs, size, stride, lambda t: F.length(t).cast("double"))
        b = localize.window_scores(docs, localize.token_windows(structure.tokens(docs), size, stride), lambda t: F.length(t).cast("double"))
        columns = ["doc_id", "window", "token_start", "token_end", "start", "end", "risk"]
        got, want = (sorted(map(tuple, x.select(columns).collect())) for x in (a, b))
        assert got == want and len(got) > 100
