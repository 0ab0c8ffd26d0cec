"""Shortest edits, hops, structured proposals, known scores and keyed streams, against plain versions."""

import hashlib
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from inkwell.operators import attachments, diffs, fidelity, ledger, operations, scorers, search
from inkwell.sources import readers
from inkwell.sources.rounds import Rounds
from inkwell.streaming import stream


def common(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        old = row[:]
        for j, d in enumerate(b):
            row[j + 1] = old[j] + 1 if c == d else max(old[j + 1], row[j])
    return row[-1]


def replayed(text, ops):
    for s, e, t in reversed(ops):
        text = text[:s] + t + text[e:]
    return text


def test_shortest_edits_are_shortest_and_replay():
    rng = random.Random(2)
    for _ in range(400):
        a = "".join(rng.choices("abé\U0001f3f4", k=rng.randrange(25)))
        b = "".join(rng.choices("abé\U0001f3f4", k=rng.randrange(25))) if rng.random() < 0.5 else replayed(a, [(i, i + rng.randrange(2), rng.choice(["", "x"])) for i in range(0, len(a), 5)])
        ops = diffs.shortest_edits(a, b)
        assert replayed(a, ops) == b and all(x[1] < y[0] for x, y in zip(ops, ops[1:], strict=False))
        size = sum(e - s + len(t) for s, e, t in ops)
        assert size == len(a) + len(b) - 2 * common(a, b)
        assert size <= sum(e - s + len(t) for s, e, t in fidelity.diff_operations(a, b))


def test_shortest_edits_of_long_texts():
    rng = random.Random(3)
    a = "".join(rng.choices("etaoin shrdlu", k=60_000))
    b = replayed(a, [(i, i + 3, "new") for i in range(500, 59_000, 700)])
    began = time.process_time()
    ops = diffs.shortest_edits(a, b)
    assert replayed(a, ops) == b and time.process_time() - began < 20
    assert diffs.shortest_edits("", "") == [] and diffs.shortest_edits("", "x") == [(0, 0, "x")] and diffs.shortest_edits("x", "") == [(0, 1, "")]


def test_minimal_edits_column(spark):
    rows = [("the cat", "a cat"), (None, "x"), ("x", None), ("", ""), ("same", "same")]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("ops", diffs.minimal_edits("a", "b"))
    got = df.withColumn("again", operations.apply("a", "ops")).collect()
    assert [r.ops is None for r in got] == [False, True, True, False, False] and [r.again for r in got if r.ops is not None] == ["a cat", "", "same"]


def risk(text):
    return F.size(F.regexp_extract_all(text, F.lit("x"), 0)).cast("double")


def test_hops_roll_back_stop_and_go_on(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "xxxx"), (2, "xab"), (3, ""), (4, "xxbb"), (5, None)], "doc_id long, text string")
    change = {1: ("b", "xxx"), 2: ("x", ""), 3: ("a", "")}

    def step(rows, hop):
        return rows.select("doc_id", F.expr(f"regexp_replace(text, '^(.*?){change[hop][0]}', '$1{change[hop][1]}')").alias("text"))

    got = {r.doc_id: r for r in search.hops(docs, step, risk, most=3, patience=2, threshold=0.0).collect()}
    said = {k: (r.text, r.hop, r.risk, r.baseline, r.hops_run, r.met, r.reason) for k, r in got.items()}
    assert said[3] == ("", 0, 0.0, 0.0, 0, True, "source already met the requested target")
    assert said[2] == ("ab", 2, 0.0, 1.0, 2, True, "requested target met; stopping early")  # hop 1 made it worse and was rolled back
    assert said[1] == ("xxx", 2, 3.0, 4.0, 3, False, "hop schedule exhausted") and said[4][:2] == ("xbb", 2)
    plans = []
    commit = Rounds.commit

    def kept(self, df, name):
        if name.startswith("hop"):
            plans.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
        if name == "hop-3" and len(plans) < 5:
            raise RuntimeError("lost")
        return commit(self, df, name)

    monkeypatch.setattr(Rounds, "commit", kept)
    with pytest.raises(RuntimeError):
        search.hops(docs, step, risk, 3, 2, 0.0, folder=f"{tmp_path}/hops")
    again = {r.doc_id: r for r in search.hops(docs, step, risk, 3, 2, 0.0, folder=f"{tmp_path}/hops").collect()}
    assert again == got and len(plans) == 5
    assert max(plans[1:]) < 1.2 * min(plans[1:])  # a hop's plan doesn't hold those before it


def test_hops_by_a_column_need_no_shuffle(spark, monkeypatch):
    """A step that follows from the text alone gives what its table gives; the last hop's state isn't written twice."""
    docs = spark.createDataFrame([(1, "xxxx"), (2, "xab"), (3, ""), (4, "xxbb"), (5, None)], "doc_id long, text string")
    made = lambda hop: F.replace("text", F.lit(("x", "b", "xx")[hop - 1]), F.lit(("xx", "", "a")[hop - 1]))
    want = search.hops(docs, lambda rows, hop: rows.select("doc_id", made(hop).alias("text")), risk, 3, 2, 0.0).collect()
    names, plans, commit = [], [], Rounds.commit

    def kept(self, df, name):
        names.append(name)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return commit(self, df, name)

    monkeypatch.setattr(Rounds, "commit", kept)
    got = search.hops(docs, lambda _, hop: made(hop), risk, 3, 2, 0.0).collect()
    key = lambda r: r.doc_id
    assert sorted(got, key=key) == sorted(want, key=key)
    assert names == ["hop-0", "done-0", "hop-1", "done-1", "hop-2", "done-2", "hop-3"] and not any("Exchange" in p or "Join" in p for p in plans)


def test_structured_proposals(spark):
    ok = lambda r, o="a": json.dumps({"replacement": r, "operator": o})
    said = [
        (1, 0, ok("x"), "repeated"), (1, 1, ok("y"), None), (1, 2, ok("x"), None), (1, 3, ok("z", "b"), "over the limit"), (1, 4, ok("q", "c"), "operator not allowed"), (1, 5, ok("old"), "no change"), (1, 6, ok(""), "empty replacement"),
        (2, 0, "no json", "not JSON"), (2, 1, "[1]", "not an object"), (2, 2, '{"replacement": "x"}', "not the two fields"), (2, 3, '{"replacement": 1, "operator": "a"}', "not the two fields"), (2, 4, None, "not JSON"),
        (2, 5, '{"operator": "a", "replacement": "w", "more": 1}', "not the two fields"), (2, 6, '"text"', "not an object"), (2, 7, ' {"operator": "b", "replacement": "w"} ', None), (2, 8, ok("x") + " and more", "not JSON"),
    ]
    df = spark.createDataFrame([(d, 0, p, "old", c, 9) for d, p, c, _ in said], "doc_id long, region int, place int, phrase string, completion string, rank int").repartition(4)
    got = {(r.doc_id, r.place): r for r in search.structured(df, ("a", "b"), 2).collect()}
    assert {k: r.refusal for k, r in got.items()} == {(d, p): why for d, p, _, why in said}
    assert (got[1, 2].rank, got[1, 1].rank, got[2, 7].replacement) == (1, 2, "w")


def test_known_scores_are_not_made_again(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def load():
        def fn(text):
            asked.add(1)
            return float(len(text))

        return fn

    docs = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "b b"), (4, None), (4, "")], "doc_id long, text string").repartition(3)
    want = [(1, 2.0, 1), (2, 2.0, 1), (3, 3.0, 2), (4, 0.0, 0), (4, 0.0, 0)]
    folder = str(tmp_path / "scores")
    got = scorers.score_into(docs, load, "len", "1", folder)
    assert sorted((r.doc_id, r.score, r.token_count) for r in got.collect()) == want and asked.value == 3
    again = scorers.score_into(docs.unionByName(spark.createDataFrame([(9, "new")], "doc_id long, text string")), load, "len", "1", folder)
    assert sorted((r.doc_id, r.score, r.token_count) for r in again.collect()) == [*want, (9, 3.0, 1)] and asked.value == 4
    scorers.score_into(docs, load, "len", "1", folder).collect()
    assert asked.value == 4
    assert sorted((r.doc_id, r.score, r.token_count) for r in scorers.score(docs, load, "len", "2").collect()) == want and asked.value == 7


def batches(spark, folder, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def test_leases_on_a_stream_equal_the_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"k{rng.randrange(3)}", n, rng.choice(["reserve", "reserve", "settle", "close"]), str(rng.randrange(4)), float(rng.randrange(6))) for n in range(90)]
    schema = "key string, place long, action string, lease string, amount double"
    s = stream.leases(batches(spark, tmp_path, [rows[:30], rows[30:31], rows[31:]], schema), 12.0)
    got = stream.run_once(s, "leased", str(tmp_path / "cp")).select("place", "outcome", "spent", "reserved").collect()
    want = ledger.leases(spark.createDataFrame(rows, schema), "key", ["place"], 12.0).select("place", "outcome", "spent", "reserved").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({r.outcome for r in want}) > 3


def test_stagnation_and_numbers_on_a_stream_equal_the_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"k{n % 4}", n // 4, float(rng.randrange(8))) for n in range(60)]
    schema = "key string, round long, risk double"
    src = batches(spark, tmp_path, [rows[:20], rows[20:24], rows[24:]], schema)
    got = stream.run_once(stream.stagnation(src, 3), "stagnant", str(tmp_path / "cp")).collect()
    want = ledger.stagnation(spark.createDataFrame(rows, schema), "key").collect()
    assert sorted((r.key, r.round, r.risk, r.best, r.stagnant) for r in got) == sorted((r.key, r.round, r.risk, r.best, r.stagnant) for r in want)
    assert all(r.ended == (r.stagnant >= 3) for r in got) and any(r.ended for r in got)
    told = stream.run_once(stream.numbered(src.select("key", F.col("round").alias("place"))), "numbers", str(tmp_path / "cp2")).collect()
    assert sorted((r.key, r.place, r.sequence) for r in told) == sorted((k, n, n) for k, n, _ in rows)


def test_rows_dropped_by_the_watermark_are_counted(spark, tmp_path):
    schema = "ts timestamp, event_type string"
    import datetime as dt

    at = lambda h: dt.datetime(2024, 1, 1, h)
    src = batches(spark, tmp_path, [[(at(1), "a")], [(at(9), "a")], [(at(9), "b")], [(at(1), "late"), (at(12), "c")]], schema)
    q = stream.rates(src).writeStream.format("memory").queryName("rated").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert stream.dropped(q) == 1 and {(r.event_type, r.n) for r in spark.table("rated").collect()} >= {("a", 1)}


def test_files_that_killed_tasks(spark, tmp_path):
    deep = b"<svg>" + b"<g>" * 5000 + b"</g>" * 5000 + b"</svg>"
    rows = [("deep.svg", bytearray(b"<svg><metadata>" + b"<g>" * 5000 + b"</g>" * 5000 + b"</metadata></svg>")), ("dtd.svg", bytearray(b"<svg><!DOCTYPE svg></svg>")), ("plain.svg", bytearray(deep))]
    got = {r.path: r.kind for r in attachments.evidence(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["dtd.svg"] == "unknown" and set(got) == {"deep.svg", "dtd.svg", "plain.svg"}
    (tmp_path / "a.bin").write_bytes(b"12345")
    (tmp_path / "b.bin").write_bytes(b"1")
    found = {r.path.rsplit("/", 1)[-1]: (r.content, r.problem) for r in readers.read_attachments(spark, str(tmp_path), 3).collect()}
    assert found == {"a.bin": (None, "too large"), "b.bin": (b"1", None)}


def test_beam_grows_in_the_rows_of_documents(spark):
    """Each depth starts from what the one before has left, so no text is shuffled, made or scored again; repeated ids share a beam."""
    phrases = [("the ", "a "), ("de ", "du "), (", ", "; ")]
    rows = [(1, "the de , the"), (1, "de the th"), (2, "none"), (3, None), (None, "the de "), (None, "de , ")]
    out = search.beam(spark.createDataFrame(rows, "doc_id long, text string"), phrases, lambda t: (F.length(t) - F.length(F.replace(t, F.lit("th"), F.lit("t")))).cast("double"))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = {(d, 0, t) for d, t in rows}
    front = {d: [(t, t) for e, t in rows if e == d and t is not None] for d, _ in rows}
    for depth in (1, 2):
        for d, held in front.items():
            made = {(s, r.replace(a, b, 1)) for s, r in held for a, b in phrases if a in r}
            cost = {x: (float(x[1].count("th")), abs(len(x[1]) - len(x[0])) / max(1, len(x[0]))) for x in made}
            kept = [x for x in made if d is None or not any(p[0] <= cost[x][0] and p[1] <= cost[x][1] and p != cost[x] for p in cost.values())]
            front[d] = sorted(kept, key=lambda x: (*cost[x], hashlib.sha256(x[1].encode()).hexdigest()))[:4]
            want |= {(d, depth, r) for _, r in front[d]}
    assert {(r.doc_id, r.depth, r.result) for r in out.collect()} == want


def test_a_beam_scores_each_candidate_once(spark):
    """The plan makes and scores candidates in one place, not again for a filter or for each rival."""
    front = spark.createDataFrame([(1, [("the en", "the en")]), (2, [("x", "x")])], "doc_id long, front array<struct<source:string,result:string>>")
    score = lambda t: F.size(F.regexp_extract_all(t, F.lit("(?:th|en)"), 0)).cast("double")
    made = search._grown_beam(front, [("the ", "a "), ("en", "in")], score, 2)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == plan.count("array_distinct") == 1
    assert {r.doc_id: [c.result for c in r.front] for r in made.collect()} == {1: ["the in"], 2: []}
