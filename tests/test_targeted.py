"""Targeted search against a plain version, and stopped runs against whole ones."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from inkwell.operators import fidelity, select, structure, targeted
from inkwell.sources.rounds import Rounds

REGIONS = "doc_id long, text string, regions array<struct<start:int,end:int,risk:double>>, extra int"
RULES = [("the ", "a "), ("the ", "one "), ("en ", "in "), ("la", "le"), ("2024", "2025"), ("cat", "c" * 60)]


def options(phrase):
    made = [F.when(F.instr(phrase, a) > 0, F.struct(F.concat(F.substring(phrase, F.lit(1), F.instr(phrase, a) - 1), F.lit(b), F.substring(phrase, F.instr(phrase, a) + len(a), F.length(phrase))).alias("replacement"), F.lit("exact_phrase").alias("operator"))) for a, b in RULES]
    return F.array_compact(F.array(*made))


def risk(text):
    return F.size(F.regexp_extract_all(text, F.lit("(?:th|en|la)"), 0)).cast("double")


def plain(text, regions, s):
    """state, reason, depth, chosen operations, counts of one document, as one loop."""
    score = lambda t: float(len(re.findall("th|en|la", t)))
    text = text or ""
    base = score(text) if s.max_queries else None
    met = lambda x: s.threshold is not None and x <= s.threshold if s.mode == "verify_below_threshold" else base - x > 0 and base - x >= s.least_gain
    won = "verified_below_threshold" if s.mode == "verify_below_threshold" else "verified_reduction_only"
    count = {"proposed": 0, "duplicates": 0, "scored": 0, "candidates": 0, "queries": int(s.max_queries > 0)}
    refused = []
    if not s.max_queries:
        return "abstained", "budget exhausted for detector_queries: requested 1, limit 0, spent 0, reserved 0", 0, None, count, refused
    if met(base):
        return won, "source already met the requested target", 0, [], count, refused
    regions = (regions or [])[: s.regions]
    if not regions:
        return "abstained", "localization found no editable regions", 0, None, count, refused
    root = {"id": "candidate-" + targeted.content_hash(text)[:12], "ops": [], "text": text, "queries": 0}
    beam, archive, seen, best, idle = [root], [], {targeted.content_hash(text)}, base, 0
    key = lambda c: (not c["met"], 0.55 * c["char"] + 0.35 * c["token"] + 0.1 * c["drift"], c["char"], c["token"], len(c["ops"]), c["risk"], c["queries"], c["hash"])
    costs = lambda c: [c[k] for k in ("risk", "char", "token", "drift", "queries")]
    front = lambda cs: sorted((c for c in cs if not any(o is not c and all(x <= y for x, y in zip(costs(o), costs(c), strict=True)) and costs(o) != costs(c) for o in cs)), key=key)
    for depth in range(1, s.depth + 1):
        new, stop = [], None
        for parent in beam:
            region = next((r for r in regions if all(o[1] <= r[0] or o[0] >= r[1] for o in parent["ops"])), None)
            if region is None:
                continue
            if count["candidates"] >= s.max_candidates:
                stop = "budget exhausted for candidates before proposal generation"
                break
            phrase = text[region[0] : region[1]]
            made = [phrase.replace(a, b, 1) for a, b in RULES if a in phrase][: s.per_node]
            count["proposed"] += len(made)
            for m in made:
                if count["candidates"] >= s.max_candidates:
                    stop = f"budget exhausted for candidates: requested 1, limit {s.max_candidates}, spent {count['candidates']}, reserved 0"
                    break
                ops = sorted([*parent["ops"], (region[0], region[1], m)])
                t = text
                for b, e, x in reversed(ops):
                    t = t[:b] + x + t[e:]
                h = targeted.content_hash(t)
                if h in seen:
                    count["duplicates"] += 1
                    continue
                seen.add(h)
                bad = [(g, why) for g, status, hard, why in fidelity.gates_of(text, ops, [r[:2] for r in regions], "text/plain", s.limits, False) if hard and status != "passed"]
                if bad:
                    count["candidates"] += 1
                    refused.append((parent["id"], h, bad[0][0]))
                    continue
                if count["queries"] >= s.max_queries:
                    stop = f"budget exhausted for detector_queries: requested 1, limit {s.max_queries}, spent {count['queries']}, reserved 0"
                    break
                for c in ("candidates", "queries", "scored"):
                    count[c] += 1
                n = len(text)
                new.append({"id": targeted.candidate_id(h, ops), "ops": ops, "hash": h, "char": min(1.0, sum(max(e - b, len(x)) for b, e, x in ops) / n), "token": fidelity.token_ratio(text, t), "drift": abs(len(t) - n) / n, "queries": parent["queries"] + 1, "risk": score(t), "met": met(score(t)), "text": t})
            if stop:
                break
        archive += new
        if wins := [c for c in new if c["met"]]:
            return won, "minimum-edit success found at the shallowest successful depth", depth, min(wins, key=key)["ops"], count, refused
        reason = stop or ("no fidelity-valid candidates remained" if not new else None)
        if not reason:
            low = min(c["risk"] for c in new)
            idle = idle + 1 if best - low < s.least_gain else 0
            best = best if idle else low
            reason = "stagnation limit reached" if idle >= s.stagnation else "search depth exhausted" if depth == s.depth else None
        if reason:
            chosen = front(archive)
            return "abstained", reason, depth, chosen[0]["ops"] if chosen else None, count, refused
        ordered, beam = front(new), []
        for c in ordered:
            if len(beam) < s.width and all(difflib.SequenceMatcher(None, c["text"], b["text"], autojunk=False).ratio() < s.most_alike for b in beam):
                beam.append(c)
        beam += [c for c in ordered if c not in beam][: s.width - len(beam)]
    raise AssertionError


def documents():
    rng = random.Random(4)
    words = ["the", "cat", "en", "la", "mit", "2024", "then", "dog.", "see", "12%", "and", "fish"]
    rows = []
    for d in range(60):
        text = " ".join(rng.choices(words, k=rng.randrange(30, 90)))
        cuts = sorted(rng.sample(range(len(text)), 6))
        regions = [(a, b, 1.0) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        rng.shuffle(regions)
        rows.append((d, text, regions, 1))
    return [*rows, (100, None, None, 1), (101, "the end", [], 1), (102, "dog fish", [(0, 3, 1.0)], 1), (103, rows[0][1], rows[0][2], 2), (103, rows[0][1], rows[0][2], 2)]


CASES = [
    targeted.Settings(mode="relative_reduction", least_gain=2.0, limits=(0.4, 0.4, 0.1), width=2),
    targeted.Settings(threshold=3.0, limits=(0.6, 0.6, 0.2), width=3, depth=4, max_rounds=4, per_node=2),
    targeted.Settings(mode="relative_reduction", least_gain=9.0, limits=(0.6, 0.6, 0.2), max_candidates=7, width=2),
    targeted.Settings(mode="relative_reduction", least_gain=9.0, limits=(0.6, 0.6, 0.2), max_queries=4, stagnation=1),
    targeted.Settings(threshold=0.0, max_queries=0),
    targeted.Settings(mode="relative_reduction", least_gain=5.0, limits=(0.6, 0.6, 0.2), stagnation=1, most_alike=0.1, width=1),
]


@pytest.mark.parametrize("s", CASES)
def test_search_equals_plain_version(spark, s):
    rows = documents()
    got = targeted.search(spark.createDataFrame(rows, REGIONS).repartition(4), options, risk, s).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    reasons = set()
    for d, text, regions, _ in rows:
        state, reason, depth, ops, count, refused = plain(text, regions, s)
        r = by[d]
        assert (r.state, r.reason, r.depth, r.n_ops) == (state, reason, depth, None if ops is None else len(ops)), d
        result = None if ops is None else text or ""
        for b, e, x in reversed(ops or []):
            result = result[:b] + x + result[e:]
        assert r.result == result
        assert {k: r[k] for k in count} == count
        assert [(x.parent_id, x.content_hash, x.reason.split(":")[0]) for x in r.refused] == refused
        reasons.add(reason.split(":")[0])
    assert len(reasons) > 1 or not s.max_queries
    assert targeted.search(spark.createDataFrame([], REGIONS), options, risk, s).count() == 0


def test_a_stopped_run_goes_on(spark, tmp_path, monkeypatch):
    s = targeted.Settings(mode="relative_reduction", least_gain=9.0, limits=(0.6, 0.6, 0.2), width=2, stagnation=5)
    docs = spark.createDataFrame(documents(), REGIONS).repartition(3)
    key = lambda df: sorted(map(str, df.collect()))
    whole = key(targeted.search(docs, options, risk, s))
    commit, made, lost = Rounds.commit, [], []

    def stopping(self, df, name):
        if name == "round-2" and not lost:
            lost.append(name)
            df.write.parquet(self._place(name))  # written, but the run is lost before its mark
            raise RuntimeError("lost")
        made.append(name)
        return commit(self, df, name)

    monkeypatch.setattr(Rounds, "commit", stopping)
    with pytest.raises(RuntimeError, match="lost"):
        targeted.search(docs, options, risk, s, f"{tmp_path}/rounds")
    assert key(targeted.search(docs, options, risk, s, f"{tmp_path}/rounds")) == whole
    assert made == ["source", "round-0", "done-0", "round-1", "done-1", "round-2", "done-2", "round-3", "done-3"]
    made.clear()
    assert key(targeted.search(docs, options, risk, s, f"{tmp_path}/rounds")) == whole and made == []
    other = targeted.Settings(mode="relative_reduction", least_gain=8.0, limits=(0.6, 0.6, 0.2), width=2, stagnation=5)
    targeted.search(docs, options, risk, other, f"{tmp_path}/rounds")
    assert "round-0" in made  # other settings begin anew
    with pytest.raises(ValueError, match="another source"):
        targeted.search(docs.filter("doc_id > 3"), options, risk, s, f"{tmp_path}/rounds")


def test_settings_are_checked():
    for bad in ({"depth": 4}, {"width": 0}, {"depth": 9, "max_rounds": 9}, {"stagnation": 6}):
        with pytest.raises(ValueError):
            targeted.Settings(**bad)


def test_window_regions(spark):
    docs = spark.createDataFrame([(1, "aa bb cc dd ee ff gg hh"), (2, ""), (3, None)], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 3, 5)], "doc_id long, start int, end int")
    rows = {r.doc_id: r.regions for r in targeted.window_regions(docs, spans, lambda t: F.instr(t, "cc").cast("double"), 4, 2, 3).collect()}
    assert rows[2] is None and rows[3] is None and all(r.end <= 3 or r.start >= 5 for r in rows[1]) and rows[1]


def test_tokens_are_matched_in_time_and_as_the_alignment_does(monkeypatch):
    """Long texts with edits far apart are decided without aligning them whole."""
    r = random.Random(6)
    whole = difflib.SequenceMatcher

    def small(junk, a, b, autojunk):
        assert len(a) * len(b) <= 40_000, "aligned whole"
        return whole(junk, a, b, autojunk=autojunk)

    for _ in range(20):
        a = r.choices(["the", "cat", "sat", ",", "on", "a", "mat", "."], k=900)
        b = list(a)
        for i in sorted(r.sample(range(900), r.randint(1, 4)), reverse=True):
            b[i : i + r.randint(0, 3)] = r.choices(["the", "x", "y"], k=r.randint(0, 3))
        want = min(1.0, 1.0 - sum(m.size for m in whole(None, a, b, autojunk=False).get_matching_blocks()) / max(len(a), len(b)))
        with monkeypatch.context() as m:
            m.setattr(difflib, "SequenceMatcher", small)
            assert fidelity._tokens_ratio(a, b) == want
            assert all(fidelity.exceeds(a, b, most) == (want > most) for most in (0.0, 0.001, 0.01, 0.3, want, 1.0))


def test_regions_in_the_row_are_those_of_tables(spark):
    rng = random.Random(8)
    words = ["the", "cat", "42%", "https://a.org/b", "en", "\n\n", " ", '"said la', 'so"', "2024-05-06", "get_id()", "then."]
    rows = [(d, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for d in range(80)] + [(90, None), (91, " \n "), (92, "12 34 56 78 90")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size, stride in ((6, 3), (2, 5), (9, 9)):
        want, got = ({r.doc_id: r.regions for r in targeted.window_regions(docs, spans, risk, size, stride, 4).collect()} for spans in (structure.spans(docs), "text/plain"))
        assert got == want and any(want.values()) and None in want.values()


def test_a_round_scores_each_text_once_and_reads_spans_from_the_frontier(spark, monkeypatch):
    docs = spark.createDataFrame(documents(), REGIONS)
    plan = targeted.step(targeted.begin(docs, options, risk, CASES[0]), 1, risk, CASES[0])._jdf.queryExecution().optimizedPlan().toString()
    judged = next(line for line in plan.splitlines() if "#" in line and "transform(" in line)
    assert judged.count("regexp_extract_all") == 1
    text = "the cat has 12 fish"
    held = [{"start": a, "end": b, "kind": k} for a, b, k, _ in structure.spans_of(text)]
    region = {"start": 0, "end": 7, "risk": 1.0, "options": [{"replacement": "a cat", "operator": "x"}]}
    beam = [{"candidate_id": "c", "ops": [], "queries": 0}]
    want = targeted.grow(text, [region], beam, [], 0, 1, CASES[1])
    monkeypatch.setattr(structure, "spans_of", None)
    assert targeted.grow(text, [region], beam, [], 0, 1, CASES[1], held) == want and want["made"]


def test_edits_far_apart_are_matched_without_hashing_whole_texts(monkeypatch):
    r = random.Random(3)
    monkeypatch.setattr(select, "_Windows", None)
    for _ in range(20):
        a = "".join(r.choices("abcdefgh ", k=3000))
        b = list(a)
        for i in sorted(r.sample(range(3000), 3), reverse=True):
            b[i : i + r.randint(0, 3)] = r.choices("xyz", k=r.randint(0, 3))
        b = "".join(b)
        same = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert select.matched(a, b) == same
        assert [select.reaches(a, b, n) for n in (same, same + 1)] == [True, False]


def test_tokens_and_block_kinds_of_edits_are_those_of_the_whole_text():
    r = random.Random(12)
    words = ["the", "cat's", "a-b", "12%", "\n\n", "\n", "  ", "\t", "end.", " "]
    for _ in range(400):
        text = "".join(r.choice(words) + r.choice([" ", ""]) for _ in range(r.randint(1, 30)))
        facts = fidelity._Facts(text, "text/plain")
        for _ in range(4):
            cuts = sorted(r.choices(range(len(text) + 1), k=2 * r.randint(0, 3)))
            ops = [(a, b, r.choice([text[a:b], "", "x", "an ox", "\n", " \n\n y", text[a:b] + "s"])) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
            if len({o[:2] for o in ops if o[0] == o[1]}) < sum(o[0] == o[1] for o in ops):
                continue
            result = targeted.edited(text, ops)
            a, b, kept = facts.tokens_of(result, ops)
            names = {c: t for t, c in facts._codes.items()}
            assert [names[c] for c in a] == fidelity.TOKEN.findall(text) and [names[c] for c in b] == fidelity.TOKEN.findall(result)
            assert kept <= min(len(a), len(b))
            assert facts.keeps_shape(result, ops) == (len(structure.plain_blocks(text)) == len(structure.plain_blocks(result)))


def test_identifiers_are_those_of_the_whole_pattern():
    r = random.Random(5)
    parts = ["get_id()", "a.b-c()", "FooBar", "Foo1Bar2", "A_B", "AB_C1", "snake_case", "1234567", "deadbeef,", "v1.2.3", "1.2.3-rc.1", "٣.٤.٥", "word", "Word", "\n"]
    whole = next(p for kind, _, p in structure.PATTERNS if kind == "identifier")
    for _ in range(2000):
        text = "".join(r.choice(parts) + r.choice([" ", "", ".", "_", "()"]) for _ in range(r.randint(1, 6)))
        assert structure._identifiers(structure._Source(text, "text/plain", ())) == [m.span() for m in whole.finditer(text)], text


def test_spans_are_found_once_for_regions_and_rounds(spark):
    docs = spark.createDataFrame([(1, "the cat has 12 fish and the dog"), (2, None)], "doc_id long, text string")
    rows = targeted.window_regions(docs, "text/plain", risk, 4, 2, 3)
    got = {r.doc_id: [(x.start, x.end, x.kind) for x in r.held] for r in targeted.begin(rows, options, risk, CASES[0]).collect()}
    assert got == {1: [(12, 14, "number")], 2: []}
    assert [r.held for r in targeted.begin(rows.drop("held").filter("doc_id = 1"), options, risk, CASES[0]).collect()] == [r.held for r in rows.filter("doc_id = 1").collect()]


def test_a_round_is_dealt_to_several_tasks_a_core_and_settings_stay(spark, tmp_path):
    key, seen = "spark.sql.files.minPartitionNum", []
    before = spark.conf.get(key, None)
    rounds = Rounds(spark, f"{tmp_path}/r")

    class Told:
        schema = spark.range(1).schema

        @property
        def write(self):
            seen.append(spark.conf.get(key, None))
            return spark.range(1).write

    rounds.commit(Told(), "round-0")
    assert seen == [str(4 * spark.sparkContext.defaultParallelism)] and spark.conf.get(key, None) == before
