"""Targeted search: a beam of small, gated edits for each document, round by round.

The frontier is a table with a row for each document that still searches: its
beam, archive, seen hashes and what it has spent stand in the row. A round is
one map over that table: every parent takes its first region that it has not
touched, the region's replacements become candidates, gates judge them, known texts are
dropped, budgets admit the rest in order, only admitted ones are scored, and the
skyline's diverse best are the next beam. Nothing is shuffled. Documents
whose search is over leave with the reason; the others go on. Each round is committed
(``Rounds``), so a stopped search goes on behind its last whole round.

Scores come from a column function. Replacements are a column function of a
region's text. Python judges gates and likeness, document by document.

Defined results: a null text is empty; a document without regions, or one that
meets the target already, ends in round 0; repeated rows search each on their own;
ties go by the candidates' key, which ends with the content's hash; an empty table
gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import unicodedata
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators import fidelity, ledger, localize, operations, select, structure
from inkwell.sources.rounds import Rounds

Scorer = Callable[[Column], Column]
Options = Callable[[Column], Column]

CANDIDATE = f"struct<candidate_id:string,parent_id:string,depth:int,ops:array<{operations.OP}>,content_hash:string,char_ratio:double,token_ratio:double,drift:double,queries:int,risk:double,met:boolean>"
HELD = "array<struct<start:int,end:int,kind:string>>"
_GROWN = f"struct<made:array<struct<candidate_id:string,parent_id:string,ops:array<{operations.OP}>,content_hash:string,char_ratio:double,token_ratio:double,drift:double,queries:int,text:string>>,"
_GROWN += "refused:array<struct<parent_id:string,content_hash:string,operator:string,reason:string>>,seen:array<string>,proposed:int,duplicates:int,candidates:int,queries:int,stop:string>"


@dataclass(frozen=True)
class Settings:
    """Bounds of a search. mode, kind, threshold, least_gain: the target, as ``ledger.target_met`` reads them."""

    mode: str = "verify_below_threshold"
    kind: str = "zero_shot"
    threshold: float | None = None
    least_gain: float = 0.0
    regions: int = 5
    width: int = 8
    per_node: int = 4
    depth: int = 3
    stagnation: int = 2
    most_alike: float = 0.92
    max_rounds: int = 3
    max_candidates: int = 32
    max_queries: int = 32
    limits: tuple[float, float, float] = (0.08, 0.12, 0.05)
    media_type: str = "text/plain"
    scorer: str = ""

    def __post_init__(self) -> None:
        if not (1 <= self.depth <= 8 and 1 <= self.width <= 32 and 1 <= self.per_node <= 16 and 1 <= self.regions <= 20 and 1 <= self.stagnation <= 5):
            raise ValueError("a bound of the search is out of range")
        if self.depth > self.max_rounds:
            raise ValueError("the depth must not exceed the rounds of the budget")


def content_hash(text: str) -> str:
    return hashlib.sha256(unicodedata.normalize("NFC", text).encode("utf-8", "surrogatepass")).hexdigest()


def candidate_id(content: str, ops: list[tuple[int, int, str]]) -> str:
    said = content + "|" + "|".join(f"{s}:{e}:{t}" for s, e, t in ops) if ops else content
    return "candidate-" + (hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest() if ops else content)[:12]


def token_ratio(facts: fidelity._Facts, result: str, ops: list[tuple[int, int, str]]) -> float:
    """Share of tokens outside the common start, the common end and the matching blocks between them."""
    a, b, _ = facts.tokens_of(result, ops)
    first = fidelity._alike_from_start(a, b)
    last = fidelity._alike_from_start(a[first:][::-1], b[first:][::-1])
    x, y = a[first : len(a) - last], b[first : len(b) - last]
    if not a:
        return 1.0 if b else 0.0
    inner = 0.0 if not x and not y else fidelity._tokens_ratio(x, y) if x else 1.0
    same = first + last + round((1.0 - inner) * max(len(x), len(y)))
    return min(1.0, 1.0 - same / max(len(a), len(b)))


def exhausted(counter: str, limit: int, spent: int) -> str:
    return f"budget exhausted for {counter}: requested 1, limit {limit}, spent {spent}, reserved 0"


def edited(text: str, ops: list[tuple[int, int, str]]) -> str:
    """The text with sorted operations carried out."""
    result, at = [], 0
    for b, e, t in ops:
        result += [text[at:b], t]
        at = e
    return "".join([*result, text[at:]])


def grow(text: str, regions: list[dict], beam: list[dict], seen: list[str], candidates: int, queries: int, s: Settings, held: list[dict] | None = None) -> dict:
    """One document's round up to its scores: candidates by parent and replacement, in order, as far as the budgets go. held: its protected spans, if they are known."""
    facts, known = fidelity._Facts(text, s.media_type, None if held is None else [(x["start"], x["end"], x["kind"], "") for x in held]), set(seen)
    places = [(r["start"], r["end"]) for r in regions]
    out = {"made": [], "refused": [], "seen": list(seen), "proposed": 0, "duplicates": 0, "stop": None}
    for parent in beam:
        done = [(o["start"], o["end"], o["text"]) for o in parent["ops"]]
        region = next((r for r in regions if all(e <= r["start"] or b >= r["end"] for b, e, _ in done)), None)
        if region is None:
            continue
        if candidates >= s.max_candidates:
            out["stop"] = "budget exhausted for candidates before proposal generation"
            break
        options = (region["options"] or [])[: s.per_node]
        out["proposed"] += len(options)
        for option in options:
            if candidates >= s.max_candidates:
                out["stop"] = exhausted("candidates", s.max_candidates, candidates)
                break
            ops = sorted([*done, (region["start"], region["end"], option["replacement"])])
            result = edited(text, ops)
            content = content_hash(result)
            if content in known:
                out["duplicates"] += 1
                continue
            known.add(content)
            out["seen"].append(content)
            bad = next((f"{g}: {why}" if why else g for g, status, hard, why in fidelity.gates_of(text, ops, places, s.media_type, s.limits, False, facts) if hard and status != "passed"), None)
            if bad:
                candidates += 1
                out["refused"].append({"parent_id": parent["candidate_id"], "content_hash": content, "operator": option["operator"], "reason": bad})
                continue
            if queries >= s.max_queries:
                out["stop"] = exhausted("detector_queries", s.max_queries, queries)
                break
            candidates, queries = candidates + 1, queries + 1
            n = max(1, len(text))
            out["made"].append(
                {
                    "candidate_id": candidate_id(content, ops), "parent_id": parent["candidate_id"], "ops": [dict(zip(("start", "end", "text"), o, strict=True)) for o in ops], "content_hash": content,
                    "char_ratio": min(1.0, sum(max(e - b, len(t)) for b, e, t in ops) / n), "token_ratio": token_ratio(facts, result, ops), "drift": abs(len(result) - len(text)) / n, "queries": parent["queries"] + 1, "text": result,
                }
            )
        if out["stop"]:
            break
    return out | {"candidates": candidates, "queries": queries}


def _grown(s: Settings):
    @F.arrow_udf(_GROWN)
    def run(text: pa.Array, regions: pa.Array, beam: pa.Array, seen: pa.Array, candidates: pa.Array, queries: pa.Array, held: pa.Array) -> pa.Array:
        op = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])
        made = pa.struct([("candidate_id", pa.string()), ("parent_id", pa.string()), ("ops", pa.list_(op)), ("content_hash", pa.string()), ("char_ratio", pa.float64()), ("token_ratio", pa.float64()), ("drift", pa.float64()), ("queries", pa.int32()), ("text", pa.string())])
        refused = pa.struct([(c, pa.string()) for c in ("parent_id", "content_hash", "operator", "reason")])
        kind = pa.struct([("made", pa.list_(made)), ("refused", pa.list_(refused)), ("seen", pa.list_(pa.string())), *((c, pa.int32()) for c in ("proposed", "duplicates", "candidates", "queries")), ("stop", pa.string())])
        return pa.array([grow(*row[:6], s, row[6]) for row in zip(*(x.to_pylist() for x in (text, regions, beam, seen, candidates, queries, held)), strict=True)], kind)

    return run


def diverse(texts: list[str], width: int, most_alike: float) -> list[int]:
    """Which of the texts, in their order, make a beam: each unlike those taken, then the first of the rest."""
    taken: list[int] = []
    for i, t in enumerate(texts):
        if len(taken) == width:
            break
        if not any(select.is_alike(t, texts[j], most_alike) for j in taken):
            taken.append(i)
    return taken + [i for i in range(len(texts)) if i not in taken][: width - len(taken)]


def _known(text: str, media_type: str | None) -> Column:
    """What a search asks of a text once: its content's hash and, for a media type, its protected spans."""

    @F.arrow_udf(f"struct<hash:string,held:{HELD}>")
    def run(text: pa.Array) -> pa.Array:
        kind = pa.struct([("hash", pa.string()), ("held", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])))])
        spans = lambda t: [{"start": a, "end": b, "kind": k} for a, b, k, _ in (structure.spans_of(t, media_type) if media_type else [])]
        return pa.array([{"hash": content_hash(t), "held": spans(t)} for t in text.to_pylist()], kind)

    return run(text)


COSTS = ("risk", "char_ratio", "token_ratio", "drift", "queries")


def order(c: dict) -> tuple:
    """What a candidate is chosen by: on target, least edited, then by risk, cost and content."""
    weighted = 0.55 * c["char_ratio"] + 0.35 * c["token_ratio"] + 0.1 * c["drift"]
    return not c["met"], weighted, c["char_ratio"], c["token_ratio"], len(c["ops"]), c["risk"], c["queries"], c["content_hash"]


def frontier(candidates: list[dict]) -> list[dict]:
    """The candidates that no other one dominates, in their order."""
    costs = [tuple(c[k] for k in COSTS) for c in candidates]
    beaten = lambda mine: any(all(a <= b for a, b in zip(other, mine, strict=True)) and other != mine for other in costs)
    return sorted((c for c, mine in zip(candidates, costs, strict=True) if not beaten(mine)), key=order)


def settle(text: str, made: list[dict], scores: list[dict], archive: list[dict], best: float, stagnant: int, stop: str | None, depth: int, s: Settings) -> dict:
    """What one document's scored candidates make of its search: the next beam, or why it ends and with which candidate."""
    risks = [x["risk"] for x in scores]
    new = [c | {"depth": depth, "risk": x["risk"], "met": bool(x["met"])} for c, x in zip(made, scores, strict=True)]
    archive = archive + new
    won = [c for c in new if c["met"]]
    if new and not best - min(risks) < s.least_gain:
        best, stagnant = min(risks), 0
    else:
        stagnant += 1
    reason = "minimum-edit success found at the shallowest successful depth" if won else stop
    if not reason:
        reason = "no fidelity-valid candidates remained" if not new else "stagnation limit reached" if stagnant >= s.stagnation else "search depth exhausted" if depth >= s.depth else None
    beam, chosen = [], None
    if not reason:
        ordered = frontier(new)
        texts = [edited(text, [(o["start"], o["end"], o["text"]) for o in c["ops"]]) for c in ordered] if len(ordered) > 1 else [""]
        beam = [ordered[i] for i in diverse(texts, s.width, s.most_alike)]
    else:
        chosen = min(won, key=order) if won else next(iter(frontier(archive)), None)
    return {"beam": beam, "archive": archive, "best": best, "stagnant": stagnant, "reason": reason, "state": None if not reason else _won(s) if won else "abstained", "chosen": chosen}


def _settled(depth: int, s: Settings):
    @F.arrow_udf(f"struct<beam:array<{CANDIDATE}>,archive:array<{CANDIDATE}>,best:double,stagnant:int,reason:string,state:string,chosen:{CANDIDATE}>")
    def run(text: pa.Array, made: pa.Array, scores: pa.Array, archive: pa.Array, best: pa.Array, stagnant: pa.Array, stop: pa.Array) -> pa.Array:
        op = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])
        real, whole = pa.float64(), pa.int32()
        kinds = {"candidate_id": pa.string(), "parent_id": pa.string(), "depth": whole, "ops": pa.list_(op), "content_hash": pa.string(), "char_ratio": real, "token_ratio": real, "drift": real, "queries": whole, "risk": real, "met": pa.bool_()}
        one = pa.struct(list(kinds.items()))
        kind = pa.struct([("beam", pa.list_(one)), ("archive", pa.list_(one)), ("best", real), ("stagnant", whole), ("reason", pa.string()), ("state", pa.string()), ("chosen", one)])
        bare = lambda c: c and {k: c[k] for k in kinds}
        out = []
        for row in zip(*(x.to_pylist() for x in (text, made, scores, archive, best, stagnant, stop)), strict=True):
            r = settle(*row, depth, s)
            out.append(r | {"beam": [bare(c) for c in r["beam"]], "archive": [bare(c) for c in r["archive"]], "chosen": bare(r["chosen"])})
        return pa.array(out, kind)

    return run


def _met(s: Settings, base: Column, score: Column) -> Column:
    return ledger.target_met(F.lit(s.mode), F.lit(s.kind), base, score, F.lit(s.threshold).cast("double"), F.lit(s.least_gain))


def _won(s: Settings) -> str:
    if s.kind == "surrogate":
        return "surrogate_reduced"
    return "verified_below_threshold" if s.mode == "verify_below_threshold" else "verified_reduction_only"


def begin(docs: DataFrame, options: Options, scorer: Scorer, s: Settings) -> DataFrame:
    """The frontier before the first round. docs: doc_id, text, regions (array of start, end, risk, in order of interest); where it has them, held (the text's spans under the settings' media type)."""
    text = F.coalesce("text", F.lit(""))
    region = lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.slice(options(F.substring(text, r["start"] + 1, r["end"] - r["start"])), 1, s.per_node).alias("options"))
    rows = docs.select("doc_id", text.alias("text"), F.transform(F.slice(F.coalesce("regions", F.array().cast("array<struct<start:int,end:int,risk:double>>")), 1, s.regions), region).alias("regions"), *(["held"] if "held" in docs.columns else []))
    asked = s.max_queries >= 1
    rows = rows.withColumns({"baseline": (scorer(F.col("text")) if asked else F.lit(None)).cast("double"), "_known": _known("text", None if "held" in docs.columns else s.media_type)})
    rows = rows.withColumns({"_hash": F.col("_known.hash"), **({} if "held" in rows.columns else {"held": F.col("_known.held")})}).drop("_known")
    base = F.col("baseline")
    unsupported = ledger.unsupported(F.lit(s.mode), F.lit(s.kind), F.array().cast("array<string>"), F.lit(s.scorer))
    met = _met(s, base, base)
    reason = (
        F.when(F.lit(not asked), exhausted("detector_queries", s.max_queries, 0)).when(unsupported.isNotNull(), unsupported).when(met, "source already met the requested target").when(F.size("regions") == 0, "localization found no editable regions")
    )
    state = F.when(F.lit(not asked), "abstained").when(unsupported.isNotNull(), "unsupported").when(met, _won(s)).when(F.size("regions") == 0, "abstained")
    zero, ops = F.lit(0.0), F.array().cast(f"array<{operations.OP}>")
    named = lambda **c: F.struct(*(v.alias(k) for k, v in c.items())).cast(CANDIDATE)
    source = named(candidate_id=F.concat(F.lit("candidate-"), F.substring("_hash", 1, 12)), parent_id=F.lit(None), depth=F.lit(0), ops=ops, content_hash=F.col("_hash"), char_ratio=zero, token_ratio=zero, drift=zero, queries=F.lit(0), risk=base, met=F.coalesce(met, F.lit(False)))
    empty = F.array().cast(f"array<{CANDIDATE}>")
    none = F.lit(0)
    made = {
        "depth": none, "beam": F.array(source), "archive": empty, "seen": F.array("_hash"), "best": base, "stagnant": none, "rounds": none, "candidates": none, "queries": F.lit(int(asked)), "proposed": none, "duplicates": none, "scored": none,
        "refused": F.array().cast("array<struct<parent_id:string,content_hash:string,operator:string,reason:string>>"), "reason": reason, "state": state, "chosen": F.when(met, source),
    }
    return rows.withColumns(made).drop("_hash")


def step(front: DataFrame, depth: int, scorer: Scorer, s: Settings) -> DataFrame:
    """One round of every document of the frontier; rows that are done carry a reason."""
    g, r = F.col("_grown"), F.col("_settled")
    rows = front.withColumn("_grown", _grown(s)("text", "regions", "beam", "seen", "candidates", "queries", "held"))
    risks = F.transform(g["made"], lambda c: scorer(c["text"]).cast("double"))  # each text is scored once, and texts don't go back to Python
    scores = F.transform(risks, lambda x: F.struct(x.alias("risk"), F.coalesce(_met(s, F.col("baseline"), x), F.lit(False)).alias("met")))
    bare = F.transform(g["made"], lambda c: F.struct(*(c[k].alias(k) for k in ("candidate_id", "parent_id", "ops", "content_hash", "char_ratio", "token_ratio", "drift", "queries"))))
    rows = rows.withColumn("_settled", _settled(depth, s)(F.col("text"), bare, scores, F.col("archive"), F.col("best"), F.col("stagnant"), g["stop"]))
    rows = rows.withColumns({
        "depth": F.lit(depth), "rounds": F.col("rounds") + 1,
        "seen": g["seen"], "candidates": g["candidates"], "queries": g["queries"], "proposed": F.col("proposed") + g["proposed"], "duplicates": F.col("duplicates") + g["duplicates"], "scored": F.col("scored") + F.size(g["made"]),
        "refused": F.concat("refused", g["refused"]), **{c: r[c] for c in ("beam", "archive", "best", "stagnant", "reason", "state", "chosen")},
    })
    return rows.select(*front.columns)


def search(docs: DataFrame, options: Options, scorer: Scorer, settings: Settings, folder: str | None = None) -> DataFrame:
    """doc_id, state, reason, depth, baseline, risk, n_ops, result, proposed, duplicates, scored, refused, rounds, candidates, queries.

    folder: where rounds are kept for a run that may be stopped; one with the
    same settings and documents goes on there. Name the scorer and its version in the settings.
    """
    spark = docs.sparkSession
    rounds = Rounds(spark, folder, asdict(settings), docs.select("doc_id", "text", "regions"))
    last = rounds.last("round", settings.depth)
    if last < 0:
        rounds.commit(begin(docs, options, scorer, settings), "round-0")
        last = 0
    for depth in range(last, settings.depth + 1):
        if not rounds.has(f"done-{depth}"):  # results of this round's leavers, without what only a search needs
            rounds.commit(_left(rounds.read(f"round-{depth}").filter("reason is not null")), f"done-{depth}")
        if depth < settings.depth:
            rounds.commit(step(rounds.read(f"round-{depth}").filter("reason is null"), depth + 1, scorer, settings), f"round-{depth + 1}")
            rounds.drop(f"round-{depth}")
    out = None
    for depth in range(settings.depth + 1):
        part = rounds.read(f"done-{depth}")
        out = part if out is None else out.unionByName(part)
    return out


def _left(rows: DataFrame) -> DataFrame:
    result = F.when(F.col("chosen").isNotNull(), operations.apply("text", "chosen.ops")).alias("result")
    return rows.select("doc_id", "state", "reason", "depth", "baseline", F.col("chosen.risk").alias("risk"), F.size("chosen.ops").alias("n_ops"), result, "proposed", "duplicates", "scored", "refused", "rounds", "candidates", "queries")


def window_regions(docs: DataFrame, spans: DataFrame | str, scorer: Scorer, size: int, stride: int, most: int) -> DataFrame:
    """doc_id, text, regions: each document's riskiest token windows (risk a token), merged, cut around its spans, without blank ones.

    spans: a table (doc_id, start, end), or a media type for what ``structure.spans`` finds in each text. Then all is made in
    the document's own row, dealt to tasks by its id and text, nothing is joined, and the spans stay in the row (held).
    """
    if isinstance(spans, str):
        rows = dealt(docs.select("doc_id", "text"), "doc_id", "text").withColumn("_w", _windows("text", size, stride, spans))
        scored = rows.withColumn("_risks", F.transform("_w.texts", lambda t: scorer(t).cast("double")))
        return scored.select("doc_id", "text", _ranked(most)(F.col("text"), *(F.col(f"_w.{c}") for c in ("starts", "ends", "tokens")), F.col("_risks"), F.col("_w.spans")).alias("regions"), F.col("_w.spans").alias("held"))
    risky = localize.windows_of(docs, size, stride, scorer).withColumn("risk", F.col("risk") / (F.col("token_end") - F.col("token_start")))
    cut = localize.clip(localize.merged(risky), spans)
    held = cut.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("risk")).alias("r"), "start", "end"))).alias("h"))
    filled = F.filter("h", lambda r: F.substring(F.col("text"), r["start"] + 1, r["end"] - r["start"]).rlike(r"\S"))
    regions = F.transform(F.slice(filled, 1, most), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), (-r["r"]).alias("risk")))
    return docs.select("doc_id", "text").join(held, "doc_id", "left").select("doc_id", "text", regions.alias("regions"))


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt to a stated number of tasks, since few bytes are much work; a file of one row group would be one task."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, F.xxhash64(*by))


def _windows(text: str, size: int, stride: int, media_type: str) -> Column:
    """``localize.windows_of`` as arrays of a row, with each window's text, and the text's protected spans."""
    if size <= 0 or stride <= 0:
        raise ValueError("window and stride must be positive")

    @F.arrow_udf("struct<starts:array<int>,ends:array<int>,tokens:array<int>,texts:array<string>," + f"spans:{HELD}>")
    def run(text: pa.Array) -> pa.Array:
        starts, ends, tokens, texts, spans, sizes, held = [], [], [], [], [], [0], [0]
        for t in text.to_pylist():
            t = t or ""
            begin, end, _ = structure.token_places(t)
            n = len(begin)
            first = np.arange(0, max(-(-(n - size) // stride), 0) + 1) * stride
            first = first[first < n]
            last = np.minimum(first + size, n)
            a, b = begin[first], end[last - 1]
            starts.append(a)
            ends.append(b)
            tokens.append(last - first)
            texts += [t[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            spans += [{"start": x, "end": y, "kind": k} for x, y, k, _ in structure.spans_of(t, media_type)]
            sizes.append(len(texts))
            held.append(len(spans))
        at = pa.array(sizes, pa.int32())
        whole = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0, np.int32), *x]), pa.int32())) for x in (starts, ends, tokens)]
        spans = pa.array(spans, pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        lists = [*whole, pa.ListArray.from_arrays(at, pa.array(texts, pa.string())), pa.ListArray.from_arrays(pa.array(held, pa.int32()), spans)]
        return pa.StructArray.from_arrays(lists, ["starts", "ends", "tokens", "texts", "spans"])

    return run(text)


#: White space of Java's regular expressions.
_BLANK = " \t\n\x0b\f\r"


def riskiest(text: str, windows: list[tuple[int, int, float | None]], spans: list[tuple[int, int]], most: int) -> list[tuple[int, int, float | None]] | None:
    """The riskiest regions of a document from its windows in their order: merged, cut around its spans, without blank ones; none if spans leave nothing."""
    cut, spans = [], sorted(spans)
    covered = list(itertools.accumulate((b for _, b in spans), max))  # where the spans so far end
    for a, b, risk in localize.joined(windows, 0.5):
        k = bisect.bisect_right(covered, a)  # spans before end at the region's start
        for s, e in spans[k:]:
            if s >= b:
                break
            if a < s:
                cut.append((a, s, risk))
            a = max(a, e)
        if a < b:
            cut.append((a, b, risk))
    # as Spark sorts risks from the greatest on: null first, NaN last
    cut.sort(key=lambda r: (0, 0.0, *r[:2]) if r[2] is None else (2, 0.0, *r[:2]) if r[2] != r[2] else (1, -r[2], *r[:2]))
    filled = (r for r in cut if text[r[0] : r[1]].strip(_BLANK))
    return list(itertools.islice(filled, most)) if cut else None


def _ranked(most: int):
    @F.arrow_udf("array<struct<start:int,end:int,risk:double>>")
    def run(text: pa.Array, starts: pa.Array, ends: pa.Array, tokens: pa.Array, risks: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, a, b, n, r, held in zip(*(x.to_pylist() for x in (text, starts, ends, tokens, risks, spans)), strict=True):
            windows = [(x, y, None if risk is None else risk / k) for x, y, k, risk in zip(a, b, n, r, strict=True)]
            found = riskiest(t or "", windows, [(s["start"], s["end"]) for s in held], most)
            out.append(None if found is None else [dict(zip(("start", "end", "risk"), f, strict=True)) for f in found])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("risk", pa.float64())])))

    return run
