"""Sanitation: findings become operations, operations become clean texts with a record of each change.

Carriers are removed or replaced by their verdicts; the result's combining
clusters are then composed (NFC or NFKC), cluster by cluster, outside protected
spans. Documents without anything notable and without combining marks pass
through untouched and never reach Python.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import ucd
from inkwell.operators import inspect, operations, structure

#: What a form can change: NFC nothing of Latin-1, NFKC nothing of ASCII.
_BEYOND = {"NFC": r"[^\x00-\x{FF}]", "NFKC": r"[^\x00-\x7F]"}
#: The same for Python: runs of such characters.
_RUNS = {"NFC": re.compile(r"[^\x00-\xFF]+"), "NFKC": re.compile(r"[^\x00-\x7F]+")}


def runs_of(text: str, form: str) -> list[tuple[int, int]]:
    """Where the runs of characters stand that the form can change, with the one before each, which they may belong to."""
    return [(max(m.start() - 1, 0), m.end()) for m in _RUNS[form].finditer(text)]


def clusters(text: str, form: str, held: list[tuple[int, int]], edits: list[tuple[int, int, str]], runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, str]]:
    """Compose clusters (a character and its combining marks) after the edits inside them; sorted operations.

    Only runs of characters that the form can change, with the character before
    each, are walked; edits elsewhere go on as they are.
    """
    out: list[tuple[int, int, str]] = []
    todo, spans = sorted(edits), sorted(held)
    k = s = 0
    for at, last in runs_of(text, form) if runs is None else runs:
        while k < len(todo) and todo[k][0] < at:
            out.append(todo[k])
            k += 1
        while at < last:
            end = at + 1
            while end < last and unicodedata.combining(text[end]):
                end += 1
            mine = []
            while k < len(todo) and todo[k][0] < end:
                mine.append(todo[k])
                k += 1
            while s < len(spans) and spans[s][1] <= at:
                s += 1
            source = text[at:end]
            if any(a < end and at < b for a, b in spans[s : s + 1]) or unicodedata.is_normalized(form, source):
                out += mine
            else:
                clean, place = [], at
                for a, b, t in mine:
                    clean += [text[place:a], t]
                    place = b
                composed = unicodedata.normalize(form, "".join([*clean, text[place:end]]))
                if composed != source:
                    out.append((at, end, composed))
            at = end
    return out + todo[k:]


def _compose(form: str):
    """From a text, several lists of edits and its spans: each list with its clusters composed; the text is walked once for all of them."""
    kind = pa.list_(pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])))

    @F.arrow_udf(f"array<array<{operations.OP}>>")
    def run(text: pa.Array, ops: pa.Array, held: pa.Array) -> pa.Array:
        out = []
        for t, every, kept in zip(text, ops.to_pylist(), held.to_pylist(), strict=True):
            if not t.is_valid:
                out.append(None)
                continue
            whole = t.as_py()
            runs, spans = runs_of(whole, form), [(h["start"], h["end"]) for h in kept or ()]
            done: list[tuple[list, list]] = []  # lists of edits so far and what became of them
            for changes in every:
                edits = [(o["start"], o["end"], o["text"]) for o in changes or ()]
                composed = next((c for e, c in done if e == edits), None)
                if composed is None:
                    composed = [dict(zip(("start", "end", "text"), c, strict=True)) for c in clusters(whole, form, spans, edits, runs)]
                done.append((edits, composed))
            out.append([c for _, c in done])
        return pa.array(out, kind)

    return run


def carrier_ops(text: Column, policy: inspect.UnicodePolicy) -> Column:
    """The sorted carrier edits of a text, without protected spans; no shuffle, no join."""
    return _ops_of(inspect.carriers(text), policy)


def _ops_of(carriers: Column, policy: inspect.UnicodePolicy) -> Column:
    if not policy.mutates:
        return F.array().cast(f"array<{operations.OP}>")
    judged = F.transform(carriers, lambda x: F.struct(x["offset"].alias("at"), inspect.verdict(x, policy).alias("v")))
    wanted = F.filter(judged, lambda x: F.coalesce(x["v"]["removable"] & x["v"]["replacement"].isNotNull(), F.lit(False)))
    return F.transform(wanted, lambda x: F.struct(x["at"].alias("start"), (x["at"] + 1).alias("end"), x["v"]["replacement"].alias("text")))


def edits(docs: DataFrame, policy: inspect.UnicodePolicy | None = None, held: DataFrame | None = None) -> DataFrame:
    """doc_id, start, end, text, operator of every carrier edit outside protected spans."""
    policy = policy or inspect.UnicodePolicy()
    found = inspect.findings(docs, policy).filter("removable and replacement is not null")
    if not policy.mutates:
        found = found.filter(F.lit(False))
    rows = found.select("doc_id", F.col("offset").alias("start"), (F.col("offset") + 1).alias("end"), F.col("replacement").alias("text"), F.concat(F.lit("unicode:"), "kind").alias("operator"))
    return rows if held is None else structure.outside_spans(rows, held)


def blocked(docs: DataFrame, held: DataFrame, policy: inspect.UnicodePolicy | None = None) -> DataFrame:
    """Removable findings that a protected span keeps."""
    found = inspect.findings(docs, policy).filter("removable and replacement is not null")
    return structure.inside_spans(found.withColumns({"start": F.col("offset"), "end": F.col("offset") + 1}), held).drop("start", "end")


def sanitize(docs: DataFrame, policy: inspect.UnicodePolicy | None = None, held: DataFrame | None = None) -> DataFrame:
    """doc_id, text, ops, clean, edit_ratio, length_drift of every document.

    Without protected spans each row is done where it stands; with them, the
    edits and spans of a document meet its text in one shuffle on doc_id.
    """
    policy = policy or inspect.UnicodePolicy()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if held is None:
        rows = rows.withColumns({"ops": carrier_ops(F.col("text"), policy), "held": F.lit(None).cast("array<struct<start:int,end:int>>")})
    else:
        place = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
        ops, spans = operations.collect(edits(rows, policy, held)), held.groupBy("doc_id").agg(F.collect_list(place).alias("held"))
        rows = rows.join(ops, "doc_id", "left").join(spans, "doc_id", "left")
    if policy.mutates and policy.normalization_form != "none":
        needs = F.col("text").rlike(_BEYOND[policy.normalization_form])
        composed = _compose(policy.normalization_form)(F.when(needs, F.col("text")), F.when(needs, F.array("ops")), F.when(needs, F.col("held")))
        rows = rows.withColumn("ops", F.coalesce(F.get(composed, F.lit(0)), "ops"))
    rows = rows.withColumn("ops", F.coalesce("ops", F.array().cast(f"array<{operations.OP}>"))).drop("held")
    rows = rows.withColumn("clean", operations.apply("text", "ops"))
    return rows.withColumns({"edit_ratio": operations.edit_ratio("text", "ops"), "length_drift": operations.length_drift("text", "clean")})


def all_policies(docs: DataFrame) -> DataFrame:
    """doc_id, policy, n_ops, clean under each of the four policies.

    A text is read, searched for carriers and handed to Python once; each policy has its verdicts on the same carriers.
    """
    policies = [inspect.UnicodePolicy(name=name) for name in ("report", "safe", "typographic", "aggressive")]
    form = policies[0].normalization_form
    none = F.array().cast(f"array<{operations.OP}>")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    every = F.transform(F.array(inspect.carriers(F.col("text"))), lambda c: F.array(*(_ops_of(c, p) for p in policies if p.mutates)))
    rows = rows.withColumn("every", F.get(every, F.lit(0)))
    needs = F.col("text").rlike(_BEYOND[form])
    composed = _compose(form)(F.when(needs, F.col("text")), F.when(needs, F.col("every")), F.lit(None).cast("array<struct<start:int,end:int>>"))
    rows = rows.withColumn("every", F.coalesce(composed, "every"))
    changing = iter(range(len(policies)))
    ops = [F.coalesce(F.get("every", F.lit(next(changing))), none) if p.mutates else none for p in policies]
    each = F.explode(F.array(*(F.struct(F.lit(p.name).alias("policy"), o.alias("ops")) for p, o in zip(policies, ops, strict=True))))
    rows = rows.select("doc_id", "text", each.alias("p")).select("doc_id", "text", "p.*")
    return rows.select("doc_id", "policy", F.size("ops").alias("n_ops"), operations.apply("text", "ops").alias("clean"))


def needs_work(docs: DataFrame) -> DataFrame:
    """Documents that hold anything the scan has a word on."""
    return docs.filter(F.col("text").rlike(f"[{ucd.notable_class()}]"))
