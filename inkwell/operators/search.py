"""Candidate edits of marked phrases with a synthetic scorer: proposals, one shot, hops with roll-back, beam.

The search works on tables, one set of rows per round, committed before the next;
the driver only counts rounds. Scores come from a column function that the caller gives; the queries
use a synthetic one. No model is called from executors and no networked adapter
exists here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators import select
from inkwell.sources.rounds import Rounds

#: Connectives and their alternatives.
CONNECTIVES = {"However,": "Still,", "Therefore,": "Thus,", "Additionally,": "Also,", "For example,": "For instance,"}

Scorer = Callable[[Column], Column]


def proposals(phrases: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """phrases (phrase) with replacement and operator: every rule that fits, none that changes nothing."""
    p = F.col("phrase")
    op = lambda when, text, name: F.when(when, F.struct(text.alias("replacement"), F.lit(name).alias("operator")))
    upper = lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1_000_000))
    found = [op(p == a, F.lit(b), "connective") for a, b in CONNECTIVES.items()]
    found += [op(p == a, F.lit(b), "exact_phrase") for a, b in (rules or {}).items()]
    found.append(op(p.contains(" — "), F.concat(F.substring_index(p, " — ", 1), F.lit(": "), F.expr("substring(phrase, locate(' — ', phrase) + 3)")), "punctuation"))
    found.append(op(p.contains("; "), F.concat(F.substring_index(p, "; ", 1), F.lit(". "), upper(F.expr("substring(phrase, locate('; ', phrase) + 2)"))), "sentence_split"))
    found.append(op(p.rlike(r"(?s)^.+?\. However, .+$"), F.regexp_replace(p, r"(?s)^(.+?)\. However, (.+)$", "$1; however, $2"), "sentence_merge"))
    reorder = r"(?s)^Although (.+?), (.+?)([.!?])$"
    turned = F.concat(upper(F.regexp_extract(p, reorder, 2)), F.lit(", although "), F.regexp_extract(p, reorder, 1), F.regexp_extract(p, reorder, 3))
    found.append(op(p.rlike(reorder), turned, "clause_reorder"))
    out = phrases.select("*", F.explode(F.array_distinct(F.array_compact(F.array(*found)))).alias("o")).select(*phrases.columns, "o.*")
    return out.filter("replacement <> phrase")


def candidates(docs: DataFrame, options: DataFrame) -> DataFrame:
    """doc_id, idx, text, result and measures from options (doc_id, start, end, replacement)."""
    j = docs.select("doc_id", "text").join(options, "doc_id")
    result = F.concat(F.substring(F.col("text"), F.lit(1), F.col("start")), F.col("replacement"), F.substring(F.col("text"), F.col("end") + 1, F.length("text")))
    n = F.greatest(F.length("text"), F.lit(1))
    j = j.withColumn("result", result).withColumns(
        {"char_ratio": F.least(F.lit(1.0), F.greatest(F.col("end") - F.col("start"), F.length("replacement")) / n), "drift": F.abs(F.length("result") - F.length("text")) / n, "content_hash": F.sha2("result", 256)}
    )
    w = Window.partitionBy("doc_id").orderBy("start", "end", "replacement")
    return j.withColumn("idx", F.row_number().over(w))


def scored(rows: DataFrame, scorer: Scorer, threshold: float, limits: tuple[float, float] = (0.2, 0.1)) -> DataFrame:
    """Candidates with valid, risk and target_met; a scorer runs on what the cheap gates let through."""
    valid = (F.col("char_ratio") <= limits[0]) & (F.col("drift") <= limits[1])
    r = rows.withColumn("valid", valid).withColumn("risk", F.when(valid, scorer(F.col("result"))))
    return r.withColumns({"target_met": F.coalesce(F.col("risk") <= threshold, F.lit(False)), "token_ratio": F.col("char_ratio"), "model_calls": F.lit(0), "detector_queries": F.lit(1), "cost_usd": F.lit(0.0), "n_ops": F.lit(1)})


def one_shot(docs: DataFrame, options: DataFrame, scorer: Scorer, threshold: float) -> DataFrame:
    """The best valid candidate of each document: doc_id, idx, result, risk, target_met."""
    return select.best(scored(candidates(docs, options), scorer, threshold)).select("doc_id", "idx", "result", "risk", "target_met")


def hops(docs: DataFrame, step: Callable[[DataFrame, int], DataFrame | Column], scorer: Scorer, most: int = 3, patience: int = 1, threshold: float | None = None, folder: str | None = None, settings: dict | None = None) -> DataFrame:
    """doc_id, hop, text, risk, baseline, hops_run, met, reason: hop after hop from the best text so far.

    step(docs, hop) gives each document's next text, as a table (doc_id, text) or, where it follows from the text alone, as a
    column over docs, which spares the shuffle that brings both texts together; it may take another style for each hop. A
    text that isn't better is rolled back. A document stops when its risk is at most
    the threshold, or after ``patience`` hops in a row without gain. Each hop's state is
    committed, so plans stay as long as one hop, and a run with a folder and equal settings goes on where one was stopped.
    """
    met = lambda risk: F.coalesce(risk <= F.lit(threshold).cast("double"), F.lit(False))
    limits = {"most": most, "patience": patience, "threshold": threshold, **(settings or {})}
    rounds = Rounds(docs.sparkSession, folder, limits, docs.select("doc_id", "text"))
    last = rounds.last("hop", most)
    if last < 0:
        first = docs.select("doc_id", "text").withColumn("baseline", scorer(F.col("text")).cast("double"))
        reason = F.when(met(F.col("baseline")), "source already met the requested target")
        rounds.commit(first.withColumns({"risk": F.col("baseline"), "hop": F.lit(0), "idle": F.lit(0), "hops_run": F.lit(0), "reason": reason}), "hop-0")
        last = 0
    left = lambda hop: rounds.read(f"hop-{hop}").filter("reason is not null" if most else "true").drop("idle")
    for hop in range(last, most):
        if not rounds.has(f"done-{hop}"):
            rounds.commit(left(hop), f"done-{hop}")
        front = rounds.read(f"hop-{hop}").filter("reason is null")
        nxt = step(front.select("doc_id", "text"), hop + 1)
        if isinstance(nxt, Column):
            j = front.withColumn("n_text", nxt)
        else:
            j = front.join(nxt.select("doc_id", F.col("text").alias("n_text")), "doc_id", "left")
        j = j.withColumn("n_risk", scorer(F.col("n_text")).cast("double"))
        better = F.coalesce(F.col("n_risk") < F.col("risk"), F.lit(False))
        pick = lambda a, b, better=better: F.when(better, a).otherwise(b)
        j = j.select(
            "doc_id", pick(F.col("n_text"), F.col("text")).alias("text"), "baseline", pick(F.col("n_risk"), F.col("risk")).alias("risk"),
            pick(F.lit(hop + 1), F.col("hop")).alias("hop"), pick(F.lit(0), F.col("idle") + 1).alias("idle"), F.lit(hop + 1).alias("hops_run"),
        )
        reason = F.when(met(F.col("risk")), "requested target met; stopping early").when(F.col("idle") >= patience, "stagnation limit reached; stopping early").when(F.lit(hop + 1 == most), "hop schedule exhausted")
        rounds.commit(j.withColumn("reason", reason), f"hop-{hop + 1}")
        rounds.drop(f"hop-{hop}")
    out = left(most)  # the last hop's state stands as it is, every document in it is done
    for hop in range(most):
        out = out.unionByName(rounds.read(f"done-{hop}"))
    return out.select("doc_id", "hop", "text", "risk", "baseline", "hops_run", met(F.col("risk")).alias("met"), "reason")


def structured(completions: DataFrame, allowed: tuple[str, ...], limit: int) -> DataFrame:
    """doc_id, region, place, replacement, operator, rank, refusal of every completion.

    completions: doc_id, region, place (its order), phrase (the region's text), completion. One must be a JSON object of
    nothing but ``replacement`` and ``operator``, both texts; the refusal says what is wrong. Of
    equal replacements by one operator in a region the last one stands, the others are repeated. What stands is
    ranked by operator and replacement, and beyond the limit of a region is over the limit. No model is called here.
    """
    # text behind a value is passed over by the parser: within a list and an object it isn't
    within = lambda a, b: F.try_parse_json(F.concat(F.lit(a), "completion", F.lit(b)))
    v = F.when(within("[", "]").isNotNull() & within('{"c":', "}").isNotNull(), F.try_parse_json("completion"))
    rows = completions.select("doc_id", "region", "place", "phrase", v.alias("v"))
    rows = rows.withColumn("kind", F.schema_of_variant("v"))
    text = lambda name: F.when(F.col("kind") == "OBJECT<operator: STRING, replacement: STRING>", F.try_variant_get("v", f"$.{name}", "string"))
    rows = rows.withColumns({"replacement": text("replacement"), "operator": text("operator")})
    refusal = (
        F.when(F.col("v").isNull(), "not JSON").when(~F.col("kind").startswith("OBJECT<"), "not an object").when(F.col("replacement").isNull(), "not the two fields")
        .when(F.col("replacement") == "", "empty replacement").when(F.col("replacement") == F.col("phrase"), "no change").when(~F.col("operator").isin(*allowed), "operator not allowed")
    )
    rows = rows.select("doc_id", "region", "place", "replacement", "operator", refusal.alias("refusal"))
    key = ["doc_id", "region", "operator", "replacement"]
    last = Window.partitionBy(*key, F.col("refusal").isNull()).orderBy(F.desc("place"))
    rows = rows.withColumn("_n", F.row_number().over(last)).withColumn("refusal", F.when(F.col("refusal").isNull() & (F.col("_n") > 1), "repeated").otherwise(F.col("refusal")))
    order = Window.partitionBy("doc_id", "region", F.col("refusal").isNull()).orderBy("operator", "replacement")
    rows = rows.withColumn("rank", F.when(F.col("refusal").isNull(), F.row_number().over(order)))
    return rows.withColumn("refusal", F.when(F.col("rank") > limit, "over the limit").otherwise(F.col("refusal"))).drop("_n")


def beam(docs: DataFrame, phrases: list[tuple[str, str]], scorer: Scorer, width: int = 4, depth: int = 2, folder: str | None = None) -> DataFrame:
    """doc_id, depth, result, risk: each depth replaces one more phrase, drops repeats, keeps the skyline's best ``width``.

    Texts of a document meet in one row, where its candidates grow, so each is made and scored once. Each depth is
    committed and the next one starts from it.
    """
    settings = {"phrases": phrases, "width": width, "depth": depth}
    rounds = Rounds(docs.sparkSession, folder, settings, docs.select("doc_id", "text"))
    out = docs.select("doc_id", F.lit(0).alias("depth"), F.lit(0).alias("n_ops"), F.col("text").alias("result"), scorer(F.col("text")).alias("risk"))
    text = F.col("text")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number is not coalesced: few bytes become many texts
    front = docs.select("doc_id", "text").filter("text is not null").repartition(tasks, "doc_id").groupBy("doc_id").agg(F.collect_list(F.struct(text.alias("source"), text.alias("result"))).alias("front"))
    for d in range(1, depth + 1):
        name = f"beam-{d}"
        if not rounds.has(name):
            rounds.commit(_grown_beam(front, phrases, scorer, width), name)
        front = rounds.read(name)
        each = front.select("doc_id", F.explode("front").alias("c"))
        out = out.unionByName(each.select("doc_id", F.lit(d).alias("depth"), F.lit(d).alias("n_ops"), "c.result", "c.risk"))
    return out


def _grown_beam(rows: DataFrame, phrases: list[tuple[str, str]], scorer: Scorer, width: int) -> DataFrame:
    """doc_id and the next front of each row. A document without an id has no rival on the skyline, as null equals nothing."""

    def grown(x: Column) -> Column:
        source, result = x["source"], x["result"]

        def one(a: str, b: str) -> Column:
            place = F.instr(result, a)
            new = F.concat(F.substring(result, F.lit(1), place - 1), F.lit(b), F.substring(result, place + len(a), F.length(result)))
            return F.when(place > 0, F.struct(source.alias("source"), new.alias("result")))

        return F.array_compact(F.array(*(one(a, b) for a, b in phrases)))

    def judged(c: Column) -> Column:
        drift = F.abs(F.length(c["result"]) - F.length(c["source"])) / F.greatest(F.length(c["source"]), F.lit(1))
        return F.struct(scorer(c["result"]).alias("risk"), drift.alias("drift"), F.sha2(c["result"], 256).alias("content_hash"), c["source"].alias("source"), c["result"].alias("result"))

    # scored in a lambda whose argument is bound once: as columns of their own these would be put into each other, and made again for every rival
    beats = lambda o, c: (o["risk"] <= c["risk"]) & (o["drift"] <= c["drift"]) & ((o["risk"] < c["risk"]) | (o["drift"] < c["drift"]))
    kept = lambda g: F.filter(g, lambda c: F.col("doc_id").isNull() | ~F.exists(g, lambda o: F.coalesce(beats(o, c), F.lit(False))))
    best = lambda g: F.slice(F.array_sort(kept(g)), 1, width)
    made = F.transform(F.array_distinct(F.flatten(F.transform("front", grown))), judged)
    return rows.select("doc_id", F.get(F.transform(F.array(made), best), F.lit(0)).alias("front"))  # an empty front ends the document
