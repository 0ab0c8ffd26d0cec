"""Reports: one nested row a document, as JSON or text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators import inspect, sanitize, structure


def _counts(rows: DataFrame, name: str) -> DataFrame:
    g = rows.groupBy("doc_id", "kind").count()
    return g.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "count")))).alias(name))


def inspection(docs: DataFrame, policy: inspect.UnicodePolicy | None = None, media_type: str = "text/plain") -> DataFrame:
    """doc_id, report: summary, scripts, counts of blocks, spans and findings, as JSON."""
    base = inspect.summary(docs).join(inspect.scripts(docs), "doc_id")
    found = inspect.findings(docs, policy)
    for rows, name in ((structure.blocks(docs, media_type), "blocks"), (structure.spans(docs, media_type), "spans"), (found, "findings")):
        base = base.join(_counts(rows, name), "doc_id", "left")
    removable = found.groupBy("doc_id").agg(F.count_if(F.col("removable")).alias("removable"), F.count_if(~F.col("removable")).alias("preserved"))
    base = base.join(removable, "doc_id", "left").fillna(0, ["removable", "preserved"])
    return base.select("doc_id", F.to_json(F.struct(*[c for c in base.columns if c != "doc_id"])).alias("report"))


def edits(docs: DataFrame, policy: inspect.UnicodePolicy | None = None) -> DataFrame:
    """doc_id, report: what sanitation changed, as JSON."""
    s = sanitize.sanitize(docs, policy)
    return s.select("doc_id", F.to_json(F.struct(F.sha2("text", 256).alias("before"), F.sha2("clean", 256).alias("after"), F.size("ops").alias("n_ops"), "edit_ratio", "length_drift", F.slice("ops", 1, 40).alias("ops"))).alias("report"))


def prompt(docs: DataFrame, style: str = "plain", strength: str = "medium", locks: tuple[str, ...] = (), voice: str = "") -> DataFrame:
    """doc_id, prompt: a request to rewrite each document; sent by nobody here."""
    rules = ["Keep every fact, number, name, date, link and quotation.", "Keep the order of paragraphs and their kinds.", "Return the text alone."]
    how = {"light": "Change single words only.", "medium": "Sentences may be rephrased.", "strong": "Sentences may be split, joined and rephrased."}
    if strength not in how:
        raise ValueError(f"unknown strength {strength}")
    head = "\n".join([f"Rewrite the text below in a {style} style. {how[strength]}", *rules, *(f"Leave unchanged: {x}" for x in locks), *([f"Voice: {voice}"] if voice else []), "Text:"])
    return docs.select("doc_id", F.concat(F.lit(head + "\n"), "text").alias("prompt"))
