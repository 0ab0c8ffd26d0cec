"""Source-anchored edits: validate, apply, invert, measure; all folds over sorted arrays in the JVM.

An operation is struct(start, end, text); offsets are code points of the
original, half open. ``ops`` columns are arrays of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OP = "struct<start:int,end:int,text:string>"


def collect(edits: DataFrame) -> DataFrame:
    """doc_id, ops (sorted) from rows doc_id, start, end, text."""
    return edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "text"))).alias("ops"))


#: Operations from which on a text is cut from blocks.
MANY = 16


SIZE = 512


def blocks(text: Column) -> Column:
    """A text in pieces of ``SIZE`` code points, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SIZE}}}"), 0)


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """The text between two offsets, from its blocks: a piece costs its own length and not its distance from the start."""
    size = SIZE
    i, j = F.floor(start / size).cast("int"), F.floor(end / size).cast("int")
    one = F.substring(F.get(blocks, i), start % size + 1, end - start)
    first, last = F.substring(F.get(blocks, i), start % size + 1, F.lit(size)), F.substring(F.get(blocks, j), F.lit(1), end % size)
    more = F.concat(first, F.array_join(F.slice(blocks, i + 2, j - i - 1), ""), F.coalesce(last, F.lit("")))
    return F.when(end <= start, F.lit("")).when(i == j, one).otherwise(more)


def apply(text: str | Column, ops: str | Column) -> Column:
    """The text with its sorted operations carried out, in a time in proportion to the text and its operations."""
    t, o = (F.col(c) if isinstance(c, str) else c for c in (text, ops))
    end_of = lambda i: F.coalesce(F.get(o, i)["end"], F.lit(0))
    part = lambda x, i: F.concat(F.substring(t, end_of(i - 1) + 1, x["start"] - end_of(i - 1)), x["text"])
    few = F.concat(F.array_join(F.transform(o, part), ""), F.substring(t, end_of(F.size(o) - 1) + 1, F.length(t)))

    def joined(p):
        end = lambda i: F.coalesce(F.get(p["ops"], i)["end"], F.lit(0))
        parts = F.transform(p["ops"], lambda x, i: F.concat(cut(p["blocks"], end(i - 1), x["start"]), x["text"]))
        return F.concat(F.array_join(parts, ""), cut(p["blocks"], end(F.size(p["ops"]) - 1), p["n"]))

    bound = F.array(F.struct(blocks(t).alias("blocks"), o.alias("ops"), F.length(t).alias("n")))
    return F.when(o.isNull() | (F.size(o) == 0), t).when(F.size(o) <= MANY, few).otherwise(F.get(F.transform(bound, joined), F.lit(0)))


def invert(text: str | Column, ops: str | Column) -> Column:
    """Operations that turn the result back into the text; insertions that meet at one offset are one."""
    t, o = (F.col(c) if isinstance(c, str) else c for c in (text, ops))
    empty = F.array().cast(f"array<{OP}>")
    start = F.struct(empty.alias("out"), F.lit(0).alias("drift"))

    def step(a, x):
        at = x["start"] + a["drift"]
        source = F.substring(t, x["start"] + 1, x["end"] - x["start"])
        end = at + F.length(x["text"])
        before = F.try_element_at(a["out"], F.lit(-1))
        meets = F.coalesce((at == end) & (before["start"] == at) & (before["end"] == at), F.lit(False))
        kept = F.when(meets, F.slice(a["out"], F.lit(1), F.greatest(F.size(a["out"]) - 1, F.lit(0)))).otherwise(a["out"])
        back = F.struct(at.alias("start"), end.alias("end"), F.concat(F.when(meets, before["text"]).otherwise(F.lit("")), source).alias("text"))
        nothing = (at == end) & (F.length(source) == 0)
        return F.struct(F.when(nothing, a["out"]).otherwise(F.concat(kept, F.array(back))).alias("out"), (a["drift"] + F.length(x["text"]) - x["end"] + x["start"]).alias("drift"))

    return F.aggregate(o, start, step)["out"]


def violations(rows: DataFrame) -> DataFrame:
    """Rows of doc_id, text, start, end, original, replacement that can't be applied, with the reason."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("start", "end", "replacement")
    r = rows.withColumns({"before": F.lag("end").over(w), "before_start": F.lag("start").over(w)})
    insert = F.col("start") == F.col("end")
    reason = (
        F.when((F.col("start") < 0) | (F.col("end") < F.col("start")) | (F.col("end") > F.length("text")), "out_of_bounds")
        .when(F.col("original").isNotNull() & (F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")) != F.col("original")), "original_mismatch")
        .when(insert & (F.col("replacement") == ""), "no_op")
        .when(insert & (F.col("before_start") == F.col("start")) & (F.col("before") == F.col("end")), "duplicate_insertion")
        .when(F.col("before") > F.col("start"), "overlap")
    )
    return r.withColumn("reason", reason).filter("reason is not null").select("doc_id", "start", "end", "reason")


def edit_ratio(text: str | Column, ops: str | Column) -> Column:
    """Characters touched over the length of the text, at most 1."""
    t, o = (F.col(c) if isinstance(c, str) else c for c in (text, ops))
    touched = F.aggregate(o, F.lit(0), lambda a, x: a + F.greatest(x["end"] - x["start"], F.length(x["text"])))
    return F.when(o.isNull() | (F.size(o) == 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), touched / F.greatest(F.length(t), F.lit(1))))


def length_drift(text: str | Column, result: str | Column) -> Column:
    t, r = (F.col(c) if isinstance(c, str) else c for c in (text, result))
    return F.abs(F.length(r) - F.length(t)) / F.greatest(F.length(t), F.lit(1))


def mapped_offset(offset: Column, ops: Column) -> Column:
    """Where an offset of the original stands in the result."""
    return offset + F.aggregate(F.filter(ops, lambda x: x["end"] <= offset), F.lit(0), lambda a, x: a + F.length(x["text"]) - (x["end"] - x["start"]))
