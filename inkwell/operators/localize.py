"""Regions of interest: token windows, ranking, merging, and cutting around protected spans.

Interval work is a sweep: a document's spans and regions become one stream in the
order of their starts, so its time is that of the sort.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators import operations, structure

REGION = "struct<start:int,end:int,risk:double>"


def token_windows(tokens: DataFrame, size: int, stride: int) -> DataFrame:
    """doc_id, window, token_start, token_end, start, end over tokens (doc_id, index, start, end); the last window is the first to reach the end."""
    if size <= 0 or stride <= 0:
        raise ValueError("window and stride must be positive")
    arrays = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("index", "start", "end"))).alias("t")).withColumn("n", F.size("t"))
    last = F.greatest(F.ceil((F.col("n") - size) / F.lit(stride)), F.lit(0)).cast("int")
    rows = arrays.withColumn("window", F.explode(F.sequence(F.lit(0), last))).withColumn("token_start", F.col("window") * stride)
    rows = rows.withColumn("token_end", F.least(F.col("token_start") + size, F.col("n"))).filter("token_start < n")
    return rows.select("doc_id", "window", "token_start", "token_end", F.get("t", F.col("token_start"))["start"].alias("start"), F.get("t", F.col("token_end") - 1)["end"].alias("end"))


def windows_of(docs: DataFrame, size: int, stride: int, scorer=None) -> DataFrame:
    """``token_windows`` of the runs of non-space characters of each document, in its own row; with a scorer also the risk of each window's text."""
    if size <= 0 or stride <= 0:
        raise ValueError("window and stride must be positive")
    rows = docs.select("doc_id", "text", structure.places("text").alias("p")).withColumn("n", F.size("p.starts"))
    last = F.greatest(F.ceil((F.col("n") - size) / F.lit(stride)), F.lit(0)).cast("int")

    def window(bound: Column, w: Column) -> Column:
        first, end = w * stride, F.least(w * stride + size, bound["n"])
        a, b = F.get(bound["starts"], first), F.get(bound["ends"], end - 1)
        fields = [w.alias("window"), first.alias("token_start"), end.alias("token_end"), a.alias("start"), b.alias("end")]
        return F.struct(*fields, *([] if scorer is None else [scorer(operations.cut(bound["blocks"], a, b)).alias("risk")]))

    blocks = F.array().cast("array<string>") if scorer is None else operations.blocks(F.col("text"))
    bound = F.array(F.struct(F.col("n"), F.col("p.starts").alias("starts"), F.col("p.ends").alias("ends"), blocks.alias("blocks")))
    made = F.get(F.transform(bound, lambda x: F.transform(F.sequence(F.lit(0), last), lambda w: window(x, w))), F.lit(0))
    made = F.filter(made, lambda w: w["token_start"] < F.col("n"))  # a stride beyond the size may step over the end
    return rows.filter("n > 0").select("doc_id", F.explode(made).alias("w")).select("doc_id", "w.*")


def merge(regions: str | Column, share: float = 0.5) -> Column:
    """A sorted array of regions with those merged that cover at least a share of the smaller one; a fold, as extents grow."""
    r = F.col(regions) if isinstance(regions, str) else regions
    empty = F.array().cast(f"array<{REGION}>")

    def step(a, x):
        p = F.try_element_at(a, F.lit(-1))
        shared = F.greatest(F.lit(0), F.least(p["end"], x["end"]) - F.greatest(p["start"], x["start"]))
        smaller = F.least(p["end"] - p["start"], x["end"] - x["start"])
        joined = F.struct(F.least(p["start"], x["start"]).alias("start"), F.greatest(p["end"], x["end"]).alias("end"), F.greatest(p["risk"], x["risk"]).alias("risk"))
        hit = (F.size(a) > 0) & (smaller > 0) & (shared / smaller >= share)
        return F.when(hit, F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(F.array_sort(r.cast(f"array<{REGION}>")), empty, step)


def joined(regions: Iterable[tuple], share: float) -> Iterator[tuple]:
    """(start, end, risk) of one document in their order, with those merged that cover at least a share of the smaller one."""
    held = None
    for s, e, r in regions:
        if held:
            start, end, risk = held
            smaller = min(end - start, e - s)
            if smaller > 0 and max(0, min(end, e) - max(start, s)) / smaller >= share:
                held = min(start, s), max(end, e), r if risk is None else risk if r is None else max(risk, r)
                continue
            yield held
        held = s, e, r
    if held:
        yield held


def merged(regions: DataFrame, share: float = 0.5) -> DataFrame:
    """Regions (doc_id, start, end, risk) with those merged that cover at least a share of the smaller one.

    Regions of a document come as a stream in their order; only the one that may
    still grow is held. The merged region has the greatest risk of its parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, start, end, risk, held = None, 0, 0, None, False
        for batch in batches:
            out = []
            for d, s, e, r in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and d == doc:
                    smaller = min(end - start, e - s)
                    if smaller > 0 and max(0, min(end, e) - max(start, s)) / smaller >= share:
                        start, end = min(start, s), max(end, e)
                        risk = r if risk is None else risk if r is None else max(risk, r)
                        continue
                if held:
                    out.append((doc, start, end, risk))
                doc, start, end, risk, held = d, s, e, r, True
            yield _rows(out, batch)
        if held:
            yield _rows([(doc, start, end, risk)], batch)

    rows = regions.select("doc_id", F.col("start").cast("int"), F.col("end").cast("int"), F.col("risk").cast("double"))
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "start", "end", "risk").mapInArrow(run, rows.schema)


def clip(regions: DataFrame, spans: DataFrame) -> DataFrame:
    """Regions (doc_id, start, end, risk) minus the document's spans, which may overlap; an empty span cuts a region in two.

    Regions and spans of a document come as one stream by their starts. Only the end of
    what spans cover so far and the regions that are still open are held; each stretch without
    a span goes to these. A region without a document id has no spans, as null equals nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, covered, open_, out, room = None, _START, [], [], _OPEN
        for batch in batches:
            for d, s, e, risk, region in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if d != doc:
                    out += [(doc, max(a, covered), b, r) for a, b, r in open_ if b > covered]
                    doc, covered, open_ = d, _START, []
                if region:
                    if len(open_) >= room:  # what ends before here meets no further span
                        out += [(d, max(a, covered), b, r) for a, b, r in open_ if covered < b <= s]
                        open_ = [x for x in open_ if x[1] > s]
                        room = max(_OPEN, 2 * len(open_))
                    if e > covered:
                        open_.append((s, e, risk))
                    continue
                if s > covered:
                    for a, b, r in open_:
                        first, last = max(a, covered), min(b, s)
                        if first < last:
                            out.append((d, first, last, r))
                    open_ = [x for x in open_ if x[1] > s]
                covered = max(covered, e)
            yield _rows(out, batch)
            out = []
        out = [(doc, max(a, covered), b, r) for a, b, r in open_ if b > covered]
        if out:
            yield _rows(out, batch)

    place = [F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")]
    asked = regions.filter("start < end").select("doc_id", *place, F.col("risk").cast("double").alias("risk"), F.lit(True).alias("region"))
    held = spans.filter("doc_id is not null and start is not null and end is not null").select("doc_id", *place, F.lit(None).cast("double").alias("risk"), F.lit(False).alias("region"))
    both = asked.unionByName(held)
    # a stated number is not coalesced, as few bytes of a shuffle are many rows to sort; by a hash, as a repartition by the key may be left out behind a join
    spark = both.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return both.repartition(tasks, F.xxhash64("doc_id")).sortWithinPartitions("doc_id", "start").mapInArrow(run, both.drop("region").schema)


#: Before every offset; open regions from which on those that have ended are given out.
_START, _OPEN = -(1 << 31), 64


def _rows(rows: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
    """doc_id, start, end, risk in the types of a batch."""
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), like.schema.field(i).type) for i, c in enumerate(columns)], names=["doc_id", "start", "end", "risk"])


def span_index(spans: Column, offset: Column) -> Column:
    """The number (from 0) of the span (start, end) that holds an offset, or null: binary search in a sorted array of disjoint spans."""
    at = _before(spans, offset + 1, "start") - 1
    return F.when(F.get(spans, at)["end"] > offset, at)


def _before(spans: Column, value: Column, field: str) -> Column:
    """How many of the sorted spans have a field below a value."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans) + F.lit(1.0))).cast("int") + 1)
    start = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))

    def step(a, _):
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        low = F.coalesce(F.get(spans, mid)[field] < value, F.lit(False)) & (a["lo"] < a["hi"])
        return F.struct(F.when(low, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(low, a["hi"]).otherwise(F.least(mid, a["hi"])).alias("hi"))

    return F.aggregate(steps, start, step)["lo"]


def overlapping(spans: Column, start: Column, end: Column) -> Column:
    """The spans of a sorted array of disjoint ones that an edit overlaps; an insertion overlaps a span that it stands strictly inside of."""
    first, last = _before(spans, start + 1, "end"), _before(spans, F.greatest(end, start), "start")
    return F.slice(spans, first + 1, F.greatest(last - first, F.lit(0)))


def is_protected(spans: Column, start: Column, end: Column) -> Column:
    return F.size(overlapping(spans, start, end)) > 0


def eligible_region(regions: Column, ops: Column) -> Column:
    """The number (from 0) of the first region that no operation touches, or null."""
    free = F.transform(regions, lambda r: ~F.exists(ops, lambda o: (o["end"] > r["start"]) & (o["start"] < r["end"])))
    return F.nullif(F.array_position(free, True), F.lit(0)).cast("int") - 1


def editable_regions(ops: Column, length: Column) -> Column:
    """A region of at least one character for each operation: insertions widened by one, to the left at the end; none in an empty text."""
    one = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    wide = lambda o: F.when(o["start"] < o["end"], one(o["start"], o["end"])).when(o["end"] < length, one(o["start"], o["end"] + 1)).when(o["start"] > 0, one(o["start"] - 1, o["end"]))
    return F.array_compact(F.transform(ops, wide))


def ranked(regions: DataFrame, k: int) -> DataFrame:
    """The k riskiest regions of each document."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("risk"), "start", "end")
    return regions.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def contribution_regions(contributions: DataFrame, spans: DataFrame, top: int, k: int) -> DataFrame:
    """From per-token contributions (doc_id, start, end, score): the top ones, cut around spans, ranked."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "start", "end")
    most = contributions.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= top)
    return ranked(clip(most.select("doc_id", "start", "end", F.col("score").alias("risk")), spans), k)


def window_scores(docs: DataFrame, windows: DataFrame, scorer) -> DataFrame:
    """Windows with the risk that a column function gives their text."""
    cut = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return windows.join(docs.select("doc_id", "text"), "doc_id").withColumn("risk", scorer(cut)).drop("text")


def window_deltas(docs: DataFrame, windows: DataFrame, scorer) -> DataFrame:
    """Windows with the risk that their text adds to the document's."""
    rest = F.concat(F.substring(F.col("text"), F.lit(1), F.col("start")), F.substring(F.col("text"), F.col("end") + 1, F.length("text")))
    return windows.join(docs.select("doc_id", "text"), "doc_id").withColumn("risk", scorer(F.col("text")) - scorer(rest)).drop("text")


def surprise_regions(tokens: DataFrame, spans: DataFrame, top: int, k: int) -> DataFrame:
    """From tokens with a log likelihood: the least likely ones as regions (suspicion = -log likelihood)."""
    return contribution_regions(tokens.withColumn("score", -F.col("log_likelihood")), spans, top, k)


def misaligned(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tokens whose offsets don't hold their text, overlap or leave the document."""
    w = Window.partitionBy("doc_id").orderBy("index")
    rows = tokens.withColumn("before", F.coalesce(F.lag("end").over(w), F.lit(0))).join(docs.select("doc_id", "text"), "doc_id")
    off = (F.col("start") < F.col("before")) | (F.col("end") > F.length("text")) | (F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")) != F.col("token"))
    return rows.filter(off).select("doc_id", "index")
