"""Diffs of texts and operations, and places in lines."""

from __future__ import annotations

import difflib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators.operations import OP


def unified(pairs: DataFrame, context: int = 3) -> DataFrame:
    """doc_id, diff: the unified diff of columns before and after; empty where they are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y in zip(b.column("before").to_pylist(), b.column("after").to_pylist(), strict=True):
                lines = difflib.unified_diff((x or "").splitlines(True), (y or "").splitlines(True), "before", "after", n=context)
                out.append("".join(t if t.endswith("\n") else t + "\n" for t in lines))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "diff"])

    return pairs.select("doc_id", "before", "after").mapInArrow(run, "doc_id bigint, diff string")


def line_column(text: Column, offset: Column) -> Column:
    """struct(line, column), both from 1, of an offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.struct((F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).alias("line"), (F.length(F.substring_index(head, "\n", -1)) + 1).alias("column"))


def describe(ops: Column, text: Column) -> Column:
    """A line for each operation: its place and what it does."""
    show = lambda t: F.when(F.length(t) == 0, F.lit("nothing")).otherwise(F.concat(F.lit("'"), F.regexp_replace(t, r"[^\x20-\x7E]", "."), F.lit("'")))
    one = lambda o: F.concat_ws(" ", F.format_string("%d-%d:", o["start"], o["end"]), show(F.substring(text, o["start"] + 1, o["end"] - o["start"])), F.lit("->"), show(o["text"]))
    return F.array_join(F.transform(ops, one), "\n")


def _common_lengths(a: str, b: str) -> np.ndarray:
    """Of a and each beginning of b, the length of the longest common subsequence; a bit of one number stands for each character of b."""
    masks: dict[str, int] = {}
    for i, c in enumerate(b):
        masks[c] = masks.get(c, 0) | (1 << i)
    row = full = (1 << len(b)) - 1
    for c in a:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def kept_runs(a: str, b: str) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of a longest common subsequence, in linear space.

    Common ends are cut first. What is left is halved in a, and b is parted where
    the halves keep most together; then both parts are done alike.
    """
    out: list[tuple[int, int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        same = len(os.path.commonprefix([a[alo:ahi], b[blo:bhi]]))
        if same:
            out.append((alo, blo, same))
            alo, blo = alo + same, blo + same
        same = len(os.path.commonprefix([a[alo:ahi][::-1], b[blo:bhi][::-1]]))
        if same:
            ahi, bhi = ahi - same, bhi - same
            out.append((ahi, bhi, same))
        if alo == ahi or blo == bhi:
            continue
        if ahi - alo == 1:
            at = b.find(a[alo], blo, bhi)
            if at >= 0:
                out.append((alo, at, 1))
            continue
        mid = (alo + ahi) // 2
        kept = _common_lengths(a[alo:mid], b[blo:bhi]) + _common_lengths(a[mid:ahi][::-1], b[blo:bhi][::-1])[::-1]
        cut = blo + int(kept.argmax())
        todo += [(alo, mid, blo, cut), (mid, ahi, cut, bhi)]
    return sorted(out)


def shortest_edits(source: str, candidate: str) -> list[tuple[int, int, str]]:
    """The edits (start, end, text) with the fewest characters taken out and put in that turn source into candidate."""
    out, i, j = [], 0, 0
    for x, y, n in [*kept_runs(source, candidate), (len(source), len(candidate), 0)]:
        if x > i or y > j:
            out.append((i, x, candidate[j:y]))
        i, j = x + n, y + n
    return out


def minimal_edits(source: str, candidate: str) -> Column:
    """The shortest edits from one text column to another as an array of operations; null where either is null."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))

    @F.arrow_udf(f"array<{OP}>")
    def run(source: pa.Array, candidate: pa.Array) -> pa.Array:
        pairs = zip(source.to_pylist(), candidate.to_pylist(), strict=True)
        return pa.array([None if a is None or b is None else [dict(zip(("start", "end", "text"), o, strict=True)) for o in shortest_edits(a, b)] for a, b in pairs], kind)

    return run(source, candidate)


def edited(pairs: DataFrame) -> DataFrame:
    """doc_id, before, after, ops: the shortest edits of columns before and after, where these are made by Python functions themselves."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = zip(b.column("before").to_pylist(), b.column("after").to_pylist(), strict=True)
            ops = [None if x is None or y is None else [dict(zip(("start", "end", "text"), o, strict=True)) for o in shortest_edits(x, y)] for x, y in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ops, kind)], ["doc_id", "before", "after", "ops"])

    rows = pairs.select("doc_id", "before", "after")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, before string, after string, ops array<{OP}>")
