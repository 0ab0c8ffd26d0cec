"""SimHash near-duplicates through deletion-variant signatures.

Fingerprints of 64 bits link at up to three differing bits. Cut into two
segments of 32 bits, one of the two differs by at most one bit, so both share a
variant of that segment with one wildcard: each distinct fingerprint is indexed
under its 2 x 32 one-wildcard variants, variants are matched by equality, and
matches are verified on all 64 bits.

A variant that two fingerprints share is verified at once. One that more share
is a bucket: its members are fetched by an equality join and linked in the
task that reads the sorted bucket, which emits a spanning forest of the links,
never all pairs. A bucket of more than 2,048 fingerprints is first split again
by one-wildcard variants of the other segment's halves and then of the other
half's quarters; by then at most 11 bits are free, so no bucket holds more than
2,048 distinct fingerprints, however many near copies a text has. Nothing is
capped or dropped.

Exact copies share a fingerprint and take part once. Components are found over
distinct fingerprints and joined back.

Defined results: a null text, or one without words, has fingerprint zero and is
linked like any other; texts of fewer words than a shingle count as one
shingle; repeated rows and ids give a row each; a null id is kept (it never
names a component unless all ids of it are null); an empty table gives no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import discard, materialize, whole_groups, with_text
from inkwell.llm.components import connected_components

#: Most members of a bucket that one step links; the last level's buckets cannot exceed it.
BUCKET = 2048
SEED = 42


def fingerprint(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's word shingles (A-Z lower-cased, repeats included)."""
    words = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII alone
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    k = max(1, len(words) - shingle + 1)
    ends = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], seed) for a, b in zip(begins[:k].tolist(), ends.tolist(), strict=True)), np.dtype("<u8"), k)
    ones = np.zeros(64, np.int64)
    for at in range(0, k, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > k, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    src = with_text(docs, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _variants(rows: DataFrame, level: int) -> DataFrame:
    """Index rows (fp and the buckets above) under the one-wildcard variants of a level."""
    if level == 1:
        width, value = 32, "shiftrightunsigned(fp, 32 * half) & 4294967295L"
    elif level == 2:  # the halves of the segment that the bucket does not hold
        width, value = 16, "shiftrightunsigned(fp, 32 * cast(1 - (shiftright(b1, 37) & 1) as int) + 16 * half) & 65535L"
    else:  # the quarters of the half that neither bucket holds
        width, value = 8, "shiftrightunsigned(fp, 32 * cast(1 - (shiftright(b1, 37) & 1) as int) + 16 * cast(1 - (shiftright(b2, 21) & 1) as int) + 8 * half) & 255L"
    bits = {32: 5, 16: 4, 8: 3}[width]
    rows = rows.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("seg", F.expr(value))
    rows = rows.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    name = f"b{level}"
    key = f"shiftleft(cast(half as bigint), {width + bits}) | shiftleft(cast(pos as bigint), {width}) | (seg & ~shiftleft(1L, pos))"
    if level == 2:  # keep half at bit 21
        key = "shiftleft(cast(half as bigint), 21) | shiftleft(cast(pos as bigint), 16) | (seg & ~shiftleft(1L, pos))"
    return rows.withColumn(name, F.expr(key)).drop("half", "seg", "pos")


def link_bucket(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints."""
    left = np.arange(len(fps))
    a, b = [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            k = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[k]) <= distance
            if near.any():
                found = left[near]
                a += [k] * len(found)
                b += found.tolist()
                front += found.tolist()
                left = left[~near]
    return np.array(a, np.int64), np.array(b, np.int64)


def _bucket_links(distance: int, keys: int):
    """Reads rows sorted by bucket and emits each bucket's forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def close() -> pa.RecordBatch | None:
            fps = np.unique(np.concatenate(held).view(np.uint64))
            a, b = link_bucket(fps, distance)
            signed = fps.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(signed[a]), pa.array(signed[b])], ["a", "b"]) if len(a) else None

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = np.stack([batch.column(i).to_numpy() for i in range(keys)])
            fp = batch.column(keys).to_numpy()
            starts = np.concatenate(([0], np.nonzero((cols[:, 1:] != cols[:, :-1]).any(0))[0] + 1))
            for s, e in zip(starts, [*starts[1:], len(fp)], strict=True):
                key = tuple(cols[:, s].tolist())
                if key != last and held:
                    out = close()
                    held = []
                    if out is not None:
                        yield out
                last = key
                held.append(fp[s:e])
        if held:
            out = close()
            if out is not None:
                yield out

    return run


def near_links(fps: DataFrame, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """a, b: links among distinct fingerprints (column fp) that connect all within the distance (up to 3)."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments find up to three differing bits")
    out = None
    # A row becomes 64 keys, so few bytes are dealt to all tasks before (a stated number is not coalesced).
    rows = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    for level in (1, 2, 3):
        keys = [f"b{i}" for i in range(1, level + 1)]
        keyed = _variants(rows, level)
        shared = materialize(keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "variants")
        pairs = shared.filter("n = 2").select("a", "b").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
        most = bucket if level < 3 else 1 << 62
        crowded = shared.filter((F.col("n") > 2) & (F.col("n") <= most)).select(*keys)
        members = whole_groups(keyed.join(crowded, keys).select(*keys, "fp"), keys)
        found = pairs.union(members.mapInArrow(_bucket_links(distance, level), "a bigint, b bigint")).distinct()
        out = found if out is None else out.union(found)
        over = shared.filter(F.col("n") > most).select(*keys)
        if over.isEmpty():
            break
        rows = keyed.join(over, keys)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest id reachable over links) of every row."""
    marked = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    parts = materialize(connected_components(near_links(classes.select("fp"), distance)), "components")
    named = classes.join(parts, classes.fp == parts.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = materialize(named.join(least, "root").select("fp", "component_id"), "labels")
    for t in (classes, parts):
        discard(t)
    return marked.join(labels, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
