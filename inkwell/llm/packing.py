"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

A document is its ids and one closing id. Longer ones are cut into full pieces
and a rest; full pieces are sequences by themselves. The other pieces are dealt
at random into shards of bounded size. In a shard a bin is opened with the
largest piece left and filled greedily with the largest that fits; where a gap
stays, the bin's smallest piece is taken out if two unpacked ones fill the
expanded gap more tightly. Bins that stay underfull are taken apart and packed
again together with those of other shards, in ever fewer shards, until one
shard holds the rest or nothing is gained (less than one underfull bin in 256 is
saved); then the better of the last two packings of the rest stays. A task never sees more than a shard,
and lengths are kept as a histogram, so a shard costs time in proportion to its
bins.

Defined results: a null text counts as empty (one piece that holds the closing
id alone); repeated rows are packed each; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.bpe import worker_encoder
from inkwell.llm.common import by_bytes, materialize, with_text

#: Pieces per shard: bounds a packing task.
SHARD_PIECES = 8192


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pack lengths (1..capacity): each piece's bin and offset, and each bin's fill."""
    n = len(lengths)
    order = np.argsort(lengths, kind="stable")
    count = np.bincount(lengths, minlength=capacity + 1)
    stock = {int(s): order[a:b].tolist() for s, a, b in zip(*_runs(lengths[order]), strict=True)}
    floor_of = np.where(count > 0, np.arange(capacity + 1), 0)
    np.maximum.accumulate(floor_of, out=floor_of)  # the largest length on hand that is no larger; 0: none
    sizes = np.arange(capacity + 1)

    def take(size: int) -> None:
        count[size] -= 1
        if not count[size]:  # lengths up to the next one on hand fall to the one before
            below = floor_of[size - 1]
            end = size + int(np.argmax(floor_of[size:] != size)) if floor_of[-1] != size else capacity + 1
            floor_of[size:end] = below

    def put(size: int) -> None:
        count[size] += 1
        if count[size] == 1:
            part = floor_of[size:]
            part[part < size] = size

    def best_pair(gap: int) -> tuple[int, int]:
        """Two lengths on hand with the largest sum up to gap."""
        a = sizes[1 : gap // 2 + 1][count[1 : gap // 2 + 1] > 0]
        if not len(a):
            return 0, 0
        b = floor_of[gap - a]
        same = (b == a) & (count[a] < 2)
        b = np.where(same, floor_of[a - 1], b)
        total = np.where(b > 0, a + b, 0)
        k = int(total.argmax())
        return (int(a[k]), int(b[k])) if total[k] else (0, 0)

    bins: list[list[int]] = []
    left = n
    while left:
        held: list[int] = []
        gap = capacity
        while gap and (size := int(floor_of[gap])):
            take(size)
            held.append(size)
            gap -= size
        if gap:  # held is in descending order: the last is the smallest
            small = held[-1]
            a, b = best_pair(gap + small)
            if a + b > small:
                held.pop()
                take(a)
                take(b)
                put(small)
                held += [a, b]
        left -= len(held)
        bins.append(held)
    where, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    for k, held in enumerate(bins):
        at = 0
        for size in held:
            i = stock[size].pop()
            where[i], offset[i] = k, at
            at += size
    fill = np.array([sum(h) for h in bins], np.int64)
    return where, offset, fill


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(ordered):
        return ordered, ordered, ordered
    starts = np.concatenate(([0], np.nonzero(np.diff(ordered))[0] + 1))
    return ordered[starts], starts, np.concatenate((starts[1:], [len(ordered)]))


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int,
    closing_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
    batch_bytes: int = 4 << 20,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, a number of its own (and the ids).

    The number is the task's and a running one; it is fixed once the result is materialized.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "nr"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(tokenizer_path, None, 500_000)
        end = np.array([closing_id], "<u4").tobytes()
        nr = TaskContext.get().partitionId() << 33
        for batch in by_bytes(batches, "text", batch_bytes):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, raw in enumerate(enc.encode(batch.column("text").to_pylist())):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(part)
            cols = [
                batch.column("doc_id").take(pa.array(row, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
                pa.array(range(nr, nr + len(row)), pa.int64()),
            ]
            nr += len(row)
            yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * keep_ids, names)

    src = with_text(docs, id_col, text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, nr bigint" + ", ids binary" * keep_ids)


def _shard_packer(names: list[str], capacity: int, first: int, last: bool):
    """Packs a shard; pieces of underfull bins are loose, save in the last shard."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        where, offset, fill = best_two_fit(t.column("length").to_numpy().astype(np.int64), capacity)
        loose = np.zeros(len(where), bool) if last else (capacity - fill > capacity // 256)[where]
        base = (first + key[0].as_py()) << 28
        t = t.select(names).append_column("sequence_id", pa.array(base + where, pa.int64()))
        return t.append_column("offset", pa.array(offset, pa.int64())).append_column("loose", pa.array(loose))

    return run


def pack(parts: DataFrame, capacity: int, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Give every piece (length, nr and other columns) its sequence_id and offset. parts should be materialized."""
    fields = [f for f in parts.schema.fields]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    full = parts.filter(F.col("length") == capacity).withColumns(
        # a full piece is a sequence by itself; negative numbers never meet a shard's
        {"sequence_id": -F.col("nr") - 1, "offset": F.lit(0).cast("long")}
    )
    rest = parts.filter(F.col("length") < capacity)
    names = [f.name for f in fields]
    at_start = F.col("offset") == 0  # one piece a bin
    done, before, loose = None, None, None
    level, first, n = 0, 0, rest.count()
    while n:
        shards = max(1, math.ceil(n / shard_pieces))
        run = _shard_packer(names, capacity, first, shards == 1)
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "nr", F.lit(level)), F.lit(shards)))
        packed = materialize(dealt.groupBy("shard").applyInArrow(run, f"{ddl}, sequence_id bigint, offset bigint, loose boolean"), "packed")
        seen = packed.agg(F.count_if("loose").alias("n"), F.count_if(at_start).alias("bins"), F.count_if(at_start & F.col("loose")).alias("loose")).first()
        ends = before is not None and before - seen["bins"] < before / 256
        if ends:  # nothing gained
            placed = packed if seen["bins"] < before else loose
        else:
            placed = packed.filter("not loose")
        placed = placed.drop("loose")
        done = placed if done is None else done.unionByName(placed)
        if ends:
            break
        loose, before = packed.filter("loose"), seen["loose"]
        rest = loose.select(names)
        n, level, first = seen["n"], level + 1, first + shards
    return full if done is None else full.unionByName(done)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack whole documents: a row per piece with its place."""
    parts = materialize(pieces(docs, tokenizer_path, capacity, id_col=id_col, text_col=text_col, keep_ids=keep_ids), "pieces")
    return pack(parts, capacity).drop("nr")
