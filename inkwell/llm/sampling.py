"""Document fingerprints by consistent weighted sampling.

A text's terms are its five-word shingles (A-Z lower-cased; a text of fewer
words is one term), weighted by how often they occur. For each of the
fingerprint's samples every term draws, from its own hash, two gamma variates
and a uniform one; they give the term a level below its weight and an arrival
time, and the earliest term with its level is the sample. Two texts share a
sample with a probability equal to their generalised Jaccard similarity, so
the share of equal samples estimates it (standard error at most
0.5 / sqrt(samples); a sample is stored in 16 bits, which adds less than 2e-5).

``neighbours`` pairs each document with the next one in descending id: the
table is range-partitioned and sorted by id, each task streams its rows in
order and compares a row with the one after it, and the last row of each
partition meets the first row of the next one in a second, small step over one
row per partition. Nothing is ordered in a single task.

Defined results: a null text counts as empty; texts without words share one
term of their own; equal texts have equal fingerprints; rows with one id are
ordered by the hash of their text, null ids come last; a table of one row has
itself as next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import materialize, with_text
from inkwell.llm.substrings import Hasher

SAMPLES = 64
SHINGLE = 5
_LEVELS = 1 << 12
#: Terms whose draws (256 bytes each) are held together; a longer text goes by blocks.
TERMS = 1 << 17

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _gamma_quantiles() -> np.ndarray:
    """Gamma(2, 1) at the middles of equal shares: the solution of 1 - (1 + x) exp(-x) = p, by bisection."""
    p = (np.arange(_LEVELS) + 0.5) / _LEVELS
    lo, hi = np.zeros(_LEVELS), np.full(_LEVELS, 60.0)
    for _ in range(80):
        mid = (lo + hi) / 2
        low = 1 - (1 + mid) * np.exp(-mid) < p
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


_GAMMA = _gamma_quantiles()
_R = _GAMMA.astype(np.float32)
_LN_C = np.log(_GAMMA).astype(np.float32)


class Sampler:
    """Fingerprints of texts."""

    def __init__(self, samples: int = SAMPLES, shingle: int = SHINGLE) -> None:
        self.k, self.shingle, self.hasher = samples, shingle, Hasher()
        rng = np.random.Generator(np.random.PCG64(20240607))
        self.step = rng.integers(0, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.place = rng.integers(0, 1 << 63, shingle, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def terms(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Sorted term hashes and their counts."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
        h = self.hasher.word_hash(raw, *self.hasher.places(raw), 0)
        n = self.shingle
        if len(h) < n:
            s = np.zeros(1, np.uint64) + np.uint64(len(h) + 1)
            for i in range(len(h)):
                s += h[i : i + 1] * self.place[i]
        else:
            s = h[: len(h) - n + 1] * self.place[0]
            for i in range(1, n):
                s += h[i : len(h) - n + 1 + i] * self.place[i]
        s ^= s >> np.uint64(29)
        s *= _MIX
        return np.unique(s, return_counts=True)

    def _draws(self, h: np.ndarray, k=slice(None)):
        z = h[:, None] * self.step[k]
        z ^= z >> np.uint64(32)
        z *= _MIX
        z ^= z >> np.uint64(31)
        r = _R[(z >> np.uint64(52)).view(np.int64)]
        ln_c = _LN_C[((z >> np.uint64(40)) & np.uint64(_LEVELS - 1)).view(np.int64)]
        beta = ((z >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(1 / (1 << 24))
        return r, ln_c, beta

    def arrivals(self, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """ln of each term's arrival time for every sample."""
        out = np.empty((len(h), self.k), np.float32)
        for at in range(0, len(h), 512):
            part = slice(at, at + 512)
            r, ln_c, beta = self._draws(h[part])
            if weight[part].max(initial=1) > 1:  # level: floor(ln w / r + beta); 0 for weight 1
                t = np.floor(np.log(weight[part]).astype(np.float32)[:, None] / r + beta)
                beta = beta - t
            beta -= 1
            beta *= r
            beta += ln_c  # ln c - r (t - beta) - r
            out[part] = beta
        return out

    def pick(self, hh: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """16 bits of each sample's earliest term and its level."""
        every = np.arange(self.k)
        z = hh * self.step
        z ^= z >> np.uint64(32)
        z *= _MIX
        z ^= z >> np.uint64(31)
        r = _R[(z >> np.uint64(52)).view(np.int64)]
        beta = ((z >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(1 / (1 << 24))
        t = np.floor(np.log(weight).astype(np.float32) / r + beta).astype(np.int64).view(np.uint64)
        s = (hh ^ (t * _ODD)) * _MIX + every.astype(np.uint64) * _ODD
        s ^= s >> np.uint64(33)
        s *= _ODD
        return (s >> np.uint64(48)).astype(">u2")

    def long_fingerprint(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Of one text with many terms: blocks of terms, keeping each sample's earliest term so far."""
        every = np.arange(self.k)
        best, bh, bw = np.full(self.k, np.inf, np.float32), np.zeros(self.k, np.uint64), np.ones(self.k, np.int64)
        for at in range(0, len(h), TERMS):
            a = self.arrivals(h[at : at + TERMS], w[at : at + TERMS])
            first = a.argmin(0)
            earlier = a[first, every] < best
            best[earlier] = a[first, every][earlier]
            bh[earlier], bw[earlier] = h[at + first[earlier]], w[at + first[earlier]]
        return self.pick(bh, bw)

    def fingerprints(self, texts: list[str]) -> list[np.ndarray]:
        """Fingerprints of texts; terms that some texts share are drawn once. At most about TERMS terms' draws are held."""
        out: list[np.ndarray] = []
        some: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for t in texts:
            h, w = self.terms(t)
            if some and size + len(h) > TERMS:
                out += self._together(some)
                some, size = [], 0
            if len(h) > TERMS:
                out.append(self.long_fingerprint(h, w))
            else:
                some.append((h, w))
                size += len(h)
        return out + self._together(some)

    def _together(self, found: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        if not found:
            return []
        flat_h = np.concatenate([h for h, _ in found])
        flat_w = np.concatenate([w for _, w in found])
        key = flat_h ^ (flat_w.astype(np.uint64) * _ODD)
        key, once, where = np.unique(key, return_index=True, return_inverse=True)
        h, w = flat_h[once], flat_w[once]
        lone = np.argsort(w > 1, kind="stable")  # weight 1 first: their level is 0
        back = np.empty(len(lone), np.int64)
        back[lone] = np.arange(len(lone))
        a = self.arrivals(h[lone], w[lone])
        where = back[where]
        out, at = [], 0
        for th, tw in found:
            first = a[where[at : at + len(th)]].argmin(0)
            at += len(th)
            out.append(self.pick(th[first], tw[first]))
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def replace_tail(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """doc_id, fingerprint (hex, four digits a sample)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sampler(samples)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            out = [f.tobytes().hex() for at in range(0, len(texts), 16) for f in s.fingerprints(texts[at : at + 16])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    src = with_text(docs, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fingerprint string")


_RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fp binary, edited_fp binary, near_edited double, near_next double"


def _compare(s: Sampler, rows: list[tuple], nexts: list[str]) -> list[tuple]:
    """Result rows of (doc_id, text) with the texts that follow them."""
    edited = [replace_tail(t, n) for (_, t), n in zip(rows, nexts, strict=True)]
    fps = s.fingerprints([t for _, t in rows] + edited + nexts)
    n = len(rows)
    return [
        (d, len(t), _digest(e), fps[i].tobytes(), fps[n + i].tobytes(), likeness(fps[i], fps[n + i]), likeness(fps[i], fps[2 * n + i]))
        for i, ((d, t), e) in enumerate(zip(rows, edited, strict=True))
    ]


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


_KINDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fp", pa.binary()), ("edited_fp", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def _stream(samples: int, group_chars: int = 1 << 17):
    kinds = pa.schema([*_KINDS, ("edge", pa.int32()), ("pid", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, pid = Sampler(samples), TaskContext.get().partitionId()
        held: list[tuple] = []  # rows whose next is known once another row comes
        size, started = 0, False
        edge = lambda k, d, t: (d, None, None, None, None, None, None, k, pid, t)

        def out(last: bool) -> pa.RecordBatch:
            rows = [r + (0, pid, None) for r in _compare(s, held[:-1], [t for _, t in held[1:]])] if len(held) > 1 else []
            if last:
                rows.append(edge(2, *held[-1]))
            return _batch(rows, kinds) if rows else None

        for batch in batches:
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                t = t or ""
                if not started:
                    started = True
                    yield _batch([edge(1, d, t)], kinds)
                held.append((d, t))
                size += len(t)
                if size > group_chars and len(held) > 1:
                    yield out(False)
                    del held[:-1]
                    size = len(t)
        if held:
            yield out(True)

    return run


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Each document against its edited text and the next document in descending id."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    src = with_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ranged = src.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    done = materialize(ranged.mapInArrow(_stream(samples), _RESULT + ", edge int, pid int, text string"), "neighbours")
    edges = done.filter("edge > 0").select("edge", "pid", "doc_id", "text")
    pids = sorted(r.pid for r in edges.filter("edge = 1").select("pid").collect())  # one number a partition
    ring = spark.createDataFrame([(p, pids[(i + 1) % len(pids)]) for i, p in enumerate(pids)], "pid int, next_pid int")
    firsts = edges.filter("edge = 1").select(F.col("pid").alias("next_pid"), F.col("text").alias("next_text"))
    pairs = edges.filter("edge = 2").select("pid", "doc_id", "text").join(ring, "pid").join(firsts, "next_pid").select("doc_id", "text", "next_text")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, kinds = Sampler(samples), pa.schema(_KINDS)
        for batch in batches:
            for d, t, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text")), strict=True):
                yield _batch(_compare(s, [(d, t)], [n]), kinds)

    every = done.filter("edge = 0").drop("edge", "pid", "text").unionByName(pairs.mapInArrow(meet, _RESULT))
    return every.select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fp")).alias("fingerprint"), F.lower(F.hex("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next"
    )
