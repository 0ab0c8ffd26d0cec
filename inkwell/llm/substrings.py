"""Substring dedup: a log-structured index of window hashes.

A window is ``window`` consecutive words of a document. A word goes if a window
that covers it also starts earlier (smaller doc_id, or the same document,
earlier start).

The index takes documents in batches of ascending ids. Of each window only the
smallest hash of its grams (``gram`` words) is indexed: equal windows have
equal smallest grams, so a window whose smallest gram occurs once cannot
repeat, and neighbouring windows mostly share theirs, which keeps an entry for
about every eighth word. A document whose whole text stands earlier is known
by its digest: all its windows repeat, and it takes no part as a source. A
batch's grams become an immutable run: a table
hashed into buckets and sorted by gram. A run is merge-joined with the runs
before it, bucket by bucket and without a shuffle; windows whose smallest gram
occurs in another text, or twice in their own, are candidates. Candidates, of the batch and of the older
documents that share a gram with it, are verified by their 128-bit window
hashes from two independent word hashes: the earliest place of each is found by
an aggregate, and a batch's candidates that aren't earliest are repeats. A batch
that finds ``fan_out`` runs compacts them into one first. Window hashes are not
kept, as they take five times the room of the text; the texts of older documents
that share a gram are hashed again.

All entries of one gram stand in one bucket, sorted on disk; a task reads them as
a stream and holds none but the least and greatest text hash.

No list of a gram's or window's places is ever gathered; only a document's own
grams and starts meet in one row.

Defined results: a null text has no words; a text of fewer words than a window
loses none; rows alike in id and text are one document for the comparison and
each get its result; rows with one id and different texts are ordered by the
hash of the text; null ids come last; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import TEXT_ROWS, batch_rows, by_bytes, discard, lean, materialize, remove, shuffles_freed, table_path, with_text, worker_state

WINDOW = 20
GRAM = 5
_LAST = (1 << 63) - 1
#: A word with the white space after it (leading white space goes with the first word).
_SPACED = re.compile(rb"(?:\A[\x20\x09-\x0d]+)?[^\x20\x09-\x0d]+[\x20\x09-\x0d]*")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 64, (2, 256), dtype=np.uint64)


class Hasher:
    """Word, gram and window hashes of documents, computed over whole byte buffers.

    A word's hash is a polynomial in its bytes (a random number for each byte
    value), taken from a running sum over the buffer and mixed; two of them,
    with bases and byte numbers of their own, make 128 bits.
    """

    B1, B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
    BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
    #: Bytes that are hashed at a time, so that a long text takes no more room than a short one.
    ROOM = 1 << 20

    def __init__(self, window: int = WINDOW, gram: int = GRAM) -> None:
        if not 1 <= gram <= window:
            raise ValueError("a gram is a part of a window")
        self.window, self.gram = window, gram
        self.p1, self.p2 = _powers(self.B1, window), _powers(self.B2, window)
        self.up: list[np.ndarray] = []

    def words(self, text: str | None) -> list[bytes]:
        return text.encode("utf-8", "surrogatepass").split() if text else []

    def places(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words start and end in a buffer."""
        space = np.ones(len(raw) + 2, bool)
        space[1:-1] = _SPACE[raw]
        edge = np.nonzero(space[1:] != space[:-1])[0]
        return edge[::2], edge[1::2]

    def word_hash(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        if not self.up:
            self.up = [_powers(b, self.ROOM) for b in self.BASES]
            self.down = [_powers(pow(b, -1, 1 << 64), self.ROOM) for b in self.BASES]
        h = np.empty(len(start), np.uint64)
        at = 0
        while at < len(start):
            base = int(start[at])
            to = max(at + 1, int(np.searchsorted(end, base + self.ROOM, "right")))
            if to == at + 1 and end[at] - base > self.ROOM:  # one word that fills more
                h[at] = self._long(raw[base : int(end[at])], which)
            else:
                some = raw[base : int(end[to - 1])]
                total = np.zeros(len(some) + 1, np.uint64)
                part = _BYTE[which][some]
                part *= self.up[which][: len(some)]
                np.cumsum(part, out=total[1:])
                first = start[at:to] - base
                h[at:to] = (total[end[at:to] - base] - total[first]) * self.down[which][first]
            at = to
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h

    def _long(self, word: np.ndarray, which: int) -> np.uint64:
        out = 0
        for at in range(0, len(word), self.ROOM):
            part = _BYTE[which][word[at : at + self.ROOM]]
            part *= self.up[which][: len(part)]
            out += int(part.sum(dtype=np.uint64)) * pow(self.BASES[which], at, 1 << 64)
        return np.uint64(out & ((1 << 64) - 1))

    def hashes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b" ".join(words), np.uint8)
        start, end = self.places(raw)
        return self.word_hash(raw, start, end, 0), self.word_hash(raw, start, end, 1)

    @staticmethod
    def rolled(h: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
        """The sum of n following hashes times powers, at every start; by doubling, so in log n steps."""
        out = np.zeros(len(h) - n + 1, np.uint64)
        part, size, at, left = h, 1, 0, n
        while left:
            if left & 1:
                out += part[at : at + len(out)] * p[at]
                at += size
            left >>= 1
            if left:
                part = part[:-size] + part[size:] * p[size] if size < len(p) else part
                size *= 2
        return out

    def smallest_grams(self, h1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every window the smallest gram hash and the (leftmost) place of it."""
        g = self.rolled(h1, self.p1, self.gram)
        g ^= g >> np.uint64(31)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(29)
        span = self.window - self.gram + 1
        low, place, size = g, np.arange(len(g)), 1
        while size < span:
            step = min(size, span - size)
            a, b = low[: len(low) - step], low[step:]
            right = b < a
            low = np.where(right, b, a)
            place = np.where(right, place[step:], place[: len(place) - step])
            size += step
        return low.view(np.int64), place

    def windows(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.rolled(h1, self.p1, self.window).view(np.int64), self.rolled(h2, self.p2, self.window).view(np.int64)


class Chunk:
    """Some texts laid end to end: their words, and what every window that stays within its text looks like."""

    def __init__(self, hasher: Hasher, texts: list[str | None], windows: bool = False) -> None:
        parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        raw = np.frombuffer(b" ".join(parts), np.uint8)
        begin = np.cumsum([0, *(len(p) + 1 for p in parts)])
        first, last = hasher.places(raw)
        self.begin = np.searchsorted(first, begin)  # of each text's words
        n = hasher.window
        self.start = np.zeros(0, np.int64)
        if len(first) < n:
            return
        h1 = hasher.word_hash(raw, first, last, 0)
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.begin))
        self.start = np.nonzero(self.owner[: len(h1) - n + 1] == self.owner[n - 1 :])[0]
        self.owner = self.owner[self.start]
        low, place = hasher.smallest_grams(h1)
        self.low, self.place = low[self.start], place[self.start]
        if windows:
            w1, w2 = hasher.windows(h1, hasher.word_hash(raw, first, last, 1))
            self.w1, self.w2 = w1[self.start], w2[self.start]


def _chunks(batch: pa.RecordBatch, limit: int = 400_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """A batch in parts of about ``limit`` bytes of text."""
    for part in by_bytes(iter([batch]), "text", limit):
        yield part, part.column("text").to_pylist()


def _order_id():
    """Null ids come last."""
    return F.coalesce(F.col("doc_id"), F.lit(_LAST))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, text and two keys: o (the id, null last) and th (tells apart texts under one id; else 0).

    carry: also rest, a struct of all other columns.
    """
    if carry:
        others = [c for c in docs.columns if c not in (id_col, text_col)]
        rest = F.struct(*others) if others else F.struct(F.lit(None).cast("string").alias("none"))
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), rest.alias("rest"))
    else:
        rows = with_text(docs, id_col, text_col).withColumn("rest", F.lit(None).cast("string"))
    rows = rows.withColumn("o", _order_id().cast("long"))
    twice = rows.groupBy("o").count().filter("count > 1").select("o")
    if twice.isEmpty():
        return rows.withColumn("th", F.lit(0).cast("long"))
    marked = rows.join(twice.withColumn("many", F.lit(True)), "o", "left")
    return marked.withColumn("th", F.when(F.col("many"), F.xxhash64("text")).otherwise(F.lit(0)).cast("long")).select("doc_id", "text", "rest", "o", "th")


def grams(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """h, o, th, n, d: the smallest grams of each document's windows, how many places have them, the text's hash."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("substrings")
        hasher = Hasher(window, gram)
        for batch in batches:
            for part, texts in _chunks(batch):
                c = Chunk(hasher, texts)
                if not len(c.start):
                    continue
                new = np.ones(len(c.start), bool)  # a gram's place counts once
                new[1:] = (c.place[1:] != c.place[:-1]) | (c.owner[1:] != c.owner[:-1])
                h, owner = c.low[new], c.owner[new]
                order = np.lexsort((h, owner))
                h, owner = h[order], owner[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                at = np.nonzero(first)[0]
                n = np.diff(np.concatenate((at, [len(h)])))
                take = pa.array(owner[at])
                yield pa.RecordBatch.from_arrays([pa.array(h[at]), part.column("o").take(take), part.column("th").take(take), pa.array(n.astype(np.int32)), part.column("d").take(take)], ["h", "o", "th", "n", "d"])

    return rows.select("o", "th", "text", F.xxhash64("text").alias("d")).mapInArrow(run, "h bigint, o bigint, th bigint, n int, d bigint")


def candidate_windows(marked: DataFrame, window: int, gram: int) -> DataFrame:
    """w1, w2, o, th, start of the windows whose smallest gram is marked: each document's first of a kind. marked: text, o, th, hs."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("substrings")
        hasher = Hasher(window, gram)
        for batch in batches:
            for part, texts in _chunks(batch):
                c = Chunk(hasher, texts, windows=True)
                at = np.nonzero(_marked(c, part))[0] if len(c.start) else c.start
                if not len(at):
                    continue
                order = np.lexsort((c.w2[at], c.w1[at], c.owner[at]))  # stable: the first start of a kind leads
                at = at[order]
                w1, w2, owner = c.w1[at], c.w2[at], c.owner[at]
                first = np.ones(len(at), bool)
                first[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]) | (owner[1:] != owner[:-1])
                at, take = at[first], pa.array(owner[first])
                start = (c.start[at] - c.begin[c.owner[at]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(w1[first]), pa.array(w2[first]), part.column("o").take(take), part.column("th").take(take), pa.array(start)], ["w1", "w2", "o", "th", "start"])

    return marked.select("o", "th", "text", "hs").mapInArrow(run, "w1 bigint, w2 bigint, o bigint, th bigint, start int")


def _marked(c: Chunk, part: pa.RecordBatch) -> np.ndarray:
    """The windows whose smallest gram is marked. A gram is marked in all texts that have it, so one set serves a chunk."""
    held = part.column("hs")
    marks = np.unique(held.flatten().to_numpy())
    if not len(marks):
        return np.zeros(len(c.start), bool)
    at = np.searchsorted(marks, c.low)
    at[at == len(marks)] = 0
    return (marks[at] == c.low) & held.is_valid().to_numpy(zero_copy_only=False)[c.owner]


def removals(joined: DataFrame, window: int, gram: int, keep_text: bool) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept). joined: doc_id, text, copy (all of it stands earlier), hs (marked grams), firsts (starts that are earliest)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("substrings")
        hasher = Hasher(window, gram)
        for batch in batches:
            for part, texts in _chunks(batch):
                yield cut(hasher, part, texts)

    def cut(hasher: Hasher, part: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
        copies = part.column("copy").to_pylist()
        has = part.column("hs").is_valid().to_numpy(zero_copy_only=False)
        keeps: dict[int, np.ndarray] = {}
        rows = np.nonzero(has)[0]
        if len(rows):
            some = part.take(pa.array(rows))
            c = Chunk(hasher, [texts[i] for i in rows.tolist()])
            if len(c.start):
                repeat = np.zeros(c.begin[-1], bool)
                repeat[c.start] = _marked(c, some)
                firsts = some.column("firsts")
                lengths = np.fromiter((x or 0 for x in pc.list_value_length(firsts).to_pylist()), np.int64, len(rows))
                repeat[np.repeat(c.begin[:-1], lengths) + firsts.flatten().to_numpy()] = False
                starts = np.nonzero(repeat)[0]
                edge = np.zeros(c.begin[-1] + 1, np.int64)
                edge[starts] += 1
                np.subtract.at(edge, starts + window, 1)
                keep = np.cumsum(edge)[:-1] == 0
                for k, i in enumerate(rows.tolist()):
                    mine = keep[c.begin[k] : c.begin[k + 1]]
                    if not mine.all():
                        keeps[i] = mine
        n_words, n_removed, digests, kept_texts = [], [], [], []
        for i, (t, copy) in enumerate(zip(texts, copies, strict=True)):
            words = hasher.words(t)
            n = len(words)
            keep = keeps.get(i)
            if copy and n >= window:
                keep = np.zeros(n, bool)
            if keep is not None:
                words = list(compress(words, keep.tolist()))
            n_words.append(n)
            n_removed.append(n - len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            if keep_text:  # the text itself without the removed words
                if keep is not None:
                    spaced = _SPACED.findall(t.encode("utf-8", "surrogatepass"))
                    t = b"".join(compress(spaced, keep.tolist())).decode("utf-8", "surrogatepass").rstrip(" \t\n\x0b\x0c\r")
                kept_texts.append(t)
        cols = [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), part.column("o"), part.column("th")]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "o", "th"]
        if keep_text:
            cols += [pa.array(kept_texts, pa.string()), part.column("rest")]
            names += ["kept", "rest"]
        return pa.RecordBatch.from_arrays(cols, names)

    kind, rest = (joined.schema[c].dataType.simpleString() for c in ("doc_id", "rest"))
    return joined.select("doc_id", "text", "rest", "o", "th", "copy", "hs", "firsts").mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, o bigint, th bigint" + f", kept string, rest {rest}" * keep_text
    )


class WindowIndex:
    """Immutable sorted runs of gram hashes, the documents they came from and these documents' digests.

    Runs are files of the index's folder, bucketed and sorted by gram; the
    catalog's entries for them are made when the index is opened. Batches must
    come in ascending order of ids. ``save`` makes the folder complete, ``open``
    goes on from it in another session.
    """

    def __init__(self, spark: SparkSession, window: int = WINDOW, gram: int = GRAM, fan_out: int = 2, buckets: int | None = None, folder: str | None = None) -> None:
        self.spark, self.window, self.gram, self.fan_out = spark, window, gram, fan_out
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = folder or table_path(spark, "window-index")
        self.runs: list[str] = []
        self.documents: DataFrame | None = None
        self.digests: DataFrame | None = None
        self.copies: DataFrame | None = None
        self._alone = True

    def save(self) -> str:
        """Write what the index holds besides its runs, then the list of all of it; returns the folder."""
        stamp = uuid.uuid4().hex
        parts = {}
        for name in ("documents", "digests", "copies"):
            table = getattr(self, name)
            if table is not None:
                parts[name] = f"{name}-{stamp}"
                table.write.parquet(f"{self.folder}/{parts[name]}")
        state = {"window": self.window, "gram": self.gram, "fan_out": self.fan_out, "buckets": self.buckets, "alone": self._alone, "runs": self.runs, "parts": parts}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/state")
        return self.folder

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> WindowIndex:
        state = json.loads(spark.read.text(f"{folder}/state").first().value)
        index = cls(spark, state["window"], state["gram"], state["fan_out"], state["buckets"], folder)
        index._alone, index.runs = state["alone"], state["runs"]
        for name in index.runs:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (h BIGINT, o BIGINT, th BIGINT, n INT, d BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {index.buckets} BUCKETS LOCATION '{folder}/{name}'")
        for name, where in state["parts"].items():
            setattr(index, name, spark.read.parquet(f"{folder}/{where}"))
        return index

    def detach(self) -> None:
        """Forget the runs' catalog entries; the files stay."""
        for r in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {r}")

    def _write_run(self, entries: DataFrame) -> str:
        name = f"inkwell_run_{uuid.uuid4().hex}"
        sorted_rows = entries.repartition(self.buckets, "h").sortWithinPartitions("h")
        with shuffles_freed(self.spark):
            sorted_rows.write.bucketBy(self.buckets, "h").sortBy("h").format("parquet").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for r in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {r}")
            remove(self.spark, f"{self.folder}/{r}")

    def _run(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def add(self, rows: DataFrame, keep_text: bool = False) -> DataFrame:
        """Judge a batch (from ``keyed``) against itself and all batches before, then index it."""
        if len(self.runs) >= self.fan_out:
            self.compact()
        single = self._single(rows)
        once = rows if single else rows.dropDuplicates(["o", "th"])
        place = ["o", "th"]
        new = self._write_run(grams(once, self.window, self.gram))
        copies = self._copies(once)
        stats = [F.min("d").alias("a"), F.max("d").alias("b"), F.max("n").alias("n")]
        total = self._run(new).groupBy("h").agg(*stats)
        for r in self.runs:  # a merge-join of sorted runs
            older = self._run(r).groupBy("h").agg(F.min("d").alias("a2"), F.max("d").alias("b2"))
            total = total.join(older, "h", "left").select("h", F.least("a", "a2").alias("a"), F.greatest("b", "b2").alias("b"), "n")
        shared = total.filter("a <> b or n > 1").select("h")  # in two texts, or twice in one
        marks = None
        for r in [new, *self.runs]:
            part = self._run(r).join(shared, "h", "left_semi").select(*place, "h")
            marks = part if marks is None else marks.union(part)
        marks = marks.groupBy(*place).agg(F.collect_list("h").alias("hs"))
        every_copy = copies if self.copies is None else copies.union(self.copies)
        marks = materialize(marks.join(every_copy, place, "left_anti"), "marks")
        own = once.select("o", "th", "text")
        texts = own if self.documents is None else own.unionByName(self.documents)
        found = candidate_windows(texts.join(marks.hint("merge"), place), self.window, self.gram)
        if single:
            first = found.groupBy("w1", "w2").agg(F.min("o").alias("o"), F.min_by("start", "o").alias("start")).withColumn("th", F.lit(0).cast("long"))
        else:
            first = found.groupBy("w1", "w2").agg(F.min(F.struct("o", "th", "start")).alias("f")).select("f.*")
        firsts = materialize(first.groupBy(*place).agg(F.collect_list("start").alias("firsts")), "firsts")
        known = marks.join(firsts, place, "left").withColumn("copy", F.lit(False))
        known = known.unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True)
        out = materialize(removals(rows.join(known.hint("merge"), place, "left"), self.window, self.gram, keep_text), "removals")
        for t in (marks, firsts):
            discard(t)
        self.runs.append(new)
        self.documents = texts
        self.copies = every_copy
        return out

    def _single(self, rows: DataFrame) -> bool:
        """Whether ids alone tell all documents so far apart (th stays 0)."""
        self._alone = self._alone and rows.filter("th <> 0").isEmpty()
        return self._alone

    def _copies(self, rows: DataFrame) -> DataFrame:
        """The documents of a batch whose whole text stands earlier."""
        own = materialize(rows.select("o", "th", F.sha2("text", 256).alias("digest")).filter("digest is not null"), "digests")
        self.digests = own if self.digests is None else self.digests.union(own)
        first = self.digests.groupBy("digest").agg(F.min("o").alias("first"), F.count(F.lit(1)).alias("many")).filter("many > 1").select("digest", "first")
        first = materialize(first, "first-copies")  # read back, so that the join may split a digest of very many copies
        return materialize(own.join(first, "digest").filter("o > first").select("o", "th"), "copies")

    def compact(self) -> None:
        """Merge all runs into one and drop the old ones."""
        if len(self.runs) < 2:
            return
        every = self._run(self.runs[0])
        for r in self.runs[1:]:
            every = every.union(self._run(r))
        merged = self._write_run(every)
        self._drop(self.runs)
        self.runs = [merged]

    def close(self) -> None:
        """Delete the index."""
        self._drop(self.runs)
        self.runs = []
        remove(self.spark, self.folder)


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = 3, fan_out: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """All documents through the index, in batches of ascending id: doc_id, n_words, n_removed, kept_sha256, o, th.

    keep_text: also kept (the text without the removed words) and rest (a struct of all other columns).
    """
    spark = docs.sparkSession
    batch_rows(spark, TEXT_ROWS)
    rows = keyed(docs, id_col, text_col, carry=keep_text)
    cuts = rows.agg(F.percentile_approx("o", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    index = WindowIndex(spark, window, gram, fan_out)
    out = None
    low = None
    try:
        for high in [*cuts, None]:
            part = rows
            if low is not None:
                part = part.filter(F.col("o") > low)
            if high is not None:
                part = part.filter(F.col("o") <= high)
            low = high
            done = index.add(part, keep_text)
            out = done if out is None else out.unionByName(done)
    finally:
        index.close()
    return out


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without their repeated passages; those of which nothing stays go, n_chars follows the text."""
    columns = docs.columns
    done = dedup(docs, window, keep_text=True).filter("n_words = 0 or n_removed < n_words")
    length = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("rest")["n_chars"]) if "n_chars" in columns else None
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": length if length is None else length.cast(docs.schema["n_chars"].dataType)}
    return done.select(*((made[c] if c in made else F.col("rest")[c]).alias(c) for c in columns))
