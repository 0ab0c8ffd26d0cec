"""Near copies of documents by wide SimHash and deletion-variant signatures.

Edited copies of short texts differ in far more than three of 64 bits, so this
stage takes wider fingerprints: 256 bits over a text's distinct words (A-Z
lower-cased). Two texts are near copies if their fingerprints agree in at least
0.8 of the bits (``DISTANCE`` = 51 differ at most; the cosine of the two sets of
words is then some 0.8). Words, not word shingles: a changed word takes one term
and not five, which keeps edited copies close. Unrelated texts of one language
agree in 0.65 of the bits at most on the test tables.

A cut deals the bits, in an order of its own, to twelve segments of 21 or 22.
Fingerprints that share a segment of the first cut are verified on all bits and linked
first, which joins nearly all of a group of copies. Then, for each of ``CUTS``
cuts, each distinct fingerprint is indexed under every segment with one wildcard,
and members of different components that share a variant are verified on all bits.
Segments that differ by one bit share a half: fingerprints are dealt by the 24 halves
of their segments, and a task sorts the one-wildcard variants of the other
halves of its members, so ten times fewer rows are shuffled than there are variants.

Up to 23 differing bits (0.91) some segment of every cut differs by at most one, so the pair
shares a variant for sure. Beyond, it shares none if every segment of every cut differs by two or more:
``chance_of_missing`` gives it (eight cuts: below 0.00001 at 40 bits, 0.00004 at
44, 0.005 at 51, the limit), and a pair so missed is still joined if another text links both. No segments are both
few and certain at that distance: certainty at 51 bits takes 26 segments of ten bits, which unrelated texts share by the
thousand. Work and shuffle are in proportion to the distinct fingerprints (2,048 variants and 192 rows each).
``all_links`` compares every two of them and is there to measure what is found.

Keys that very many share: members of one component are never compared with each
other, so a group of copies costs nothing however large; members of different ones
are all compared in the task, up to ``HOLD`` members of a half at once. A half with more is
dealt again by its variants, and a variant with more as pairs of blocks, which meet in tasks of their own.
Nothing is capped or dropped.

Links join components as found so far by their smallest members; members of a
component need not be near copies of that one themselves.

Defined results: null texts and texts without words share the zero
fingerprint; rows with one id are one document; rows without an id take no part
and stay; extra columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import NUMBER_ROWS, TEXT_ROWS, batch_rows, by_bytes, discard, lean, materialize, with_text, worker_state
from inkwell.llm.components import EDGES, connected_components, edge_batch, forest
from inkwell.llm.substrings import Hasher

BITS = 256
SEGMENTS = 12
#: Bits that may differ: a fifth.
DISTANCE = BITS // 5
#: Orders of the bits in which segments are cut.
CUTS = 8
#: Members of a key that are linked at once when segments are shared, that a task holds of a variant, and of a block of a key with more (48 bytes each).
BUCKET = 4096
HOLD = 1 << 18
BLOCK = 1 << 16
#: Keys of up to so many members are compared together.
FEW = 16
_CUTS = [BITS * i // SEGMENTS for i in range(SEGMENTS + 1)]
_N = BITS // 64
_WORDS = [f"f{i}" for i in range(_N)]
_DDL = ", ".join(f"{w} bigint" for w in _WORDS)


class WideHasher:
    """Fingerprints of texts from their words' 64-bit hashes, which odd factors and mixing widen."""

    def __init__(self) -> None:
        self.hasher = Hasher()
        self.odd = np.random.Generator(np.random.PCG64(17)).integers(0, 1 << 63, _N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def widen(self, h: np.ndarray) -> np.ndarray:
        out = h[:, None] * self.odd
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))

    def fingerprints(self, texts: list[str | None]) -> np.ndarray:
        """A row of words for each text."""
        parts = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
        raw = np.frombuffer(b" ".join(parts), np.uint8)
        begin = np.cumsum([0, *(len(p) + 1 for p in parts)])
        first, last = self.hasher.places(raw)
        h = self.hasher.word_hash(raw, first, last, 0)
        owner = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(first, begin)))
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)  # a word counts once
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
        out = np.zeros((len(texts), _N), np.uint64)
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            ones = np.zeros(BITS, np.int64)
            for at in range(a, b, 255):  # sums of up to 255 bits fit a byte
                bits = np.unpackbits(self.widen(h[at : min(at + 255, b)]).view(np.uint8), axis=1, bitorder="little")
                ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
            out[i] = np.packbits(2 * ones > b - a, bitorder="little").view(np.uint64)
        return out


def chance_of_missing(bits: int, cuts: int = 1) -> float:
    """The chance that two fingerprints which differ in so many places, at random, differ by two or more in every segment of every cut."""
    sizes = [b - a for a, b in zip(_CUTS, _CUTS[1:], strict=False)]
    ways = [1]  # ways[d]: placements of d differing bits in the segments so far, two or more in each
    for size in sizes:
        new = [0] * (min(bits, len(ways) - 1 + size) + 1)
        for d, w in enumerate(ways):
            for here in range(2, min(size, bits - d) + 1):
                new[d + here] += w * math.comb(size, here)
        ways = new
    return (ways[bits] / math.comb(BITS, bits)) ** cuts if bits < len(ways) else 0.0


def bit_order(cut: int) -> np.ndarray:
    """The order of the bits in a cut; the first takes them as they are."""
    return np.arange(BITS) if cut == 0 else np.random.Generator(np.random.PCG64(1000 + cut)).permutation(BITS)


def reordered(fps: np.ndarray, cut: int) -> np.ndarray:
    """Fingerprints with their bits in a cut's order; differing bits stay as many."""
    if cut == 0 or not len(fps):
        return fps
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits[:, bit_order(cut)], axis=1, bitorder="little")).view(np.uint64)


def wide_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, f0..f3."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("near-copies")
        hasher = WideHasher()
        for batch in batches:
            for part in by_bytes(iter([batch]), "text", 1 << 19):
                f = hasher.fingerprints(part.column("text").to_pylist()).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(np.ascontiguousarray(f[:, i])) for i in range(_N))], ["doc_id", *_WORDS])

    src = with_text(docs, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, {_DDL}")


def _segment(number: int):
    """Bits of a segment, which may lie in two words, and how many they are."""
    begin, end = _CUTS[number], _CUTS[number + 1]
    word, at = begin // 64, begin % 64
    bits = F.shiftrightunsigned(F.col(_WORDS[word]), at)
    if at + end - begin > 64:
        bits = bits.bitwiseOR(F.shiftleft(F.col(_WORDS[word + 1]), 64 - at))
    return bits.bitwiseAND(F.lit((1 << (end - begin)) - 1)), end - begin


def _exact(rows: DataFrame) -> DataFrame:
    """rows under the values (k) of all their segments."""
    keys = [F.lit(n << 40).bitwiseOR(_segment(n)[0]) for n in range(SEGMENTS)]
    return rows.withColumn("k", F.explode(F.array(*keys)))


def _halves(rows: DataFrame) -> DataFrame:
    """rows under the values (k: segment, half, value) of both halves of all their segments; what differs by one bit shares one."""
    keys = []
    for n in range(SEGMENTS):
        bits, width = _segment(n)
        low = width // 2
        keys += [F.lit(n << 40).bitwiseOR(bits.bitwiseAND(F.lit((1 << low) - 1))), F.lit((n << 40) | (1 << 32)).bitwiseOR(F.shiftrightunsigned(bits, low))]
    return rows.withColumn("k", F.explode(F.array(*keys))).select("k", "label", *_WORDS)


def _bits_of(k: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows under halves: the segment's bits, and the first and last place in it that the other half has."""
    number, side = k >> 40, (k >> 32) & 1
    bits = np.zeros(len(k), np.uint64)
    width = np.zeros(len(k), np.int64)
    for n in np.unique(number).tolist():
        at, (begin, end) = number == n, (_CUTS[n], _CUTS[n + 1])
        word, shift = divmod(begin, 64)
        x = fps[at, word] >> np.uint64(shift)
        if shift + end - begin > 64:
            x = x | (fps[at, word + 1] << np.uint64(64 - shift))
        bits[at], width[at] = x & np.uint64((1 << (end - begin)) - 1), end - begin
    low = width // 2
    return bits, np.where(side == 0, low, 0), np.where(side == 0, width, low)


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Whether each row of a is near each row of b (shapes broadcast)."""
    out = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]), np.uint16)
    for i in range(_N):
        out += np.bitwise_count(a[..., i] ^ b[..., i])
    return out <= distance


def _stars(fps: np.ndarray, distance: int, chunk: int = 64) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links (places) that join each component of one block to one of its members."""
    alive = np.ones(len(fps), bool)
    a, b = [], []
    for start in range(0, len(fps), chunk):
        others = start + np.nonzero(alive[start:])[0]
        seeds = others[others < start + chunk]
        near = _near(fps[seeds][:, None], fps[others][None], distance)
        for r in np.nonzero(near.sum(1) > 1)[0].tolist():
            seed = seeds[r]
            if not alive[seed]:
                continue
            alive[seed] = False
            found = others[near[r] & alive[others]]
            front = np.zeros(0, np.int64)
            while len(found) or len(front):
                if len(found):
                    alive[found] = False
                    a.append(np.full(len(found), seed))
                    b.append(found)
                    front = np.concatenate((front, found))
                some, front = front[:chunk], front[chunk:]
                left = np.nonzero(alive)[0]
                found = left[_near(fps[some][:, None], fps[left][None], distance).any(0)] if len(left) else left
                if not len(left):
                    break
        alive[seeds] = False
    return a, b


class _Found:
    """Links of a task, held as a forest while they are few."""

    def __init__(self) -> None:
        self.ends: list[np.ndarray] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.ends.append(np.stack((a, b)))
            self.held += len(a)

    def take(self, most: int) -> Iterator[pa.RecordBatch]:
        """What to hand on when more than so many links are held."""
        if self.held <= most:
            return
        ends = forest(np.concatenate(self.ends, axis=1))
        self.ends, self.held = [ends], ends.shape[1]
        if 2 * self.held > most:
            self.ends, self.held = [], 0
            yield edge_batch(ends)


def _links(distance: int, bucket: int):
    """Reads k, label and the fingerprint, sorted by key, and links the labels of each key's near members, up to bucket members at once.

    A key with more goes by lots; a quarter of each lot goes on to the next, which joins a group of copies whatever its size.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.zeros(0, np.int64)
        fps = np.zeros((0, _N), np.uint64)
        key = None
        found = _Found()

        def link(ids: np.ndarray, fps: np.ndarray) -> None:
            if len(ids) > 1 and (ids != ids[0]).any():
                a, b = _stars(fps, distance)
                if a:
                    a, b = ids[np.concatenate(a)], ids[np.concatenate(b)]
                    found.add(a[a != b], b[a != b])

        for batch in batches:
            if not batch.num_rows:
                continue
            k, new_ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new_fps = np.stack([batch.column(2 + i).to_numpy() for i in range(_N)], 1).view(np.uint64)
            starts = np.concatenate(([0], np.nonzero(k[1:] != k[:-1])[0] + 1))
            ends = np.concatenate((starts[1:], [len(new_ids)]))
            size = ends - starts
            small = (size > 1) & (size <= FEW)
            small[[0, -1]] = False  # a batch's first and last key may go on
            rows = np.nonzero(np.repeat(small, size))[0]
            group = np.repeat(np.arange(len(size)), size)[rows]
            for lag in range(1, FEW):  # all pairs of all small keys at once
                one = np.nonzero(group[lag:] == group[:-lag])[0]
                if not len(one):
                    break
                a, b = rows[one], rows[one + lag]
                apart = new_ids[a] != new_ids[b]
                a, b = a[apart], b[apart]
                near = _near(new_fps[a], new_fps[b], distance)
                found.add(new_ids[a[near]], new_ids[b[near]])
            take = size > FEW
            take[[0, -1]] = True
            for s, e in zip(starts[take].tolist(), ends[take].tolist(), strict=True):
                if k[s] != key:
                    link(ids, fps)
                    key, ids, fps = k[s], new_ids[s:e], new_fps[s:e]
                else:
                    ids, fps = np.concatenate((ids, new_ids[s:e])), np.concatenate((fps, new_fps[s:e]))
                while len(ids) > bucket:
                    link(ids[:bucket], fps[:bucket])
                    on = max(1, bucket * 3 // 4)
                    ids, fps = ids[on:], fps[on:]
            yield from found.take(EDGES)
        link(ids, fps)
        yield from found.take(0)

    return run


def _meet(x: np.ndarray, of_x: np.ndarray, y: np.ndarray, of_y: np.ndarray, distance: int, found: _Found, rows: int = 64, columns: int = 4096) -> Iterator[pa.RecordBatch]:
    """Links the labels of all near fingerprints of two blocks whose labels differ; blocks are sorted by label."""
    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    for s in range(0, len(of_x), rows):
        part, label = x[:, s : s + rows], of_x[s : s + rows]
        for o in range(0, len(of_y), columns):
            other, labels = y[:, o : o + columns], of_y[o : o + columns]
            if label[0] == label[-1] == labels[0] == labels[-1]:
                continue
            bits = np.bitwise_count(part[0][:, None] ^ other[0][None])
            for w in range(1, _N - 1):
                bits += np.bitwise_count(part[w][:, None] ^ other[w][None])
            if bits.min() > distance:  # nearly always, before the last word
                continue
            i, j = np.nonzero(bits <= distance)
            apart = label[i] != labels[j]
            i, j = i[apart], j[apart]
            near = bits[i, j].astype(np.uint16) + np.bitwise_count(part[-1][i] ^ other[-1][j]) <= distance
            found.add(label[i[near]], labels[j[near]])
            yield from found.take(EDGES)


def _across(labels: np.ndarray, fps: np.ndarray, distance: int, found: _Found) -> Iterator[pa.RecordBatch]:
    """Links all near members of different labels; members are sorted by label, and each run of one label meets what comes behind it."""
    starts = np.concatenate(([0], np.nonzero(labels[1:] != labels[:-1])[0] + 1)).tolist()
    ends = [*starts[1:], len(labels)]
    i = 0
    while i < len(starts):
        j = i + 1
        while j < len(starts) and ends[j] - starts[i] <= 64:  # short runs go together, and meet each other too
            j += 1
        start, end = starts[i], ends[j - 1]
        behind = start if j > i + 1 else end
        if behind < len(labels):
            yield from _meet(fps[start:end], labels[start:end], fps[behind:], labels[behind:], distance, found)
        i = j


#: A key's link with this says that its members were too many for one task.
_GIANT = -1


def _together(key: np.ndarray, labels: np.ndarray, fps: np.ndarray, distance: int, found: _Found) -> Iterator[pa.RecordBatch]:
    """Links near members of different labels that stand under one key; rows are sorted by key and label."""
    starts = np.concatenate(([0], np.nonzero(key[1:] != key[:-1])[0] + 1))
    ends = np.concatenate((starts[1:], [len(key)]))
    mixed = labels[starts] != labels[ends - 1]
    size = ends - starts
    rows = np.nonzero(np.repeat(mixed & (size <= FEW), size))[0]
    group = np.repeat(np.arange(len(size)), size)[rows]
    for lag in range(1, FEW):  # all pairs of all small keys at once
        one = np.nonzero(group[lag:] == group[:-lag])[0]
        if not len(one):
            break
        a, b = rows[one], rows[one + lag]
        apart = labels[a] != labels[b]
        a, b = a[apart], b[apart]
        near = _near(fps[a], fps[b], distance)
        found.add(labels[a[near]], labels[b[near]])
    for s, e in zip(starts[mixed & (size > FEW)].tolist(), ends[mixed & (size > FEW)].tolist(), strict=True):
        yield from _across(labels[s:e], fps[s:e], distance, found)
    yield from found.take(EDGES)


def _grouped(hold: int, links) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads k, label and the fingerprint, sorted by k and label, and hands whole keys to ``links``, many at a time.

    A key of more than hold members is told as (k, _GIANT) and not compared here.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Found()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n, giant = 0, None  # rows held, all whole keys but the last; a key that is passed over

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal n
            if n > 1:
                yield from links(*(np.concatenate(x) for x in zip(*held, strict=True)), found)
            held.clear()
            n = 0

        for batch in batches:
            if not batch.num_rows:
                continue
            k, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fps = np.stack([batch.column(2 + i).to_numpy() for i in range(_N)], 1).view(np.uint64)
            at = int(np.searchsorted(k, giant, "right")) if giant is not None else 0
            while at < len(k):
                last = int(np.searchsorted(k, k[-1]))  # the batch's last key may go on
                to = last if last > at else len(k)
                if held and held[-1][0][-1] != k[at]:
                    yield from close()
                held.append((k[at:to], labels[at:to], fps[at:to]))
                n += to - at
                at = to
                if n > hold and held[0][0][0] == held[-1][0][-1]:  # one key alone
                    giant = int(held[0][0][0])
                    yield edge_batch(np.array([[giant], [_GIANT]], np.int64))
                    held.clear()
                    n = 0
                    at = int(np.searchsorted(k, giant, "right"))
        yield from close()
        yield from found.take(0)

    return run


def _half_links(distance: int):
    """Of members that share half of a segment, those that share a one-wildcard variant of the other half are verified and linked."""

    def links(k: np.ndarray, labels: np.ndarray, fps: np.ndarray, found: _Found) -> Iterator[pa.RecordBatch]:
        group = np.cumsum(np.concatenate(([0], (k[1:] != k[:-1]).astype(np.int64))))
        many = np.bincount(group)[group] > 1
        k, labels, fps, group = k[many], labels[many], fps[many], group[many]
        if not len(k):
            return
        bits, first, last = _bits_of(k, fps)
        for p in range(int(first.min()), int(last.max())):
            at = np.nonzero((first <= p) & (p < last))[0]
            key = (group[at] << 24) | (bits[at] & ~np.uint64(1 << p)).astype(np.int64)
            order = np.argsort(key, kind="stable")
            key, at = key[order], at[order]
            same = np.concatenate((key[1:] == key[:-1], [False]))
            same[1:] |= same[:-1].copy()
            if same.any():
                yield from _together(key[same], labels[at[same]], fps[at[same]], distance, found)

    return links


def _variant_links(distance: int):
    def links(k: np.ndarray, labels: np.ndarray, fps: np.ndarray, found: _Found) -> Iterator[pa.RecordBatch]:
        yield from _together(k, labels, fps, distance, found)

    return links


@lean
def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows under halves, each under the one-wildcard variants (k: segment, place, value) of its segment's other half."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(0).to_numpy()
        fps = np.stack([batch.column(2 + i).to_numpy() for i in range(_N)], 1).view(np.uint64)
        bits, first, last = _bits_of(k, fps)
        for p in range(int(first.min()), int(last.max())):
            at = np.nonzero((first <= p) & (p < last))[0]
            key = ((k[at] >> 40) << 40) | (p << 32) | (bits[at] & ~np.uint64(1 << p)).astype(np.int64)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(key), *(batch.column(i).take(take) for i in range(1, 2 + _N))], ["k", "label", *_WORDS])


def _met(distance: int):
    """Reads k, i, j, own (the row's block), label and the fingerprint, sorted by k, i, j and label, and compares each two blocks of a key."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # numbers and fingerprints of the two blocks at hand
        found = _Found()

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            numbers, fps = (np.concatenate(x, axis=1) for x in zip(*held, strict=True))
            held.clear()
            (i, j), fps = numbers[1:3, 0], fps.T
            first = numbers[3] == i
            x, of_x = fps[first], numbers[4, first]
            if i == j:
                yield from _across(of_x, x, distance, found)
            else:
                yield from _meet(x, of_x, fps[~first], numbers[4, ~first], distance, found)

        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = np.stack([batch.column(c).to_numpy() for c in range(5)])
            fps = np.stack([batch.column(5 + c).to_numpy() for c in range(_N)]).view(np.uint64)
            cuts = [0, *(np.nonzero((numbers[:3, 1:] != numbers[:3, :-1]).any(0))[0] + 1).tolist(), numbers.shape[1]]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if held and (held[-1][0][:3, -1] != numbers[:3, s]).any():
                    yield from close()
                held.append((numbers[:, s:e], fps[:, s:e]))
        yield from close()
        yield from found.take(0)

    return run


_OUT = "a bigint, b bigint"


def _in_blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """rows (k, label and the fingerprint) under every pair of blocks (i, j) of their key that holds their own; blocks: how many a key has."""
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64(*_WORDS), F.col("blocks")).cast("long"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    met = rows.withColumn("other", F.explode(every)).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    key = ["k", "i", "j"]
    return met.select(*key, "own", "label", *_WORDS).repartition(*key).sortWithinPartitions(*key, "label")


def all_links(classes: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """a, b: links that connect all near copies, by comparing every two fingerprints in blocks; quadratic, to measure ``near_links`` by."""
    blocks = F.lit(max(1, math.ceil(classes.count() / block))).cast("long")
    rows = classes.select(F.lit(0).cast("long").alias("k"), F.col("rep").alias("label"), *_WORDS)
    return _in_blocks(rows, blocks).mapInArrow(_met(distance), _OUT)


def _reordered(rows: DataFrame, cut: int) -> DataFrame:
    """label and the fingerprint in a cut's order of bits."""
    if cut == 0:
        return rows

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = reordered(np.stack([batch.column(1 + i).to_numpy() for i in range(_N)], 1).view(np.uint64), cut).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(fps[:, i])) for i in range(_N))], ["label", *_WORDS])

    return rows.mapInArrow(run, f"label bigint, {_DDL}")


def near_links(classes: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET, cuts: int = CUTS, hold: int = HOLD, block: int = BLOCK) -> DataFrame:
    """a, b: links that connect the near copies among distinct fingerprints. classes: rep, f0, f1, ..."""

    def labelled(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Components so far as links, and the fingerprints under their component's smallest rep."""
        parts = materialize(connected_components(links), "components")
        rows = classes.join(parts.hint("merge"), classes.rep == parts.node, "left")
        return parts.toDF("a", "b"), materialize(rows.select(F.coalesce("root", "rep").alias("label"), *_WORDS), "labelled")

    def matched(keyed: DataFrame, links) -> tuple[DataFrame, DataFrame]:
        """Links by whole keys, and the keys that have too many members for a task."""
        dealt = keyed.repartition("k").sortWithinPartitions("k", "label")
        met = materialize(dealt.mapInArrow(_grouped(hold, links), _OUT), "near-links")
        return met.filter(F.col("b") != _GIANT), met.filter(F.col("b") == _GIANT).select(F.col("a").alias("k"))

    def variants_met(rows: DataFrame) -> DataFrame:
        """Members of half-segments in one task; those of giant ones by variants, and of giant variants by blocks."""
        met, giant = matched(_halves(rows), _half_links(distance))
        if giant.isEmpty():
            return met
        again = materialize(_halves(rows).join(giant, "k", "left_semi").select("k", "label", *_WORDS).mapInArrow(_variants, f"k bigint, label bigint, {_DDL}"), "variants")
        more, giant = matched(again, _variant_links(distance))
        if giant.isEmpty():
            return met.union(more)
        again = again.join(giant, "k", "left_semi")
        sizes = materialize(again.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / block).alias("n")), "giant-keys")
        dealt = _in_blocks(again.join(sizes, "k"), F.col("n"))
        return met.union(more).union(materialize(dealt.mapInArrow(_met(distance), _OUT), "near-links"))

    keyed = _exact(classes.withColumnRenamed("rep", "label")).select("k", "label", *_WORDS).repartition("k").sortWithinPartitions("k")
    links, rows = labelled(materialize(keyed.mapInArrow(_links(distance, bucket), _OUT), "near-links"))
    for cut in range(cuts):
        of_cut = rows if cut == 0 else materialize(_reordered(rows, cut), "reordered")
        links = links.union(variants_met(of_cut))
        if cut == 0 and cuts > 1:
            discard(rows)
            links, rows = labelled(links)
        elif cut:
            discard(of_cut)
    discard(rows)
    return links


def near_copies(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """doc_id, component_id (the smallest id of its near copies) of every row with an id."""
    spark = docs.sparkSession
    batch_rows(spark, TEXT_ROWS)
    marked = materialize(wide_fingerprints(docs.filter(F.col(id_col).isNotNull()), id_col, text_col), "wide")
    batch_rows(spark, NUMBER_ROWS)
    classes = materialize(marked.groupBy(*_WORDS).agg(F.min("doc_id").alias("rep")), "classes")
    parts = materialize(connected_components(near_links(classes, distance, bucket)), "components")
    labels = materialize(classes.join(parts, classes.rep == parts.node, "left").select(*_WORDS, F.coalesce("root", "rep").alias("component_id")), "labels")
    for t in (classes, parts):
        discard(t)
    batch_rows(spark, TEXT_ROWS)
    return marked.join(labels.hint("merge"), _WORDS).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def one_of_each(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, once.

    Rows without an id stay. Where rows share an id, the one whose text hashes
    smallest stays; among equal texts the one whose other columns come first as JSON.
    """
    columns = docs.columns
    found = materialize(near_copies(docs, distance), "groups")
    winners = found.filter("doc_id = component_id").select("doc_id")
    kept = docs.join(winners.hint("merge"), "doc_id", "left_semi").select(*columns)
    twice = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if not twice.isEmpty():
        rest = [c for c in columns if c != "doc_id"]
        first = kept.groupBy("doc_id").agg(F.min_by(F.struct(*rest), F.struct(F.xxhash64("text"), F.to_json(F.struct(*rest)))).alias("r"))
        kept = first.select("doc_id", "r.*").select(*columns)
    return kept.unionByName(docs.filter("doc_id is null"))
