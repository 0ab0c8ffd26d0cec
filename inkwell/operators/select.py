"""Choosing candidates: lexicographic minimum, skyline, diverse beam, top k, first of each hash."""

from __future__ import annotations

import difflib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators.voice import ngrams

#: What a candidate is better by when smaller (skyline).
COSTS = ("risk", "char_ratio", "token_ratio", "drift", "model_calls", "detector_queries", "cost_usd")


def _flag(name: str) -> Column:
    return F.when(F.col(name), 0).otherwise(1)


def selection_key() -> list[Column]:
    """Valid, on target, least edited, least drift, least risk, cheapest, then by content."""
    edit = F.round(F.greatest("char_ratio", "token_ratio"), 6)
    return [_flag("valid"), _flag("target_met"), edit, F.round("drift", 6), F.round("risk", 6), F.col("model_calls"), F.col("detector_queries"), F.round("cost_usd", 6), F.col("content_hash")]


def beam_key() -> list[Column]:
    weighted = 0.55 * F.col("char_ratio") + 0.35 * F.col("token_ratio") + 0.1 * F.col("drift")
    return [_flag("valid"), _flag("target_met"), weighted, F.col("char_ratio"), F.col("token_ratio"), F.col("n_ops"), F.col("risk"), F.col("model_calls"), F.col("detector_queries"), F.col("cost_usd"), F.col("content_hash")]


def best(candidates: DataFrame, by: str = "doc_id", key: list[Column] | None = None) -> DataFrame:
    """The first valid candidate of each group by the key; an aggregate with map-side combine, no sort."""
    key = key or selection_key()
    order = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(key)))
    rest = [c for c in candidates.columns if c != by]
    won = candidates.filter("valid").groupBy(by).agg(F.min_by(F.struct(*rest), order).alias("w"))
    return won.select(by, "w.*")


def skyline(candidates: DataFrame, by: str = "doc_id", costs: tuple[str, ...] = COSTS) -> DataFrame:
    """Candidates that none of their group dominates: an anti-join on the group and the costs."""
    other = candidates.select(F.col(by).alias("o_by"), *(F.col(c).alias(f"o_{c}") for c in costs))
    no_worse, better = F.lit(True), F.lit(False)
    for c in costs:
        no_worse = no_worse & (F.col(f"o_{c}") <= F.col(c))
        better = better | (F.col(f"o_{c}") < F.col(c))
    return candidates.join(other, (F.col(by) == F.col("o_by")) & no_worse & better, "left_anti")


def top_k(rows: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def first_of_hash(candidates: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated order (dropDuplicates has none)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return candidates.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def similarity(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def _longest_common(a: str, b: str) -> int:
    """Length of the longest common subsequence; one bit for each character of b, so len(a) steps over words of 64."""
    masks: dict[str, int] = {}
    for i, c in enumerate(b):
        masks[c] = masks.get(c, 0) | (1 << i)
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


_BASE = 0xD1342543DE82EF95


class _Windows:
    """Hashes of all stretches of a text of any length: polynomials modulo 2**64, from one running sum."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(self.codes) + 1
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((self.codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def of(self, lo: int, hi: int, length: int) -> np.ndarray:
        """Of the stretches of one length that begin in lo..hi - length."""
        at = slice(lo, hi - length + 1)
        return (self.sums[lo + length : hi + 1] - self.sums[at]) * self.down[at]


def _aligned(x: _Windows, alo: int, ahi: int, y: _Windows, blo: int, bhi: int) -> int:
    """A length that the longest common stretch of two parts has at least, as a rule its own: the longest one between parts
    aligned at their starts, their ends and where some short stretches of the one stand in the other."""
    shifts = {blo - alo, bhi - ahi}
    pace = max(16, (ahi - alo) // 8)
    for at in range(alo + pace // 2, ahi - 16, pace):
        found = y.text.find(x.text[at : at + 16], blo, bhi)
        if found >= 0:
            shifts.add(found - at)
    most = 0
    for shift in shifts:
        lo, hi = max(alo, blo - shift), min(ahi, bhi - shift)
        if hi - lo > most:
            unlike = np.flatnonzero(x.codes[lo:hi] != y.codes[lo + shift : hi + shift])
            most = max(most, int(np.diff(unlike, prepend=-1, append=hi - lo).max()) - 1)
    return most


def _held(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Places of hashes of the one that the other holds as well; some that it doesn't may be among them."""
    size = min(1 << 22, 1 << (8 * len(other)).bit_length())
    at = np.arange(len(one))
    for bits in (40, 20):  # two tables of marks tell all but one in 60 apart
        marks = np.zeros(size, bool)
        marks[(other >> np.uint64(bits)).astype(np.int64) & (size - 1)] = True
        at = at[marks[(one[at] >> np.uint64(bits)).astype(np.int64) & (size - 1)]]
    return at if len(at) <= 64 else at[np.isin(one[at], other)]


def _longest_block(x: _Windows, alo: int, ahi: int, y: _Windows, blo: int, bhi: int, least: int) -> tuple[int, int, int]:
    """The longest common stretch of two parts, the first in the one and then in the other; at least ``least`` long."""

    def first(length: int) -> tuple[int, int] | None:
        if length > min(ahi - alo, bhi - blo):
            return None
        one, other = x.of(alo, ahi, length), y.of(blo, bhi, length)
        for i in _held(one, other).tolist():
            for j in np.nonzero(other == one[i])[0].tolist():
                if (x.codes[alo + i : alo + i + length] == y.codes[blo + j : blo + j + length]).all():
                    return alo + i, blo + j
        return None

    low, high = max(least, _aligned(x, alo, ahi, y, blo, bhi)), min(ahi - alo, bhi - blo)
    if low < high and first(low + 1) is None:
        high = low
    while low < high:
        mid = (low + high + 1) // 2
        if first(mid) is None:
            high = mid - 1
        else:
            low = mid
    return (*(first(low) or (alo, blo)), low) if low else (alo, blo, 0)


def same_end(a: str, ahi: int, b: str, bhi: int, most: int) -> int:
    """How many characters before two places are the same, at most so many."""
    if a[ahi - most : ahi] == b[bhi - most : bhi]:
        return most
    low, high = 0, most - 1
    while low < high:
        mid = (low + high + 1) // 2
        if a[ahi - mid : ahi] == b[bhi - mid : bhi]:
            low = mid
        else:
            high = mid - 1
    return low


def same_from(a: str, alo: int, b: str, blo: int, most: int) -> int:
    """How many characters from two places on are the same, at most so many."""
    if a[alo : alo + most] == b[blo : blo + most]:
        return most
    low, high = 0, most - 1
    while low < high:
        mid = (low + high + 1) // 2
        if a[alo : alo + mid] == b[blo : blo + mid]:
            low = mid
        else:
            high = mid - 1
    return low


#: At most so many pieces of a part are looked for, and so many places of theirs looked at.
_PIECES, _PLACES = 16, 32


def _anchored(a: str, alo: int, ahi: int, b: str, blo: int, bhi: int, least: int) -> tuple[int, int, int] | None:
    """The longest common stretch of two parts, as ``_longest_block`` finds it, if it is long and stands in few places; else None.

    A stretch of ``low`` characters holds one of the pieces of the one part that begin every low - q + 1 characters and are q
    long, so it lies where such a piece stands in the other.
    """
    room = min(ahi - alo, bhi - blo)
    low = max(least, same_from(a, alo, b, blo, room), same_end(a, ahi, b, bhi, room))

    def run(i: int, j: int, q: int) -> tuple[int, int, int]:
        back = same_end(a, i, b, j, min(i - alo, j - blo))
        return i - back, j - back, back + q + same_from(a, i + q, b, j + q, min(ahi - i - q, bhi - j - q))

    if 4 * low < ahi - alo:
        pace = max(16, (ahi - alo) // 8)
        for at in range(alo + pace // 2, ahi - 16, pace):
            j = b.find(a[at : at + 16], blo, bhi)
            if j >= 0:
                low = max(low, run(at, j, 16)[2])
    q = low - low // 2
    pace = low - q + 1
    if low < 4 or ahi - alo > _PIECES * pace:
        return None
    runs: list[tuple[int, int, int]] = []
    places = 0
    for at in range(alo, ahi - q + 1, pace):
        piece = a[at : at + q]
        j = b.find(piece, blo, bhi)
        while j >= 0:
            places += 1
            if places > _PLACES:
                return None
            if not any(j - at == y - x and x <= at < x + k for x, y, k in runs):
                runs.append(run(at, j, q))
            j = b.find(piece, j + 1, bhi)
    return min(runs, key=lambda r: (-r[2], r[0], r[1]))


def _blocks(a: str, b: str, needed: float | None, least: int) -> tuple[int, int]:
    """How many characters the matching blocks of two texts hold (the longest common stretch, then the same on its left and right), and may hold beyond.

    With a number needed, blocks are added only until these two decide whether they hold as many.
    """
    windows: list[_Windows] = []
    todo, matched, open_ = [(0, len(a), 0, len(b), least)], 0, min(len(a), len(b))
    while todo and (needed is None or matched < needed <= matched + open_):
        todo.sort(key=lambda t: min(t[1] - t[0], t[3] - t[2]))
        alo, ahi, blo, bhi, low = todo.pop()
        room = min(ahi - alo, bhi - blo)
        open_ -= room
        if ahi - alo == bhi - blo and a[alo:ahi] == b[blo:bhi]:
            matched += room
            continue
        if room == 1:
            matched += a[alo] in b[blo:bhi] if ahi - alo == 1 else b[blo] in a[alo:ahi]
            continue
        block = _anchored(a, alo, ahi, b, blo, bhi, low) if room else None
        if block is None:
            if (ahi - alo) * (bhi - blo) <= 40_000:
                matched += sum(m.size for m in difflib.SequenceMatcher(None, a[alo:ahi], b[blo:bhi], autojunk=False).get_matching_blocks())
                continue
            windows = windows or [_Windows(a), _Windows(b)]
            block = _longest_block(windows[0], alo, ahi, windows[1], blo, bhi, low)
        i, j, k = block
        matched += k
        if k:
            for part in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)):
                if part[0] < part[1] and part[2] < part[3]:
                    todo.append((*part, 0))
                    open_ += min(part[1] - part[0], part[3] - part[2])
    return matched, open_


def reaches(a: str, b: str, needed: float, least: int = 0) -> bool:
    """Whether the matching blocks of two texts hold so many characters; some common stretch is at least ``least`` long."""
    return _blocks(a, b, needed, least)[0] >= needed


def matched(a: str, b: str) -> int:
    """How many characters the matching blocks of two texts hold, as difflib finds them."""
    return _blocks(a, b, None, 0)[0]


def _shared_grams(a: np.ndarray, b: np.ndarray, q: int) -> int:
    """At most so many stretches of q characters have two texts in common, each as often as both hold it (hashed ones, so never too few)."""
    size = min(1 << 22, 1 << (8 * max(len(a), len(b))).bit_length())

    def counts(codes: np.ndarray) -> np.ndarray:
        n = max(0, len(codes) - q + 1)
        h = np.zeros(n, np.uint64)
        for i in range(q):
            h = h * np.uint64(_BASE) + codes[i : i + n]
        return np.bincount((h >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size)

    return int(np.minimum(counts(a), counts(b)).sum())


def _apart(a: str, b: str, needed: int) -> bool:
    """Whether no blocks can hold so many characters, by the short stretches that both texts have.

    Between two blocks stands an unmatched character at least, so blocks that hold m characters are at most
    total - 2 m + 1, and each of them has but q - 1 stretches of q characters less than characters.
    """
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    return any(_shared_grams(x, y, q) < needed - (q - 1) * (len(a) + len(b) - 2 * needed + 1) for q in (2, 4))


def is_alike(a: str, b: str, least: float) -> bool:
    """similarity(a, b) >= least. Matching blocks hold a longest common substring, so a shared prefix or suffix bounds them from below;
    they form a common subsequence, so its greatest length, or the short stretches in common, bound them from above. Between the bounds, blocks are matched until they decide."""
    total = len(a) + len(b)
    if a == b or not total:
        return least <= 1.0
    room = min(len(a), len(b))
    first, last = same_from(a, 0, b, 0, room), same_end(a, len(a), b, len(b), room)
    ends = max(first, last)
    if 2.0 * ends / total >= least:
        return True
    if 2.0 * min(len(a), len(b)) / total < least:
        return False
    if total < 400:
        return 2.0 * _longest_common(a, b) / total >= least and similarity(a, b) >= least
    needed = next(m for m in range(max(0, int(least * total / 2) - 2), total + 2) if 2.0 * m / total >= least)
    near = min(first + last, room) >= needed  # a common subsequence as long: no bound from above decides
    return (near or not _apart(a, b, needed)) and reaches(a, b, needed, ends)


def diverse_beam(candidates: DataFrame, width: int, most_alike: float = 0.9, by: str = "doc_id") -> DataFrame:
    """Greedy by key: skip what is too like a chosen text, then fill up with the skipped. candidates: by, text and a position (place) in key order.

    Rows come sorted; a task holds the chosen ones of one group and as many of its skipped ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, chosen, skipped, n = None, [], [], 0  # rows as (number in the group, batch, number in it, text)

        def close() -> list[tuple[pa.RecordBatch, int]]:
            return [(b, i) for _, b, i, _ in sorted([*chosen, *skipped[: width - len(chosen)]], key=lambda x: x[0])]

        def taken(rows: list[tuple[pa.RecordBatch, int]]) -> Iterator[pa.RecordBatch]:
            for _, part in itertools.groupby(rows, key=lambda x: id(x[0])):
                part = list(part)
                yield part[0][0].take(pa.array([i for _, i in part]))

        for batch in batches:
            out = []
            for i, (key, text) in enumerate(zip(batch.column(by).to_pylist(), batch.column("text").to_pylist(), strict=True)):
                if key != group:
                    out += close()
                    group, chosen, skipped, n = key, [], [], 0
                if len(chosen) < width and not any(is_alike(t, text, most_alike) for *_, t in chosen):
                    chosen.append((n, batch, i, text))
                elif len(skipped) < width - len(chosen):
                    skipped.append((n, batch, i, text))
                n += 1
            yield from taken(out)
        yield from taken(close())

    return candidates.repartition(by).sortWithinPartitions(by, "place").mapInArrow(run, candidates.schema)


def candidate_id(*parts: str) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)


def bigram_divergence(a: str, b: str) -> Column:
    """1 - Jaccard similarity of two texts' word bigrams; 0 if neither has any."""
    x, y = (_bigrams(F.col(c)) for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(x, y)) / union)


def _bigrams(text: Column) -> Column:
    return ngrams(text, 2)


def rewrite_gate(texts: Iterator[str]) -> list[bool]:
    """Whether candidate texts are free of surrogates."""
    return [not any(0xD800 <= ord(c) < 0xE000 for c in t) for t in texts]
