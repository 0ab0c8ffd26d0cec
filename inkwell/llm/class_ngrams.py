"""Language-model scoring by Brown's class-based n-grams.

Exchange clustering assigns words to classes; a text's probability is the
product of class transitions P(class | two classes before) and emissions
P(word | class), over its words and its end.

Units. A word with at least 1 / ``SHARE`` of the training tokens (and ``LEAST``
occurrences) is a unit of its own, so there are at most ``SHARE`` of them
whatever the input. Every other word stands for its form, the last three bytes of its
UTF-8 or, for rarer endings, the last byte; forms are units too. So every word has a class, also one
never seen; its own count still gives its emission.

Clustering. Unit bigrams are counted over all training texts: each task counts
its own, tasks' counts are merged by the hash of the pair (no pair of a hot
word meets more than the other pairs do) and then dealt by unit, where a unit
has at most as many neighbours as there are units. Each round finds, for a
share of the units, the class that raises the bigram likelihood most, against
the same class bigram counts, so the outcome does not depend on how units are
dealt to tasks. A round that lowers the likelihood is taken back and smaller
shares follow. Class counts, the classes and the trigram table are
bounded by ``CLASSES`` and travel with the tasks.

Smoothing. Transitions are discounted and interpolated from three classes to two
and one. Emissions are discounted by the words' own counts of counts, and what
that frees in a class with forms is the probability of an unknown word there; so known words and the
unknown one of each context sum to one.

Scoring. Texts are encoded once (units, and hashes of the words that are no
units). Counts of the latter come by an equality join of each text's distinct
rare words with the table of all words, of which no task or driver holds more
than its share. Words are told apart by 64-bit hashes: among 10**8 words two
are alike with a chance of 0.0003.

Defined results: a null text is empty and has its end alone; A-Z are
lower-cased, nothing else; a row without an id is held out (as the CRC-32 of
nothing); rows with one id are scored each; without training texts N is 0 and
both scores are those of the base (0); a text of any length is one row of the
encoded table; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import NUMBER_ROWS, TEXT_ROWS, batch_rows, by_bytes, discard, lean, materialize, worker_state
from inkwell.llm.substrings import Hasher

CLASSES = 128
SHARE = 1 << 18
LEAST = 5
ROUNDS = 10
#: A unit is looked at in every third round.
TURNS = 3
#: Bytes of text and tokens that a task works on at a time; distinct words that it holds.
PIECE, CHUNK, HELD = 1 << 19, 1 << 20, 1 << 18
#: Training tokens for each bucket of pairs and for each group of units, buckets and groups at most, and rows of an Arrow batch of them.
BUCKET_TOKENS, BUCKETS, GROUP_TOKENS, GROUPS = 1 << 21, 1 << 14, 1 << 18, 1 << 13
BLOB_ROWS = 4


def _tokens(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches cut by bytes, with their words' hashes, forms (last three bytes as a number) and rows."""
    state = worker_state("class-ngrams")
    hasher: Hasher = state.setdefault("hasher", Hasher())
    for batch in batches:
        for part in by_bytes(iter([batch]), "text", PIECE):
            texts = [b"" if t is None else t for t in part.column("text").cast(pa.binary()).to_pylist()]
            raw = np.frombuffer(b" ".join(texts).lower(), np.uint8)
            begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
            first, last = hasher.places(raw)
            form = np.zeros(len(first), np.int64)
            for back in (1, 2, 3):
                here = last - back
                inside = here >= first
                form += np.where(inside, raw[np.maximum(here, 0)].astype(np.int64) if len(raw) else 0, 0) << (8 * (back - 1))
            yield part.select(keep), hasher.word_hash(raw, first, last, 0).view(np.int64), form, np.diff(np.searchsorted(first, begin))


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their summed counts, and where each first stood."""
    if not len(keys):
        return keys, counts, np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.nonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[0]
    return keys[first], np.add.reduceat(counts[order], first), order[first]


def word_counts(texts: DataFrame) -> DataFrame:
    """w (hash), form, c of all words of the texts."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, forms, counts, loose = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def merged() -> None:
            nonlocal keys, forms, counts
            k = np.concatenate((keys, *(x for x, _ in loose)))
            f = np.concatenate((forms, *(x for _, x in loose)))
            keys, counts, at = _sums(k, np.concatenate((counts, np.ones(len(k) - len(counts), np.int64))))
            forms = f[at]
            loose.clear()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(forms), pa.array(counts)], ["w", "form", "c"])

        for _, h, form, _ in _tokens(batches, []):
            loose.append((h, form))
            if sum(len(x) for x, _ in loose) > CHUNK:
                merged()
                if len(keys) > HELD:
                    yield out()
                    keys = forms = counts = np.zeros(0, np.int64)
        merged()
        yield out()

    return texts.select("text").mapInArrow(run, "w bigint, form bigint, c bigint").groupBy("w").agg(F.max("form").alias("form"), F.sum("c").alias("c"))


@dataclass
class Units:
    """The units and their numbers: 0 is a text's end, then words, endings of three bytes, last bytes."""

    words: np.ndarray
    forms: np.ndarray
    counts: np.ndarray
    types: np.ndarray

    def __len__(self) -> int:
        return 1 + len(self.words) + len(self.forms) + 256

    @property
    def first_form(self) -> int:
        return 1 + len(self.words)

    def numbers(self, h: np.ndarray, form: np.ndarray) -> np.ndarray:
        def found(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(table, x)
            at[at == len(table)] = 0
            return (table[at] == x if len(table) else np.zeros(len(x), bool)), at

        hit, at = found(self.words, h)
        out = at + 1
        rest = np.nonzero(~hit)[0]
        hit, at = found(self.forms, form[rest])
        out[rest] = np.where(hit, self.first_form + at, self.first_form + len(self.forms) + (form[rest] & 255))
        return out.astype(np.int32)


def choose_units(words: DataFrame, tokens: int, ends: int, share: int = SHARE) -> tuple[Units, float]:
    """The units (at most ``share`` words and as many endings come to the driver) and the least count of a word of its own."""
    least = max(LEAST, tokens / share)
    own = words.filter(F.col("c") >= least).select("w", "c").toArrow()
    rare = words.filter(F.col("c") < least)
    forms = rare.groupBy("form").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("t"))
    held = forms.filter(F.col("c") >= least).toArrow()
    loose = forms.filter(F.col("c") < least).groupBy((F.col("form").bitwiseAND(F.lit(255))).alias("b")).agg(F.sum("c").alias("c"), F.sum("t").alias("t")).toArrow()
    w, f = (t.column(0).to_numpy().astype(np.int64) for t in (own, held))
    by_w, by_f = np.argsort(w), np.argsort(f)
    bytes_c, bytes_t = np.zeros(256, np.int64), np.zeros(256, np.int64)
    at = loose.column("b").to_numpy().astype(np.int64)
    bytes_c[at], bytes_t[at] = loose.column("c").to_numpy(), loose.column("t").to_numpy()
    counts = np.concatenate(([ends], own.column("c").to_numpy()[by_w], held.column("c").to_numpy()[by_f], bytes_c)).astype(np.int64)
    types = np.concatenate(([1], np.ones(len(w), np.int64), held.column("t").to_numpy()[by_f], bytes_t)).astype(np.int64)
    return Units(w[by_w], f[by_f], counts, types), least


def encode(docs: DataFrame, units: Units) -> DataFrame:
    """row, doc_id, train, n (tokens), ids (32-bit unit numbers, the end last), rare (hashes of words that are no units, in order)."""
    shared = docs.sparkSession.sparkContext.broadcast(units)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u: Units = shared.value
        for part, h, form, sizes in _tokens(batches, ["doc_id", "train"]):
            ids = u.numbers(h, form)
            far = ids >= u.first_form
            cuts = np.concatenate(([0], np.cumsum(sizes))).tolist()
            end = np.zeros(1, np.int32).tobytes()
            coded = [ids[a:b].tobytes() + end for a, b in zip(cuts, cuts[1:], strict=False)]
            rare = [h[a:b][far[a:b]].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes + 1), pa.array(coded, pa.binary()), pa.array(rare, pa.binary())], ["doc_id", "train", "n", "ids", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.mapInArrow(run, f"doc_id {kind}, train boolean, n bigint, ids binary, rare binary")
    return out.withColumn("row", F.monotonically_increasing_id())


def _streams(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK) -> Iterator[np.ndarray]:
    """Unit numbers of whole texts, some at a time, one text behind the other (each closes with 0)."""
    held, n = [], 0
    for batch in batches:
        for x in batch.column(0).to_pylist():
            held.append(np.frombuffer(x, np.int32))
            n += len(held[-1])
            if n >= chunk:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


def _buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _dealt(names: list[str], fixed: list, where: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row for each value of ``where``: it, the fixed values, its keys and counts."""
    order = np.argsort(where, kind="stable")
    where, keys, counts = where[order], keys[order], counts[order]
    cuts = np.concatenate((np.nonzero(np.concatenate(([True], where[1:] != where[:-1])))[0], [len(where)])) if len(where) else np.zeros(1, np.int64)
    spans = list(zip(cuts.tolist(), cuts.tolist()[1:], strict=False))
    columns = [pa.array(where[cuts[:-1]], pa.int64()), *(pa.array([x] * len(spans), pa.int64()) for x in fixed), pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names)


def unit_neighbours(encoded: DataFrame, units: int, tokens: int) -> DataFrame:
    """x, c, y, d: for each group of units the bigrams that its units begin (x, counts c) and end (y, counts d).

    x, y: unit * units + neighbour, sorted.
    """
    spark = encoded.sparkSession
    buckets = max(1, min(BUCKETS, tokens // BUCKET_TOKENS))
    groups = max(1, min(GROUPS, tokens // GROUP_TOKENS))

    @lean
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in _streams(batches):
            ids = ids.astype(np.int64)
            before = np.concatenate(([0], ids[:-1]))
            keys, counts = np.unique(before * units + ids, return_counts=True)
            yield _dealt(["b", "keys", "n"], [], _buckets(keys, buckets), keys, counts.astype(np.int64))

    @lean
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, n, least = None, [], 0, 0

        def close() -> tuple[np.ndarray, np.ndarray]:
            keys, counts, _ = _sums(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            return keys, counts

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = close()
            a, b = np.divmod(keys, units)
            for side, (u, v) in enumerate(((a, b), (b, a))):
                yield _dealt(["g", "side", "keys", "n"], [side], u % groups, u * units + v, counts)

        for batch in batches:
            for b, k, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if b != bucket:
                    if held:
                        yield from out()
                    bucket, held, n, least = b, [], 0, 0
                held.append((np.frombuffer(k, np.int64), np.frombuffer(c, np.int64)))
                n += len(held[-1][0])
                if n > max(BUCKET_TOKENS, 2 * least):  # merged again when as much again has come
                    held = [close()]
                    n = least = len(held[0][0])
        if held:
            yield from out()

    @lean
    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, ([], [])

        def out() -> pa.RecordBatch:
            columns = []
            for side in held:
                keys, counts = (np.concatenate([x[i] for x in side]) if side else np.zeros(0, np.int64) for i in (0, 1))
                keys, counts, _ = _sums(keys, counts)
                columns += [pa.array([keys.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["x", "c", "y", "d"])

        for batch in batches:
            for g, side, k, c in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if g != group:
                    if group is not None:
                        yield out()
                    group, held = g, ([], [])
                held[side].append((np.frombuffer(k, np.int64), np.frombuffer(c, np.int64)))
        if group is not None:
            yield out()

    src = encoded.filter("train").select("ids")
    batch_rows(spark, TEXT_ROWS)
    parts = materialize(src.mapInArrow(counted, "b bigint, keys binary, n binary"), "bigrams")
    batch_rows(spark, BLOB_ROWS)
    by = "g bigint, side bigint, keys binary, n binary"
    pairs = materialize(parts.repartition("b").sortWithinPartitions("b").mapInArrow(merged, by), "pairs")
    discard(parts)
    batch_rows(spark, NUMBER_ROWS if groups > 256 else 64)
    out = materialize(pairs.repartition("g").sortWithinPartitions("g").mapInArrow(gathered, "x binary, c binary, y binary, d binary"), "neighbours")
    discard(pairs)
    return out


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(n: np.ndarray) -> float:
    """The class bigrams' part of the log likelihood."""
    return float(_phi(n).sum() - _phi(n.sum(1)).sum() - _phi(n.sum(0)).sum())


def best_class(own: int, follow: np.ndarray, lead: np.ndarray, twice: float, n: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[int, float]:
    """The class (of all but the last, the texts' ends) that a unit gains most by, and the gain.

    follow, lead: the unit's counts with the classes behind and before it; twice: with itself. n: class bigrams, left as given.
    """
    k = len(n) - 1
    r, f = follow.copy(), lead.copy()
    r[own] -= twice
    f[own] -= twice
    all_r, all_f = r.sum() + twice, f.sum() + twice
    kept = n[own].copy(), n[:, own].copy()
    n[own] -= r
    n[:, own] -= f
    n[own, own] -= twice
    gain = np.zeros(k)
    for part, counts in ((n[:k], r), (n[:, :k].T, f)):
        at = np.nonzero(counts)[0]
        block = part[:, at]
        gain += (_phi(block + counts[at]) - _phi(block)).sum(1)
    d = np.diagonal(n)[:k]
    here = _phi(d)
    gain += here - _phi(d + r[:k]) + here - _phi(d + f[:k]) + _phi(d + r[:k] + f[:k] + twice) - here
    for total, more in ((rows, all_r), (columns, all_f)):
        rest = total[:k].copy()
        rest[own] -= more
        gain -= _phi(rest + more) - _phi(rest)
    n[own], n[:, own] = kept
    best = int(gain.argmax())
    return best, float(gain[best] - gain[own])


def _class_counts(keys: np.ndarray, counts: np.ndarray, classes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of a group, their counts by the neighbours' classes, and with themselves."""
    unit, other = np.divmod(keys, len(classes))
    own, local = np.unique(unit, return_inverse=True)
    table = np.bincount(local * k + classes[other], counts, len(own) * k).reshape(len(own), k)
    same = np.zeros(len(own))
    twice = unit == other
    same[local[twice]] = counts[twice]
    return own, table, same


def cluster(neighbours: DataFrame, units: Units, classes: int = CLASSES, rounds: int = ROUNDS, turns: int = TURNS) -> tuple[np.ndarray, list[float]]:
    """Each unit's class (the end has one of its own, the last) and the likelihood after each round that was kept."""
    k = classes + 1
    of = np.empty(len(units), np.int16)
    of[np.argsort(-units.counts[1:], kind="stable") + 1] = np.arange(len(units) - 1) % classes
    of[0] = classes

    def class_bigrams(of: np.ndarray) -> np.ndarray:
        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(k * k)
            for batch in batches:
                for x, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    a, b = np.divmod(np.frombuffer(x, np.int64), len(of))
                    n += np.bincount(of[a].astype(np.int64) * k + of[b], np.frombuffer(c, np.int64), k * k)
            at = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at].astype(np.int64))], ["at", "n"])

        found = neighbours.select("x", "c").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(k * k)
        out[found.column(0).to_numpy()] = found.column(1).to_numpy()
        return out.reshape(k, k)

    def moves(of: np.ndarray, n: np.ndarray, turn: int, turns: int) -> tuple[np.ndarray, np.ndarray]:
        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = n.copy()
            rows, columns = table.sum(1), table.sum(0)
            for batch in batches:
                at, to = [], []
                for x, c, y, d in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    sides = []
                    for keys, counts in ((x, c), (y, d)):
                        keys, counts = (np.frombuffer(v, np.int64) for v in (keys, counts))
                        mine = _buckets(keys // len(of), turns) == turn
                        sides.append(_class_counts(keys[mine], counts[mine], of, k))
                    (u, follow, twice), (v, lead, _) = sides
                    both = np.union1d(u, v)
                    r, f, s = np.zeros((len(both), k)), np.zeros((len(both), k)), np.zeros(len(both))
                    r[np.searchsorted(both, u)], s[np.searchsorted(both, u)], f[np.searchsorted(both, v)] = follow, twice, lead
                    for i, unit in enumerate(both.tolist()):
                        if unit:
                            best, gain = best_class(int(of[unit]), r[i], f[i], s[i], table, rows, columns)
                            if gain > 1e-6:
                                at.append(unit)
                                to.append(best)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(to, pa.int64())], ["at", "to"])

        found = neighbours.mapInArrow(run, "at bigint, to bigint").toArrow()
        return found.column(0).to_numpy(), found.column(1).to_numpy()

    batch_rows(neighbours.sparkSession, BLOB_ROWS)
    kept, said = (of, class_bigrams(of)), []
    said.append(likelihood(kept[1]))
    for turn in range(rounds):
        at, to = moves(*kept, turn % turns, turns)
        new = kept[0].copy()
        new[at] = to
        n = class_bigrams(new)
        value = likelihood(n)
        if value >= said[-1]:
            kept = new, n
            said.append(value)
        else:  # moves of many units spoilt each other
            turns *= 2
    return kept[0], said


@dataclass
class Model:
    """What scoring needs of each unit and class; logarithms to base ten."""

    of: np.ndarray  # classes of units
    step: np.ndarray  # transition from two classes
    emit: np.ndarray  # of a word that is a unit; of other words the part that its class gives
    base: np.ndarray  # log10(c + 0.1) of a word that is a unit
    unknown: np.ndarray  # of classes: an unknown word's emission, but for the class's part
    first_form: int


def _interpolated(c: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Discounted shares of the last axis, interpolated with lower."""
    n1, n2 = int((c == 1).sum()), int((c == 2).sum())
    d = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.1
    total = c.sum(-1, keepdims=True)
    free = np.where(total > 0, d * (c > 0).sum(-1, keepdims=True), 1.0)
    return (np.maximum(c - d, 0.0) + free * lower) / np.maximum(total, 1.0)


def class_trigrams(encoded: DataFrame, of: np.ndarray, k: int) -> np.ndarray:
    """Counts of three classes in a row, over all training texts."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(k**3, np.int64)
        for ids in _streams(batches):
            n += np.bincount(_steps(of, ids, k), minlength=k**3)
        at = np.nonzero(n)[0]
        for s in range(0, len(at), 1 << 17):
            some = at[s : s + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["at", "n"])

    batch_rows(encoded.sparkSession, TEXT_ROWS)
    found = encoded.filter("train").select("ids").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k**3)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out.reshape(k, k, k)


def _steps(of: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The place of each token's transition in the table; a text begins as if two ends stood before it."""
    c = of[ids].astype(np.int64)
    end = k - 1
    one = np.concatenate(([end], c[:-1]))
    two = np.concatenate(([end], one[:-1]))
    two[one == end] = end
    return (two * k + one) * k + c


def build_model(units: Units, of: np.ndarray, trigrams: np.ndarray, discount: float) -> Model:
    k = len(trigrams)
    two = trigrams.sum(0)
    one = two.sum(0)
    p1 = one / max(1.0, one.sum())
    step = _interpolated(trigrams, _interpolated(two, p1)[None])
    first = units.first_form
    of = of.copy()
    types = np.bincount(of, units.types, k)
    typical = int(np.bincount(of[first:], units.types[first:], k).argmax())
    unseen = np.arange(first, len(units))[units.counts[first:] == 0]
    of[unseen] = typical  # an ending never seen goes with most other rare words
    with_forms = np.zeros(k, bool)
    with_forms[of[first:]] = True
    with np.errstate(divide="ignore"):
        total = np.log10(one)
        emit = -total[of]
        freed = np.where(with_forms, discount, 0.0)
        emit[1:first] += np.log10(units.counts[1:first] - freed[of[1:first]])
        emit[0] = 0.0
        base = np.log10(units.counts + 0.1)
        base[first:] = 0.0
        unknown = np.where(with_forms & (types > 0), np.log10(np.maximum(discount * types, 1e-9)), 0.0)
        return Model(of, np.log10(step).astype(np.float32).reshape(-1), emit, base, unknown, first)


def _texts_scores(encoded: DataFrame, shared, k: int) -> DataFrame:
    """row, doc_id, train, n, known, base, score: without what the counts of rare words give."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            texts = [np.frombuffer(x, np.int32) for x in batch.column("ids").to_pylist()]
            if not texts:
                continue
            known, base, score, at = [], [], [], 0
            while at < len(texts):
                to, n = at, 0
                while to < len(texts) and (to == at or n + len(texts[to]) <= CHUNK):
                    n += len(texts[to])
                    to += 1
                ids = np.concatenate(texts[at:to])
                cuts = np.cumsum([0, *(len(t) for t in texts[at:to])])[:-1]
                own = ids < m.first_form
                for out, values in ((known, own.astype(np.int64)), (base, m.base[ids]), (score, m.step[_steps(m.of, ids, k)] + m.emit[ids])):
                    out.append(np.add.reduceat(values, cuts))
                at = to
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "train", "n")), *(pa.array(np.concatenate(x)) for x in (known, base, score))], ["row", "doc_id", "train", "n", "known", "base", "score"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("row", "doc_id", "train", "n", "ids").mapInArrow(run, f"row bigint, doc_id {kind}, train boolean, n bigint, known bigint, base double, score double")


def _rare_words(encoded: DataFrame, shared) -> DataFrame:
    """row, w, m (occurrences), u (its emission if it is unknown) of each text's distinct words that are no units."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for row, ids, rare in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                w = np.frombuffer(rare, np.int64)
                if not len(w):
                    continue
                ids = np.frombuffer(ids, np.int32)
                w, m, at = _sums(w, np.ones(len(w), np.int64))
                u = model.unknown[model.of[ids[ids >= model.first_form][at]]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), row)), pa.array(w), pa.array(m.astype(np.int32)), pa.array(u)], ["row", "w", "m", "u"])

    return encoded.select("row", "ids", "rare").mapInArrow(run, "row bigint, w bigint, m int, u double")


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, share: int = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row, learning from the rows where train is true."""
    spark = docs.sparkSession
    batch_rows(spark, TEXT_ROWS)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    words = materialize(word_counts(src.filter("train")), "words")
    ends = src.filter("train").count()
    said = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
    tokens, kinds = said["n"] + ends, said["v"] + (ends > 0)
    units, least = choose_units(words, tokens, ends, share)
    encoded = materialize(encode(src, units), "encoded")
    k = classes + 1
    if ends:
        of, _ = cluster(unit_neighbours(encoded, len(units), tokens), units, classes, rounds)
        discount = min(0.9, max(0.1, said["n1"] / max(1, said["n1"] + 2 * said["n2"])))
        model = build_model(units, of, class_trigrams(encoded, of, k), discount)
    else:
        discount = 0.0
        nothing = np.zeros(len(units))
        model = Model(np.zeros(len(units), np.int16), np.zeros(k**3, np.float32), nothing, nothing, np.zeros(k), units.first_form)
    shared = spark.sparkContext.broadcast(model)
    batch_rows(spark, TEXT_ROWS)
    texts = _texts_scores(encoded, shared, k)
    counted = words.filter(F.col("c") < least).select("w", "c")
    rare = _rare_words(encoded, shared).join(counted.hint("merge"), "w", "left")
    c = F.col("c")
    per_row = rare.groupBy("row").agg(
        F.sum(F.when(c.isNotNull(), F.col("m")).otherwise(0)).alias("known2"),
        F.sum(F.col("m") * F.log10(F.coalesce(c, F.lit(0)) + 0.1)).alias("base2"),
        F.sum(F.col("m") * F.when(c.isNotNull(), F.log10(c - F.lit(discount))).otherwise(F.col("u"))).alias("score2"),
    )
    zero = F.lit(0.0)
    unit_mass = math.log10(tokens + 0.1 * (kinds + 1))
    base = F.col("base") + F.coalesce("base2", zero) - F.col("n") * F.lit(unit_mass) if ends else zero
    total = F.col("score") + F.coalesce("score2", zero) if ends else zero
    out = texts.join(per_row, "row", "left")
    known = F.col("known") + F.coalesce("known2", F.lit(0)) if ends else F.lit(0).cast("long")
    return out.select("doc_id", (~F.col("train")).alias("held_out"), F.col("n").alias("n_tokens"), known.alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), total.alias("score"))


def every_tenth_held(id_col: str = "doc_id") -> Column:
    """Whether a row is learnt from: all but those whose id, as text, has a CRC-32 divisible by ten."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 != 0, F.lit(False))
