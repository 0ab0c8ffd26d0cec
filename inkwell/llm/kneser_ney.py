"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model predicts characters. A text is cut at spaces; a word's characters and
its end are predicted from the four characters before them, at its start from
the kind of the previous word's last sign (letter, digit or the sign itself)
and the space. So a word's score depends on the word and that kind alone, and a
worker scores each word once.

Counts are taken over all trusted texts (none is sampled): per task first, then
summed by n-gram. Lower orders count distinct left extensions; each order has
its three discounts from its counts of counts; probabilities and back-off
weights come from equality joins of the sharded count tables on contexts and
suffixes. Four fifths of the trusted documents train the model; the rest give
its scores on text it hasn't seen.

Scoring ships the model in shards of at most ``SHARD_ROWS`` rows, dealt by the
two characters before the predicted one (all longer n-grams and contexts that a
prediction needs share them; orders one and two go with every shard). The
number of rows is counted first: one shard is scored in one pass over the
documents, more shards in as many passes, whose sums add up. Texts are never
shuffled for scoring.

A document's mean log probability a character is set against the median of its
language's held-out documents, scaled by the spread that its length has, and
accepted between two quantiles of the same measure over those documents, each
widened by ``MARGIN``. Both sides count: text far too predictable (one common
word over and over has a deviation of 13 and more on the test tables, where good
documents have 9 at most) is junk like noise is. Every language that has a held-out
document has limits around its own median. With n below ``MIN_DOCUMENTS`` of
them the quantiles are n / ``MIN_DOCUMENTS`` its own and for the rest those of
all documents, each taken around its own language's median.

Defined results: null texts and texts without any non-space character are
rejected (their perplexity is null); documents without a language, or of one
without held-out documents, use the common figures; without any trusted document all others are accepted; repeated
rows give a row each; several labels of a document count as trusted only if all
say so; an empty table gives no rows; extra columns pass through unchanged, but
for columns named as the three results, which these replace (a prefix keeps
both).
"""

from __future__ import annotations

import contextlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import TEXT_ROWS, batch_rows, discard, lean, materialize, worker_state

ORDER = 5
START, END = "\x02", "\x03"
SHARD_ROWS = 4_000_000
#: Held-out documents from which on a language's tails are its own alone.
MIN_DOCUMENTS = 100
#: Limits of more languages are joined without a broadcast.
BROADCAST_LANGUAGES = 10_000
#: The outer hundredths of held-out documents, widened: noise is some ten times as far out.
TAIL = 0.01
MARGIN = (2.0, 4.0)
#: Words after which a document's mean stops getting more certain.
LENGTH_SCALE = 2000.0
FOLDS = 5

_R = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Kinds(dict):
    def __missing__(self, c: str) -> str:
        kind = "a" if c.isalpha() else "0" if c.isdigit() else c
        self[c] = kind
        return kind


_KIND = _Kinds({"": " "})


def units(text: str) -> list[str]:
    """The words of a text, each after the kind of the sign before it and a space."""
    words = text.split(" ")
    kinds = [START]
    kinds += [_KIND[w[-1:]] for w in words]
    return [k + " " + w for k, w in zip(kinds, words, strict=False)]


def _codes(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of padded units, and the places to predict."""
    pad = START * (ORDER - 3)
    text = "".join([pad + u + END for u in some])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, some), np.int64, len(some)) + (ORDER - 2)
    place = np.ones(len(codes), bool)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    for i in range(ORDER - 1):
        place[begin + i] = False
    return codes, np.nonzero(place)[0]


def _keys(codes: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit key of the ``size`` characters that end at each place."""
    h = np.full(len(ends), size + 1, np.uint64)
    for j in range(size):
        h += codes[ends - j] * _R[j]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _string_keys(grams: list[str], size: int) -> np.ndarray:
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return _keys(codes, np.arange(1, len(grams) + 1) * size - 1, size)


def gram_counts(texts: DataFrame, flush_units: int = 50_000) -> DataFrame:
    """g, c: the full-order n-grams of all texts (column text)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("kneser-ney")
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            some, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
            codes, ends = _codes(some)
            weight = np.repeat(n, np.fromiter(map(len, some), np.int64, len(some)) - 1)
            key, once, which = np.unique(_keys(codes, ends, ORDER), return_index=True, return_inverse=True)
            total = np.bincount(which, weight).astype(np.int64)
            rows = codes[ends[once][:, None] + np.arange(1 - ORDER, 1)].astype("<u4")
            text = rows.tobytes().decode("utf-32-le", "surrogatepass")
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([text[i : i + ORDER] for i in range(0, len(text), ORDER)], pa.string()), pa.array(total)], ["g", "c"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    counts.update(units(t))
                    if len(counts) > flush_units:
                        yield out()
        if counts:
            yield out()

    return texts.select("text").mapInArrow(run, "g string, c bigint").groupBy("g").agg(F.sum("c").alias("c"))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the counts of counts n1..n4."""
    n1, n2, n3, n4 = (max(1, x) for x in n)
    y = n1 / (n1 + 2 * n2)
    return tuple(min(k, max(0.0, k - (k + 1) * y * b / a)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def estimate(full: DataFrame) -> DataFrame:
    """size, gram, logp, logbow of the model: every n-gram's probability and every context's back-off weight.

    full: g, c of the highest order.
    """
    counts = {ORDER: full}
    for k in range(ORDER - 1, 0, -1):  # distinct left extensions
        counts[k] = counts[k + 1].groupBy(F.substring("g", 2, k).alias("g")).agg(F.count(F.lit(1)).alias("c"))
    out, lower = None, None
    for k in range(1, ORDER + 1):
        c = counts[k].withColumn("h", F.substring("g", 1, k - 1) if k > 1 else F.lit(""))
        s = c.agg(*(F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)), F.count(F.lit(1)).alias("n")).first()
        d1, d2, d3 = discounts([s["n1"], s["n2"], s["n3"], s["n4"]])
        d = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        ctx = c.withColumn("d", d).groupBy("h").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("bow"))
        own = c.withColumn("own", F.greatest(F.col("c") - d, F.lit(0.0)))
        if k == 1:  # one context: its two numbers are literals
            one = ctx.first()
            p = own.select("g", (F.col("own") / F.lit(one["total"]) + F.lit(one["bow"] / (s["n"] + 1))).alias("p"))
            least = F.lit(1.0 / (s["n"] + 1))
            ctx = ctx.withColumn("bow", F.col("bow") * least)  # of an unseen character
        else:
            p = own.join(ctx, "h").join(lower.select(F.col("g").alias("g2"), F.col("p").alias("p2")), F.substring("g", 2, k - 1) == F.col("g2"))
            p = p.select("g", (F.col("own") / F.col("total") + F.col("bow") * F.col("p2")).alias("p"))
        p = materialize(p, f"kn{k}")
        grams = p.select(F.lit(k).alias("size"), F.col("g").alias("gram"), F.log("p").cast("float").alias("logp"), F.lit(None).cast("float").alias("logbow"))
        bows = ctx.select(F.lit(k - 1).alias("size"), F.col("h").alias("gram"), F.lit(None).cast("float").alias("logp"), F.log(F.greatest("bow", F.lit(1e-30))).cast("float").alias("logbow"))
        both = grams.unionByName(bows)
        out = both if out is None else out.unionByName(both)
        lower = p
    return out


class Shard:
    """Sorted keys and values of a model's rows."""

    def __init__(self, rows: list[tuple] | None = None, number: int = 0, of: int = 1) -> None:
        self.number, self.of = number, of
        self.p: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.bow: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.unseen = math.log(1e-6)

    def put(self, kind: dict, size: int, grams: list[str], values: np.ndarray) -> None:
        if size == 0:
            self.unseen = float(values[0])
            return
        keys = _string_keys(grams, size)
        order = np.argsort(keys)
        kind[size] = (keys[order], np.asarray(values, np.float32)[order])

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if table is None:
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        at = np.searchsorted(table[0], keys)
        at[at == len(table[0])] = 0
        return table[0][at] == keys, table[1][at]

    def score(self, some: list[str]) -> np.ndarray:
        """The summed log probability of each unit, of the places that belong to this shard."""
        codes, ends = _codes(some)
        owner = np.repeat(np.arange(len(some)), np.fromiter(map(len, some), np.int64, len(some)) - 1)
        if self.of > 1:
            mine = shard_of(codes[ends - 2], codes[ends - 1], self.of) == self.number
            ends, owner = ends[mine], owner[mine]
        out = np.zeros(len(ends))
        left = np.arange(len(ends))
        for size in range(ORDER, 0, -1):
            hit, value = self._find(self.p.get(size), _keys(codes, ends[left], size))
            out[left[hit]] += value[hit]
            left = left[~hit]
            if not len(left):
                break
            if size > 1:
                hit, value = self._find(self.bow.get(size - 1), _keys(codes, ends[left] - 1, size - 1))
                out[left[hit]] += value[hit]
        out[left] += self.unseen
        return np.bincount(owner, out, len(some))


def shard_of(a: np.ndarray, b: np.ndarray, shards: int) -> np.ndarray:
    h = (np.asarray(a, np.uint64) * _R[0]) ^ (np.asarray(b, np.uint64) * _R[1])
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


class Model:
    """The model's table and how many shards it takes."""

    def __init__(self, table: DataFrame, shard_rows: int = SHARD_ROWS) -> None:
        self.table = materialize(table, "kneser-ney")
        self.rows = self.table.count()
        self.shards = max(1, math.ceil(self.rows / shard_rows))

    def shard(self, number: int) -> Shard:
        """One shard on the driver: at most about SHARD_ROWS rows."""
        t = self.table
        if self.shards > 1:
            pair = F.when(F.col("logp").isNotNull(), F.substring("gram", -3, 2)).otherwise(F.substring("gram", -2, 2))
            every = (F.col("logp").isNotNull() & (F.col("size") < 3)) | (F.col("logp").isNull() & (F.col("size") < 2))
            a, b = F.ascii(pair).cast("long"), F.ascii(F.substring(pair, 2, 1)).cast("long")
            t = t.withColumn("a", a).withColumn("b", b).withColumn("every", every)

            def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for x in batches:
                    keep = x.column("every").to_numpy(zero_copy_only=False) | (shard_of(x.column("a").to_numpy(), x.column("b").to_numpy(), shards) == number)
                    yield x.filter(pa.array(keep)).select(["size", "gram", "logp", "logbow"])

            shards = self.shards
            t = t.mapInArrow(mine, "size int, gram string, logp float, logbow float")
        rows = t.toArrow().to_pandas()
        s = Shard(number=number, of=self.shards)
        for size, part in rows[rows.logp.notna()].groupby("size"):
            s.put(s.p, int(size), part.gram.tolist(), part.logp.to_numpy())
        for size, part in rows[rows.logbow.notna()].groupby("size"):
            s.put(s.bow, int(size), part.gram.tolist(), part.logbow.to_numpy())
        return s


def _scoring(shard, names: list[str], memo_units: int = 150_000):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("kneser-ney")
        model: Shard = shard.value
        memo: dict[str, float] = {}
        for batch in batches:
            texts = batch.column("_kn_text").to_pylist()
            sums = batch.column("_kn_logp").to_pylist()
            for at in range(0, len(texts), 256):
                some = [units(t) if t else [] for t in texts[at : at + 256]]
                if len(memo) > memo_units:
                    memo.clear()
                new = list(set().union(*some).difference(memo))
                for a in range(0, len(new), 10_000):
                    memo.update(zip(new[a : a + 10_000], model.score(new[a : a + 10_000]).tolist(), strict=True))
                get = memo.__getitem__
                for i, u in enumerate(some):
                    sums[at + i] += math.fsum(map(get, u))
            yield pa.RecordBatch.from_arrays([batch.column(c) if c != "_kn_logp" else pa.array(sums, pa.float64()) for c in names], names)

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with _kn_logp (summed natural log probability) and _kn_n (characters predicted); no text is shuffled."""
    out = docs.withColumns({"_kn_text": F.col(text_col), "_kn_logp": F.lit(0.0), "_kn_n": F.coalesce(F.length(text_col), F.lit(0)).cast("long") + 1})
    for number in range(model.shards):
        shared = docs.sparkSession.sparkContext.broadcast(model.shard(number))
        out = out.mapInArrow(_scoring(shared, out.columns), out.schema)
        if number + 1 < model.shards:
            out = materialize(out, "scores")
    return out.drop("_kn_text")


def trusted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, text, held of documents that the labels call good; held: kept for the thresholds."""
    said = lambda when: labels.filter(when).select("doc_id")
    good = docs.select("doc_id", "lang", "text").join(said("quality = 1"), "doc_id", "left_semi")
    good = good.join(said("quality <> 1"), "doc_id", "left_anti")
    return good.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0)


@contextlib.contextmanager
def _early_filter(spark: SparkSession) -> Iterator[None]:
    """Joins in here put a Bloom filter of the smaller side's keys (bounded by Spark's own limit) before the other side's shuffle."""
    settings = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _deviation(mid):
    n = F.col("_kn_n")
    return (F.col("_kn_logp") / n - mid) * F.sqrt(n / (1 + n / F.lit(LENGTH_SCALE * 6)))


def thresholds(scored: DataFrame, tail: float = TAIL, margin: tuple[float, float] = MARGIN) -> DataFrame:
    """lang (null: all together), mid, low, high from held-out documents' scores."""
    rows = materialize(scored.select("lang", "_kn_logp", "_kn_n"), "held")
    n = F.count(F.lit(1)).alias("n")
    mid = F.percentile_approx(F.col("_kn_logp") / F.col("_kn_n"), 0.5, 100_000).alias("mid")
    tails = [F.percentile_approx("z", tail, 100_000).alias("low"), F.percentile_approx("z", 1 - tail, 100_000).alias("high")]
    own = materialize(rows.filter("lang is not null").groupBy("lang").agg(n, mid), "medians")
    around = rows.join(own, "lang").withColumn("z", _deviation(F.col("mid")))
    pooled = around.agg(*tails).first()
    share = F.least(F.lit(1.0), F.col("n") / F.lit(float(MIN_DOCUMENTS)))
    by = around.groupBy("lang").agg(F.first("mid").alias("mid"), F.first("n").alias("n"), *tails)
    by = by.select("lang", "mid", *((share * F.col(c) + (1 - share) * F.lit(pooled[c]).cast("double")).alias(c) for c in ("low", "high")))
    whole = rows.agg(mid).first()["mid"]
    every = rows.withColumn("z", _deviation(F.lit(whole))).agg(*tails).select(F.lit(None).cast("string").alias("lang"), F.lit(whole).alias("mid"), "low", "high")
    return by.unionByName(every).withColumns({"low": F.col("low") * margin[0], "high": F.col("high") * margin[1]})


def classify(docs: DataFrame, labels: DataFrame, shard_rows: int = SHARD_ROWS, prefix: str = "") -> DataFrame:
    """docs with perplexity (a character), deviation and accepted; the prefix keeps these apart from columns of docs."""
    names = [prefix + c for c in ("perplexity", "deviation", "accepted")]
    batch_rows(docs.sparkSession, TEXT_ROWS)
    with _early_filter(docs.sparkSession):
        trusted = materialize(trusted_documents(docs, labels), "trusted")
    has_words = F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    if trusted.filter("text <> ''").isEmpty():
        return docs.withColumns(dict(zip(names, (F.lit(None).cast("double"), F.lit(None).cast("double"), has_words), strict=True)))
    seen = trusted.filter("not held and text <> ''")
    train = trusted.filter("text <> ''") if seen.isEmpty() else seen
    full = materialize(gram_counts(train), "grams")
    model = Model(estimate(full), shard_rows)
    held = trusted.filter("held").filter(has_words)
    held = trusted.filter(has_words) if held.isEmpty() else held
    limits = materialize(thresholds(score(held, model)), "limits")
    common = limits.filter("lang is null").first()
    table = limits.filter("lang is not null").select(*(F.col(c).alias(f"_kn_{c}") for c in ("lang", "mid", "low", "high")))
    if table.count() <= BROADCAST_LANGUAGES:
        table = F.broadcast(table)
    discard(trusted)
    scored = score(docs, model)
    joined = scored.join(table, F.col("lang") == F.col("_kn_lang"), "left")
    mid, low, high = (F.coalesce(f"_kn_{c}", F.lit(float(common[c]))) for c in ("mid", "low", "high"))
    z = F.when(has_words, _deviation(mid))
    made = (F.when(has_words, F.exp(-F.col("_kn_logp") / F.col("_kn_n"))), z, F.coalesce((z >= low) & (z <= high), F.lit(False)))
    out = joined.withColumns(dict(zip(names, made, strict=True)))
    return out.drop("_kn_logp", "_kn_n", "_kn_lang", "_kn_mid", "_kn_low", "_kn_high")


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
