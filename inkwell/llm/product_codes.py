"""Vector code compression: product codes whose entries are found through ball trees.

Vectors become whole numbers (floor(factor * x)) and are cut into equal parts.
Each part position has a codebook, which starts as that part of the rows with
the smallest ids. In every round each part goes to its codebook's nearest entry
(squared Euclidean distance, ties to the lower index) and each entry becomes
the componentwise floor of the mean of its parts; an entry without parts stays.

Nearest entries are found in one ball tree a part position, for a batch of
vectors at once: a ball is visited unless its lower bound exceeds the best
distance known (non-strict, so ties are seen); centres are floating-point, so radii are rounded
up and bounds down; distances at the leaves are exact integers and alone decide.

Codebooks (parts x entries, a bounded table) travel with the tasks; each task
returns sums by part and entry, which Spark adds up. No vector is shuffled.

Defined results: rows whose vector is null, empty or holds null, NaN or
infinite components are dropped; the dimension is that of the smallest id whose
vector's length is a multiple of the parts, and vectors of other lengths are
dropped; rows without an id are coded, and come last when entries are chosen; of
rows with one id the smaller vector comes first; fewer rows than entries give as
many entries; repeated rows count each; components beyond ``LARGEST`` as whole
numbers raise an error, since their distances may leave the range of a long; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import NUMBER_ROWS, batch_rows, lean, materialize, worker_state

PARTS, ENTRIES, ROUNDS = 16, 64, 2
LEAF = 4
LARGEST = 1 << 26
#: Sums of more labels are joined without a broadcast.
BROADCAST_LABELS = 100_000
_UP, _DOWN, _TINY = 1 + 1e-12, 1 - 1e-12, 1e-9


class BallTree:
    """Balls around entries: median splits along the widest axis, leaves of up to ``LEAF`` entries."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF) -> None:
        self.entries = entries
        self.nodes: list[tuple] = []  # centre, radius, left, right, entries' numbers at a leaf
        self.visits = 0
        self._grow(np.arange(len(entries)), leaf)

    def _grow(self, own: np.ndarray, leaf: int) -> int:
        part = self.entries[own].astype(np.float64)
        centre = part.mean(0)
        radius = float(np.sqrt(((part - centre) ** 2).sum(1)).max()) * _UP + _TINY
        at = len(self.nodes)
        self.nodes.append((centre, radius, -1, -1, own))
        axis = int(np.ptp(part, axis=0).argmax())
        if len(own) > leaf and np.ptp(part[:, axis]) > 0:
            order = own[np.argsort(part[:, axis], kind="stable")]
            half = len(own) // 2
            left, right = self._grow(order[:half], leaf), self._grow(order[half:], leaf)
            self.nodes[at] = (centre, radius, left, right, None)
        return at

    def _distance(self, node: int, q: np.ndarray) -> np.ndarray:
        return np.sqrt(((q - self.nodes[node][0]) ** 2).sum(1))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each part's nearest entry and the squared distance (whole numbers)."""
        n = len(parts)
        best = np.full(n, np.iinfo(np.int64).max, np.int64)
        which = np.full(n, len(self.entries), np.int64)
        reals = parts.astype(np.float64)
        todo = [(0, np.arange(n), self._distance(0, reals))]
        while todo:
            node, rows, far = todo.pop()
            _, radius, left, right, own = self.nodes[node]
            low = np.maximum(far * _DOWN - radius - _TINY, 0.0)
            see = low * low * _DOWN <= best[rows]
            rows = rows[see]
            if not len(rows):
                continue
            self.visits += len(rows)
            if own is not None:
                for e in own.tolist():
                    d = ((parts[rows] - self.entries[e]) ** 2).sum(1)
                    better = (d < best[rows]) | ((d == best[rows]) & (e < which[rows]))
                    best[rows[better]] = d[better]
                    which[rows[better]] = e
                continue
            a, b = self._distance(left, reals[rows]), self._distance(right, reals[rows])
            near = a <= b
            for pick in (near, ~near):  # the farther child waits below the nearer one
                first, second = ((left, a), (right, b)) if pick is near else ((right, b), (left, a))
                todo.append((second[0], rows[pick], second[1][pick]))
                todo.append((first[0], rows[pick], first[1][pick]))
        return which, best


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", factor: int = 256) -> DataFrame:
    """vec_id, label, v (array of long: floor(factor * x)) of the rows whose vector is whole and finite."""
    fine = f"`{vec_col}` is not null and size(`{vec_col}`) > 0 and not exists(`{vec_col}`, x -> x is null or isnan(x) or abs(x) = double('Infinity'))"
    v = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * F.lit(float(factor))))
    large = F.lit(float(LARGEST) / factor)
    beyond = F.expr(fine) & F.exists(F.col(vec_col), lambda x: F.abs(x.cast("double")) >= large)  # however Catalyst orders it and the filter
    held = F.when(beyond, F.raise_error(F.lit(f"a component reaches {LARGEST} as a whole number"))).otherwise(v)
    return rows.filter(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), held.alias("v"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    v = batch.column("v")
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(v), -1)


def _assigned(books: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries (rows x parts) and squared distances of vectors."""
    state = worker_state("product-codes")
    if state.get("books") is None or not np.array_equal(state["books"], books):
        state["books"], state["trees"] = books, [BallTree(b) for b in books]
    which = np.empty((len(v), len(books)), np.int64)
    far = np.empty_like(which)
    width = books.shape[2]
    for p, tree in enumerate(state["trees"]):
        which[:, p], far[:, p] = tree.nearest(np.ascontiguousarray(v[:, p * width : (p + 1) * width]))
    return which, far


def _summing(books: np.ndarray):
    """Sums and counts of a task's parts by part position and entry."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch)
                which, _ = _assigned(books, v)
                for p in range(parts):
                    at = p * entries + which[:, p]
                    counts += np.bincount(at, minlength=len(counts))
                    np.add.at(sums, at, v[:, p * width : (p + 1) * width])
        seen = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen]), pa.array(list(sums[seen]), pa.list_(pa.int64()))], ["at", "n", "sums"])

    return run


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """The codebooks (parts x entries x components) after the rounds; None without rows. vectors: v of one length."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        return None
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        found = vectors.select("v").mapInArrow(_summing(books), "at bigint, n bigint, sums array<bigint>")
        total = found.groupBy("at").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(books.shape[2])))
        new = books.reshape(-1, books.shape[2]).copy()
        for r in total.collect():  # a row for each part position and entry
            new[r.at] = [s // r.n for s in r[2:]]
        books = new.reshape(books.shape)
    return books


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distances summed over parts)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            which, far = _assigned(books, _matrix(batch))
            codes = [bytes(r).hex() for r in which.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(far.sum(1))], ["vec_id", "label", "code", "error"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", "v").mapInArrow(run, f"vec_id bigint, label {kind}, code string, error bigint")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of vectors (vec_id, label, v)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    spark = vectors.sparkSession
    batch_rows(spark, NUMBER_ROWS)
    schema = "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"
    fit = vectors.filter(F.size("v") % parts == 0)
    one = fit.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    if not one:
        return spark.createDataFrame([], schema)
    fit = fit.filter(F.size("v") == len(one[0].v))
    books = train(fit, parts, entries, rounds)
    coded = materialize(encode(fit, books), "codes")
    by = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    by = materialize(by, "label-errors")
    by = F.broadcast(by) if by.count() <= BROADCAST_LABELS else by
    out = coded.join(by, coded.label.eqNullSafe(by.of))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, width: int = 4) -> str:
    """DuckDB SQL for ``compress`` over embeddings of parts * width components: every distance to every entry."""
    fine = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    columns = [f"x{i}" for i in range(width)]
    far = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in columns)
    steps = [
        f"v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e, unnest(range({parts})) AS p FROM embeddings WHERE {fine})",
        "a AS (SELECT vec_id, label, p, " + ", ".join(f"e[p * {width} + {i + 1}] AS {c}" for i, c in enumerate(columns)) + " FROM v)",
        f"c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, {', '.join(columns)} FROM a QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} AS (SELECT a.vec_id, a.label, a.p, b.k, {', '.join(f'a.{c}' for c in columns)}, {far} AS d FROM a JOIN c{r} b ON a.p = b.p)")
        steps.append(f"n{r} AS (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, k) = 1)")
        if r < rounds:
            means = ", ".join(f"CAST(floor(sum({c}) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS {c}" for c in columns)
            steps.append(f"m{r} AS (SELECT p, k, {means} FROM n{r} GROUP BY p, k)")
            steps.append(f"c{r + 1} AS (SELECT c.p, c.k, {', '.join(f'coalesce(m.{c}, c.{c}) AS {c}' for c in columns)} FROM c{r} c LEFT JOIN m{r} m ON m.p = c.p AND m.k = c.k)")
    listed = " || ',' || ".join(f"CAST({c} AS VARCHAR)" for c in columns)
    steps.append(f"book AS (SELECT sha256(string_agg({listed}, ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{rounds})")
    steps.append(f"coded AS (SELECT vec_id, label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM n{rounds} GROUP BY vec_id, label)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, book"
