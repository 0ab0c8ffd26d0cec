"""Budgets, event logs, outcomes and settings: running sums, sequences and decision tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

#: A rewrite's edit limits (characters, tokens, drift) by strength, and provider names.
EDIT_LIMITS = {"light": (0.20, 0.25, 0.10), "medium": (0.50, 0.55, 0.15), "strong": (0.70, 0.75, 0.25)}
PROVIDERS = {
    "anthropic": "anthropic", "claude": "anthropic", "openai": "openai", "chatgpt": "openai", "codex": "openai", "google": "google",
    "gemini": "google", "local": "local", "ollama": "local", "meta": "meta-llama", "llama": "meta-llama", "meta-llama": "meta-llama",
}
LAYERS = ("cli", "environment", "project", "user", "preset", "default")


def admit(requests: DataFrame, by: str, order: list[str], cost: str, limit: float) -> DataFrame:
    """requests with admitted (its cost still fits what is left of the limit) and spent (the admitted costs up to it).

    A refused request spends nothing, so a sum over a window can't tell: each
    key's requests are read in order as a stream that holds its sum alone. A
    null cost is nothing; a negative one is refused.
    """
    names = requests.columns
    kind = "bigint" if requests.schema[cost].dataType.typeName() in ("byte", "short", "integer", "long") else "double"
    number = pa.int64() if kind == "bigint" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, used = (), 0
        for batch in batches:
            spent, admitted = [], []
            for k, c in zip(batch.column(by).to_pylist(), batch.column(cost).to_pylist(), strict=True):
                if (k,) != key:
                    key, used = (k,), 0
                c = c or 0
                ok = 0 <= c <= limit - used
                used += c if ok else 0
                spent.append(used)
                admitted.append(ok)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(spent, number), pa.array(admitted, pa.bool_())], [*names, "spent", "admitted"])

    schema = StructType([*requests.schema.fields, StructField("spent", LongType() if kind == "bigint" else DoubleType()), StructField("admitted", BooleanType())])
    return requests.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


class Account:
    """What one key has spent and reserved: a limit and its open leases (reserved, settled so far)."""

    def __init__(self, limit: float, spent: float = 0, leases: dict | None = None) -> None:
        self.limit, self.spent, self.leases = limit, spent, dict(leases or {})

    @property
    def reserved(self) -> float:
        return sum(r for r, _ in self.leases.values())

    def act(self, action: str, lease, amount) -> str:
        """ok, or why not: refused (over what is left), overrun (settled beyond the reservation), negative, duplicate, unknown."""
        amount = amount or 0
        if action == "reserve":
            if lease in self.leases:
                return "duplicate"
            if amount < 0:
                return "negative"
            if amount > self.limit - self.spent - self.reserved:
                return "refused"
            self.leases[lease] = (amount, 0)
        elif action not in ("settle", "close") or lease not in self.leases:
            return "unknown"
        elif action == "settle":
            if amount < 0:
                return "negative"
            if amount > self.leases[lease][0]:
                return "overrun"
            self.leases[lease] = (self.leases[lease][0], amount)
        else:
            self.spent += self.leases.pop(lease)[1]
        return "ok"


def leases(requests: DataFrame, by: str, order: list[str], limit: float) -> DataFrame:
    """requests (by, action, lease, amount) with outcome, spent, reserved and remaining after each, in order.

    reserve holds an amount back, settle says what was used (at most that), close
    gives back what is left; a lease closed without being settled costs nothing. Requests of a
    key come as a stream in their order that holds the key's open leases alone; one
    task reads all of a key, so the largest key bounds the job. Null amounts are nothing.
    """
    names = requests.columns
    whole = requests.schema["amount"].dataType.typeName() in ("byte", "short", "integer", "long")
    number = pa.int64() if whole else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, account = None, None
        for batch in batches:
            rows = []
            for k, action, lease, amount in zip(*(batch.column(c).to_pylist() for c in (by, "action", "lease", "amount")), strict=True):
                if account is None or k != key:
                    key, account = k, Account(limit)
                outcome = account.act(action, lease, amount)
                rows.append((outcome, account.spent, account.reserved, account.limit - account.spent - account.reserved))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            made = [pa.array(list(c), t) for c, t in zip(columns, (pa.string(), number, number, number), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made], [*names, "outcome", "spent", "reserved", "remaining"])

    amount = LongType() if whole else DoubleType()
    schema = StructType([*requests.schema.fields, StructField("outcome", StringType()), *(StructField(c, amount) for c in ("spent", "reserved", "remaining"))])
    return requests.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


def usage(charges: DataFrame, by: str = "run_id") -> DataFrame:
    """by, counter, spent."""
    return charges.groupBy(by, "counter").agg(F.sum("amount").alias("spent"))


def sequence(events: DataFrame, by: str, order: list[str]) -> DataFrame:
    """events with a gap-free number from 0."""
    return events.withColumn("sequence", (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).cast("long"))


def stagnation(rounds: DataFrame, by: str = "doc_id") -> DataFrame:
    """rounds (by, round, risk) with best so far and how many rounds in a row brought nothing better."""
    w = Window.partitionBy(by).orderBy("round")
    r = rounds.withColumn("best", F.min("risk").over(w)).withColumn("before", F.lag("best").over(w))
    r = r.withColumn("better", F.col("before").isNull() | (F.col("best") < F.col("before")))
    island = F.sum(F.col("better").cast("int")).over(w)
    r = r.withColumn("island", island)
    since = F.row_number().over(Window.partitionBy(by, "island").orderBy("round")) - 1
    return r.withColumn("stagnant", since).select(by, "round", "risk", "best", "stagnant")


def provider(name: Column) -> Column:
    """The family of a provider or model name."""
    first = F.split(F.replace(F.lower(F.trim(name)), F.lit("_"), F.lit("-")), "/")[0]
    out = None
    for alias, family in PROVIDERS.items():
        out = F.when(first == alias, family) if out is None else out.when(first == alias, family)
    return out.otherwise(first)


def separated(rows: DataFrame, source: str = "source_provider", rewrite: str = "rewrite_provider") -> DataFrame:
    """Rows whose two providers belong to different families."""
    return rows.filter(provider(F.col(source)) != provider(F.col(rewrite)))


def precedence(settings: DataFrame) -> DataFrame:
    """key, value, layer: of each key the value of the strongest layer. settings: key, layer, value."""
    rank = F.array_position(F.array(*(F.lit(x) for x in LAYERS)), F.col("layer"))
    return settings.groupBy("key").agg(F.min_by(F.struct("value", "layer"), rank).alias("s")).select("key", "s.value", "s.layer")


def threshold_met(score: Column, threshold: Column, direction: Column) -> Column:
    """Whether a score is on the safe side of a threshold or at it; direction: which scores are riskier (higher, lower)."""
    return F.when(direction == "higher", score <= threshold).otherwise(score >= threshold)


def target_met(mode: Column, kind: Column, base: Column, score: Column, threshold: Column, least: Column, direction: Column | None = None) -> Column:
    """Whether a candidate's score meets a target; a surrogate can verify nothing.

    direction: which scores are riskier (higher unless given); reductions are those of the risk.
    """
    direction = F.lit("higher") if direction is None else direction
    gain = F.when(direction == "higher", base - score).otherwise(score - base)
    return (
        F.when(score.isNull(), False)
        .when(mode == "verify_below_threshold", (kind != "surrogate") & F.coalesce(threshold_met(score, threshold, direction), F.lit(False)))
        .when(mode == "relative_reduction", F.coalesce((gain > 0) & (gain >= least), F.lit(False)))
        .when(mode == "minimize_surrogate", F.coalesce((kind == "surrogate") & (gain > least), F.lit(False)))
        .otherwise(False)
    )


def unsupported(mode: Column, kind: Column, detectors: Column, detector: Column) -> Column:
    """Why a target can't be measured, or null."""
    return (
        F.when(mode == "sanitize_only", "sanitation is not a search")
        .when((mode == "verify_below_threshold") & kind.isNull(), "no detector")
        .when((mode == "verify_below_threshold") & (kind == "surrogate"), "a surrogate has no threshold")
        .when((mode == "minimize_surrogate") & (kind.isNull() | (kind != "surrogate")), "no surrogate")
        .when(F.size(detectors) > 1, "one detector only")
        .when((F.size(detectors) == 1) & ~F.coalesce(F.array_contains(detectors, detector), F.lit(False)), "another detector")
    )


def detection_metrics(rows: DataFrame, by: str) -> DataFrame:
    """by, n, accuracy, detection_rate, false_positive_rate. rows: by, truth, predicted (booleans)."""
    rate = lambda c, among: F.sum(F.when(among & c, 1).otherwise(0)) / F.nullif(F.sum(F.when(among, 1).otherwise(0)), F.lit(0))
    t, p = F.col("truth"), F.col("predicted")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg((t == p).cast("double")).alias("accuracy"), rate(p, t).alias("detection_rate"), rate(p, ~t).alias("false_positive_rate"))


def flips(before: DataFrame, after: DataFrame) -> DataFrame:
    """n, flip_rate, mean_z_reduction over records joined on id (detected, z)."""
    j = before.select("id", F.col("detected").alias("d1"), F.col("z").alias("z1")).join(after.select("id", F.col("detected").alias("d2"), F.col("z").alias("z2")), "id")
    hit = F.sum(F.when(F.col("d1"), 1).otherwise(0))
    return j.agg(F.count(F.lit(1)).alias("n"), (F.sum(F.when(F.col("d1") & ~F.col("d2"), 1).otherwise(0)) / F.nullif(hit, F.lit(0))).alias("flip_rate"), F.avg(F.col("z1") - F.col("z2")).alias("mean_z_reduction"))
