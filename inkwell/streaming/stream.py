"""The same transforms on streams: stateless inspection, rates by event time, and keyed state.

Leases, sequence numbers and stagnation keep a small state for each key between
micro-batches. Rows of a key within one batch are taken in their stated order; across batches
they are taken as batches come, so results equal the batch's where rows arrive in order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkwell.operators import inspect
from inkwell.operators.ledger import Account


def read_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).parquet(folder)


def carriers(docs: DataFrame) -> DataFrame:
    """Findings of each document; a map, so it needs no state."""
    return inspect.findings(docs)


def rates(events: DataFrame, time: str = "ts", kind: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by kind and tumbling window; rows later than the watermark are dropped by the stream."""
    w = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), kind, "n")


def leases(requests: DataFrame, limit: float) -> DataFrame:
    """key, place, outcome, spent, reserved of requests (key, place, action, lease, amount) as they come; ``ledger.leases`` on a stream.

    A key's state is what it has spent and its open leases.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent, held = state.get if state.exists else (0.0, "{}")
        account = Account(limit, spent, {k: tuple(v) for k, v in json.loads(held).items()})
        rows = pd.concat(list(parts)).sort_values("place", kind="stable")
        out = []
        for place, action, lease, amount in zip(rows.place, rows.action, rows.lease, rows.amount, strict=True):
            outcome = account.act(action, str(lease), None if pd.isna(amount) else float(amount))
            out.append((key[0], place, outcome, float(account.spent), float(account.reserved)))
        state.update((float(account.spent), json.dumps(account.leases)))
        yield pd.DataFrame(out, columns=["key", "place", "outcome", "spent", "reserved"])

    out = "key string, place bigint, outcome string, spent double, reserved double"
    rows = requests.select(F.col("key").cast("string"), F.col("place").cast("long"), "action", F.col("lease").cast("string"), F.col("amount").cast("double"))
    return rows.groupBy("key").applyInPandasWithState(run, out, "spent double, leases string", "append", GroupStateTimeout.NoTimeout)


def stagnation(rounds: DataFrame, patience: int, quiet: str | None = None) -> DataFrame:
    """key, round, risk, best, stagnant, ended of rounds (key, round, risk) as they come.

    stagnant: how many rounds in a row brought nothing better; ended: stagnant has
    reached the patience. With ``quiet`` (milliseconds of processing time) a key without rows
    for so long is told once as ended, and its state is dropped.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["key", "round", "risk", "best", "stagnant", "ended"]
        if state.hasTimedOut:
            best, idle, last = state.get
            state.remove()
            yield pd.DataFrame([(key[0], last, None, best, idle, True)], columns=columns)
            return
        best, idle, last = state.get if state.exists else (None, 0, -1)
        out = []
        rows = pd.concat(list(parts)).sort_values("round", kind="stable")
        for n, risk in zip(rows["round"], rows.risk, strict=True):
            idle = idle + 1 if best is not None and not risk < best else 0
            best, last = risk if best is None else min(best, risk), int(n)
            out.append((key[0], last, float(risk), float(best), idle, idle >= patience))
        state.update((float(best), idle, last))
        if quiet:
            state.setTimeoutDuration(int(quiet))
        yield pd.DataFrame(out, columns=columns)

    out = "key string, round bigint, risk double, best double, stagnant int, ended boolean"
    rows = rounds.select(F.col("key").cast("string"), F.col("round").cast("long"), F.col("risk").cast("double"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if quiet else GroupStateTimeout.NoTimeout
    return rows.groupBy("key").applyInPandasWithState(run, out, "best double, idle int, last bigint", "append", timeout)


def numbered(events: DataFrame) -> DataFrame:
    """key, place, sequence (gap-free from 0) of events (key, place) as they come."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values("place", kind="stable")
        state.update((n + len(rows),))
        yield pd.DataFrame({"key": key[0], "place": rows.place.to_numpy(), "sequence": range(n, n + len(rows))})

    rows = events.select(F.col("key").cast("string"), F.col("place").cast("long"))
    return rows.groupBy("key").applyInPandasWithState(run, "key string, place bigint, sequence bigint", "next bigint", "append", GroupStateTimeout.NoTimeout)


def dropped(query) -> int:
    """Rows that a query has dropped as later than its watermark."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there and return it as a table."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
