"""Other streaming operators: counters, first seen, fan-out, task minting, waiting for commitments."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import status_class
from ..operators.joins import catalog_tasks, subscribers


def counters(events: DataFrame) -> DataFrame:
    """Running totals by route and class (update mode as a stream)."""
    return events.groupBy("route", status_class(F.col("status")).alias("class")).agg(F.count("*").alias("requests"))


def first_seen(events: DataFrame, key: list[str], within: str = "24 hours") -> DataFrame:
    """A stream without repeats of a key within the time."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(key)


def fanout(events: DataFrame, subscriptions: DataFrame, keys: list[str]) -> DataFrame:
    """Each event with every subscription that fits it; subscriptions are static."""
    return subscribers(events, subscriptions, keys)


def mint(codes: DataFrame, read_tasks: Callable[[], DataFrame], append: Callable[[DataFrame], None], never: list[str], fallback: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: tasks of studies that have none yet are appended; a batch that runs again adds nothing."""

    def each(batch: DataFrame, _: int) -> None:
        append(catalog_tasks(batch, codes, read_tasks(), never, fallback))

    return each


def commit_wait(confirmations: DataFrame, wait_seconds: int = 600) -> DataFrame:
    """Per transaction one verdict: success when as many distinct instances as expected are confirmed, failures when the time passes first. confirmations: transaction_uid, sop_uid, expected, ts (watermarked).

    A decided transaction is remembered for as long again, so that late confirmations don't open it anew; then its state goes.
    """

    def run(key, frames, state):
        began, seen, expected, done = state.get if state.exists else (None, [], 0, False)
        seen, out = set(seen), []
        for f in frames:
            for sop, n, ts in f[["sop_uid", "expected", "ts"]].itertuples(index=False):
                at = pd.Timestamp(ts).value // 1_000_000
                began, expected = at if began is None else min(began, at), max(expected, int(n))
                seen.add(sop)
        if done and state.hasTimedOut:
            state.remove()
        else:
            if not done and (state.hasTimedOut or (expected and len(seen) >= expected)):
                out.append((key[0], "success" if expected and len(seen) >= expected else "failures", len(seen)))
                done = True
            state.update((began, [] if done else sorted(seen), expected, done))
            state.setTimeoutTimestamp(max(began + (2 if done else 1) * wait_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["transaction_uid", "verdict", "confirmed"])

    return confirmations.groupBy("transaction_uid").applyInPandasWithState(run, "transaction_uid string, verdict string, confirmed long", "began long, seen array<string>, expected long, done boolean", "append", "EventTimeTimeout")


def commit_verdicts(confirmations: DataFrame, wait_seconds: int = 600) -> DataFrame:
    """Batch twin of commit_wait: the distinct instances confirmed within the time after the first confirmation, and whether they are as many as expected."""
    first = confirmations.groupBy("transaction_uid").agg(F.min("ts").alias("began"), F.max("expected").alias("expected"))
    in_time = confirmations.drop("expected").join(first, "transaction_uid").where(F.unix_micros("ts") - F.unix_micros("began") <= wait_seconds * 1_000_000)
    counted = in_time.groupBy("transaction_uid", "expected").agg(F.count_distinct("sop_uid").alias("confirmed"))
    return counted.select("transaction_uid", F.when(F.col("confirmed") >= F.col("expected"), "success").otherwise("failures").alias("verdict"), "confirmed")
