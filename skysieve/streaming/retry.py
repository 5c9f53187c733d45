"""Items that are tried again after a failure: keyed streaming state with timers.

The stream brings items and what became of their attempts: (item, outcome, at), outcome `new`, `ok` or `failed`. The
state of an item holds its status, its attempts and when it is due. A new item is due at once; a failed one comes again
when the watermark has passed the failure by a delay that doubles with each attempt; one that has succeeded, or failed
too often, never comes again, whatever is repeated. State and timers live in the checkpoint, so a stopped query goes on where it was, and a batch that
runs again starts from the state before it.

Event time drives the timers, so the same input gives the same output however it is cut into batches, once the watermark has passed.
An item has one outcome at a time: of several with the same time `ok` counts, and what is not later than a counted outcome is a
repetition. Rows with a null item, time or outcome, and unknown outcomes, change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What the stream gives: an item that is due, or that has ended.
OUT = "item string, status string, attempts int, at timestamp"


def applied(status: str, attempts: int, outcome: str, most: int) -> tuple[str, int]:
    """Status and attempts after an outcome; an item that has ended stays as it is."""
    if status in ("done", "given_up"):
        return status, attempts
    if outcome == "ok":
        return "done", attempts + 1
    if outcome == "failed":
        return ("given_up" if attempts + 1 >= most else "waiting"), attempts + 1
    return status or "due", attempts


class Retries(StatefulProcessor):
    """One item's life; `delay` seconds before the second attempt, twice as many before each further one."""

    def __init__(self, delay: float, most: int) -> None:
        self.delay, self.most = delay, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("item", "status string, attempts int, seen timestamp")

    def _row(self, key, status: str, attempts: int, at) -> pd.DataFrame:
        return pd.DataFrame({"item": [key[0]], "status": [status], "attempts": pd.array([attempts], "int32"), "at": [pd.Timestamp(at)]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, attempts, seen = self.state.get() if self.state.exists() else ("", 0, None)
        events = pd.concat([*rows]).sort_values(["at", "outcome"], ascending=[True, False])  # at one time: ok, new, failed
        for outcome, at in zip(events["outcome"], events["at"]):
            if status and outcome == "new":
                continue  # known already
            if outcome != "new" and seen is not None and pd.Timestamp(at) <= pd.Timestamp(seen):
                continue  # an outcome that has been counted
            before = status
            status, attempts = applied(status, attempts, outcome, self.most)
            seen = at if outcome != "new" else seen
            if status != before and status in ("due", "done", "given_up"):
                yield self._row(key, status, attempts, at)
            if status == "waiting" and outcome == "failed":
                due = pd.Timestamp(at).timestamp() + self.delay * 2 ** (attempts - 1)
                self.handle.registerTimer(int(due * 1000))
        self.state.update((status, attempts, seen))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, attempts, seen = self.state.get() if self.state.exists() else ("", 0, None)
        if status == "waiting":
            self.state.update(("due", attempts, seen))
            yield self._row(key, "due", attempts, pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"))

    def close(self) -> None:
        pass


def attempts(events: DataFrame, delay: float = 60.0, most: int = 5, late: str = "0 seconds") -> DataFrame:
    """(item, status, attempts, at) of a stream of (item, outcome, at): `due` when an item is to be tried, `done` or `given_up` once."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    known = events.where(F.col("item").isNotNull() & F.col("at").isNotNull() & F.col("outcome").isin("new", "ok", "failed"))
    keyed = known.select(F.col("item").cast("string").alias("item"), "outcome", "at").withWatermark("at", late).groupBy("item")
    return keyed.transformWithStateInPandas(Retries(delay, most), OUT, "Update", "EventTime")
