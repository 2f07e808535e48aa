"""Keyed state that does not depend on the order of rows within a trigger.

State per key is bounded by time, and rows are combined before the shuffle, so a hot key sends
one row per batch to its one task. Jobs that need time order are in `carry.py`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class KeyTally(StatefulProcessor):
    """Rows counted per key, and the items seen lately.

    The items are forgotten by a timer `quiet_ms` after the key's last trigger, and each of them
    `ttl_ms` after it came; nothing else bounds them. The tally stays. It can start from totals.
    """

    def __init__(self, key: str, quiet_ms: int = 60_000, ttl_ms: int = 3_600_000):
        self.key, self.quiet_ms, self.ttl_ms = key, quiet_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tally = handle.getValueState("tally", "total bigint")
        self.items = handle.getListState("items", "item bigint", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total = int(self.tally.get()[0]) if self.tally.exists() else 0
        for batch in rows:
            total += int(batch["n"].sum())
            for items in batch["items"]:
                self.items.appendList([(int(item),) for item in items])
        self.tally.update((total,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        held = sum(1 for _ in self.items.get()) if self.items.exists() else 0
        yield pd.DataFrame({self.key: [key[0]], "total": [total], "held": [held]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.items.clear()
        return iter(())

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.tally.update((int(initialState["total"].sum()),))

    def close(self) -> None:
        pass


def _per_batch(key: str, item: str):
    """Rows per key and Arrow batch in one row with all their items, before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            groups = batch.groupby(key)[item]
            out = groups.size().rename("n").to_frame()
            out["items"] = groups.apply(list)
            yield out.reset_index()

    return run


def track_orders(df: DataFrame, key: str, item: str, initial: DataFrame | None = None, **limits: int) -> DataFrame:
    """(key, total, held) after each trigger: rows in all, and items that are still remembered.

    `initial` has the columns key and total.
    """
    partial = df.select(key, item).filter(F.col(key).isNotNull()).mapInPandas(
        _per_batch(key, item), f"{key} bigint, n bigint, items array<bigint>"
    )
    return partial.groupBy(key).transformWithStateInPandas(
        KeyTally(key, **limits),
        outputStructType=f"{key} bigint, total bigint, held bigint",
        outputMode="Update",
        timeMode="ProcessingTime",
        initialState=None if initial is None else initial.select(key, "total").groupBy(key),
    )


def changelog_updates(df: DataFrame, key: str, value: str, at: str, tie: str) -> DataFrame:
    """(key, value, at, tie) per changed key and trigger, for update mode.

    The newest row per key is the table; a NULL value says that the key is deleted. The
    tombstone stays in the state, or an older value arriving later would revive the key.
    One row per key is kept, and rows of a hot key are combined before the shuffle.
    """
    order = F.struct(F.unix_micros(at).alias("at"), F.col(tie).alias("tie"))
    last = F.max_by(F.struct(F.col(value).alias("value"), order.alias("o")), order)
    newest = df.groupBy(key).agg(last.alias("last"))
    return newest.select(key, "last.value", "last.o.at", "last.o.tie")
