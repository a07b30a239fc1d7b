"""Keyed state in typed columns with timers: rows wait for the watermark, keys end after a time of silence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .waiting import milliseconds

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedFold(StatefulProcessor):
    """Folds each key's rows in frame order.

    Three state variables: ``waiting`` has an entry per row that the watermark has not passed, by time and frame; ``folded`` has the
    fold's own columns; ``seen`` the last frame and the time of the newest row. A batch writes the entries it adds and removes, not the
    whole state. One event-time timer per key: it fires at the first waiting row, and else when the key has ended, ``idle`` after its
    newest row, and then clears the key. Rows that the watermark has passed never come here: Spark drops and counts them. A
    row that comes in time but whose frame is already folded goes out with ``late`` set.
    """

    def __init__(self, keys: list[str], columns: list[str], kinds: str, start: tuple, fold: Callable, out: list[str], idle: int):
        self.keys, self.columns, self.kinds, self.start, self.fold, self.out, self.idle = keys, columns, kinds, start, fold, out, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        values = ", ".join(f"{c} double" for c in self.columns)
        self.waiting = handle.getMapState("waiting", "ms bigint, frame_no bigint, copy int", values)
        self.folded = handle.getValueState("folded", self.kinds)
        self.seen = handle.getValueState("seen", "frame_no bigint, newest bigint, timer bigint")

    def _seen(self) -> tuple[int | None, int, int]:
        return tuple(self.seen.get()) if self.seen.exists() else (None, 0, -1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame, newest, timer = self._seen()
        late, first = [], None
        for part in rows:
            ms = part["ms"].to_numpy()
            for t, no, *values in zip(ms.tolist(), part["frame_no"].tolist(), *(part[c].tolist() for c in self.columns), strict=True):
                newest = max(newest, t)
                if frame is not None and no <= frame:
                    late.append((*key, no, *[None] * (len(self.out) - len(self.keys) - 2), True))
                    continue
                copy = 0
                while self.waiting.containsKey((t, no, copy)):
                    copy += 1
                self.waiting.updateValue((t, no, copy), tuple(None if pd.isna(v) else float(v) for v in values))
                first = t if first is None else min(first, t)
        if first is not None and (timer < 0 or first < timer or timer > newest):
            timer = self._arm(first, timer)
        elif timer < 0:
            timer = self._arm(newest + self.idle, timer)
        self.seen.update((frame, newest, timer))
        if late:
            yield pd.DataFrame(late, columns=self.out)

    def _arm(self, at: int, timer: int) -> int:
        if timer >= 0:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)
        return at

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        frame, newest, _ = self._seen()
        entries = [(tuple(k), tuple(v)) for k, v in self.waiting.iterator()]
        open_ = min((k[1] for k, _ in entries if k[0] > mark), default=None)
        ready = sorted((k[1], k[0], k[2], v) for k, v in entries if open_ is None or k[1] < open_)
        state, found = tuple(self.folded.get()) if self.folded.exists() else self.start, []
        for no, t, copy, values in ready:
            state, row = self.fold(state, no, values)
            found.append((*key, no, *row, False))
            self.waiting.removeKey((t, no, copy))
            frame = no
        left = [k[0] for k, _ in entries if open_ is not None and k[1] >= open_]
        if not left and mark >= newest + self.idle:
            for v in (self.waiting, self.folded, self.seen):
                v.clear()
        else:
            if ready:
                self.folded.update(state)
            at = max(min(left), mark + 1) if left else newest + self.idle
            self.handle.registerTimer(at)
            self.seen.update((frame, newest, at))
        if found:
            yield pd.DataFrame(found, columns=self.out)

    def close(self) -> None:
        pass


def ordered_fold(
    rows: DataFrame, keys: list[str], columns: list[str], kinds: str, start: tuple, fold: Callable, out: str, idle: str, time: str = "ts"
) -> DataFrame:
    """Fold a stream with a watermark on ``time`` per key, in frame order: ``keys, frame_no``, what ``fold`` gives, and ``late``.

    ``fold(state, frame_no, values)`` returns the next state (columns ``kinds``) and a row (columns ``out``); ``values`` are
    ``columns`` as doubles. Keeps its state in RocksDB, which is set for the session if nothing else is.
    """
    name = "spark.sql.streaming.stateStore.providerClass"
    spark = rows.sparkSession
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, PROVIDER)
    names = [*keys, "frame_no", *[c.strip().split(" ")[0] for c in out.split(",")], "late"]
    schema = ", ".join([*(f"{k} bigint" for k in keys), "frame_no bigint", out, "late boolean"])
    # the time stays a column of its own, for the watermark; timers count whole milliseconds and fire behind them
    longs = [F.col(c).cast("bigint").alias(c) for c in (*keys, "frame_no")]
    slim = rows.select(*longs, *[F.col(c).cast("double").alias(c) for c in columns], time)
    slim = slim.withColumn("ms", F.unix_millis(F.col(time)) + 1)
    fold_by_key = OrderedFold(keys, columns, kinds, start, fold, names, milliseconds(idle))
    return slim.groupBy(*keys).transformWithStateInPandas(fold_by_key, schema, "Append", "EventTime")


def dropped_rows(query) -> int:
    """Rows of a query that came after the watermark, by the progress it has kept."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
