"""Statistics over the previous N rows of a key on a stream (W11 on Z01's streams).

Rows of a key are held as list state until the watermark has passed them, so rows
that arrive out of order (within the watermark's delay) still count in event-time order; an
event-time timer, one for each key, releases them.  A second list state holds the
last N rows of the key, which is all that a later row needs.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .flows import event_time

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
EPOCH = dt.datetime(1970, 1, 1)


def micros(t: dt.datetime) -> int:
    return (t - EPOCH) // dt.timedelta(microseconds=1)


class PreviousRows(StatefulProcessor):
    """Emits every row of a key, in the order of time and ``order``, with what ``measure`` makes of the ``n`` rows before it.

    ``fields`` are the input's columns, ``time`` the place of the wall clock among them, ``order`` those of the
    columns that order rows of one time.  Rows whose millisecond is not before the watermark wait."""

    def __init__(self, schema: T.StructType, time: int, order: Sequence[int], n: int, measure: Callable[[list], tuple],
                 names: Sequence[str]):
        self.names = list(names)
        self.schema, self.time, self.order, self.n, self.measure = schema, time, list(order), n, measure

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.last = handle.getListState("last", self.schema)

    def place(self, row) -> tuple:
        return micros(row[self.time]), *[row[i] for i in self.order]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(r[f] for f in self.schema.fieldNames()) for r in rows]
        held = list(self.waiting.get()) if self.waiting.exists() else []
        before = min((micros(r[self.time]) // 1000 for r in held), default=None)
        self.waiting.appendList(new)
        first = min(micros(r[self.time]) // 1000 for r in new)
        if before is None or first < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()]
        due = sorted((r for r in held if micros(r[self.time]) // 1000 < now), key=self.place)
        rest = [r for r in held if micros(r[self.time]) // 1000 >= now]
        last = [tuple(r) for r in self.last.get()] if self.last.exists() else []
        for row in due:
            yield Row(**dict(zip(self.names, (*row, *self.measure(last)), strict=True)))
            last = [*last, row][-self.n:]
        if due:
            self.last.put(last)
        self.waiting.clear()
        if rest:
            self.waiting.appendList(rest)
            self.handle.registerTimer(min(micros(r[self.time]) // 1000 for r in rest))

    def close(self) -> None:
        pass


def previous_rows(stream: DataFrame, key: str, ts: str, order: Sequence[str], n: int, measure: Callable[[list], tuple],
                  measured: str, delay: str = "10 minutes") -> DataFrame:
    """W11 on a stream: its rows (columns ``stream.columns``) with the columns ``measured`` (DDL) that ``measure`` makes of the
    at most ``n`` rows before each of them (tuples in column order, oldest first) in the same key.

    A row comes out once the watermark (the latest time less ``delay``) has passed it; later ones stay in the state.
    Rows with a null key or time, and rows behind the watermark on arrival, are left out."""
    names = stream.columns
    schema = stream.schema
    out = T.StructType([*schema.fields, *T.StructType.fromDDL(measured).fields])
    timed = (stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("__et", event_time(F.col(ts)))
             .withWatermark("__et", delay))
    handler = PreviousRows(schema, names.index(ts), [names.index(c) for c in order], n, measure, out.fieldNames())
    return timed.groupBy(key).transformWithState(handler, out, "append", "eventTime")


def run_previous_rows(spark: SparkSession, result: DataFrame, checkpoint: str, output: str) -> None:
    """Processes what is there now and stops; run again with the same folders, it goes on where it stopped."""
    name, store = STATE_STORE
    old = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        (result.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(output).awaitTermination())
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)
