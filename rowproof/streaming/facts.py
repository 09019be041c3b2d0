"""Facts over streams with state of their own: keys that repeat, and children whose parent does not come in time.

State is kept per key by Spark's arbitrary stateful operator, in RocksDB with checkpoints in the shared folder, so it
is spread over the executors by key and survives their loss. A key's state is one number or two, whatever its rows.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_store(df: DataFrame) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return df


def _row(key: tuple, names: list[str], **more: int) -> pd.DataFrame:
    return pd.DataFrame({**{n: [k] for n, k in zip(names, key, strict=True)}, **{n: [v] for n, v in more.items()}})


class _Repeated(StatefulProcessor):
    """Rows of each key so far; a key is sent again whenever its number grows beyond one."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", StructType([StructField("n", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = sum(len(x) for x in rows) + (self.seen.get()[0] if self.seen.exists() else 0)
        self.seen.update((n,))
        if n > 1:
            yield _row(key, self.names, n=n)

    def close(self) -> None:
        pass


def repeated_keys(stream: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): for each batch the keys it brings that are now on more than one row (a NULL is no duplicate). The
    largest n of a key is its rows so far."""
    known = stream.select(*keys)
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    out = StructType([*(known.schema[k] for k in keys), StructField("n", LongType())])
    return _with_store(known).groupBy(*keys).transformWithStateInPandas(_Repeated(keys), out, "Update", "None")


class _Late(StatefulProcessor):
    """Of each key: has a parent come, and since when how many children wait. A timer ends the wait."""

    def __init__(self, names: list[str], wait_ms: int):
        self.names, self.wait_ms = names, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parent = handle.getValueState("parent", StructType([StructField("n", LongType())]))
        self.waiting = handle.getValueState("waiting", StructType([StructField("n", LongType()), StructField("until", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        children, first, parents = 0, None, 0
        for x in rows:
            own = x[x["is_child"]]
            parents += len(x) - len(own)
            if len(own):
                children += len(own)
                at = int(own["at_ms"].min())
                first = at if first is None else min(first, at)
        n, until = self.waiting.get() if self.waiting.exists() else (0, None)
        if parents and until is not None and until <= timerValues.getCurrentWatermarkInMs():
            yield _row(key, self.names, n_children=n)  # rows come before the timers of the same batch
        if parents or self.parent.exists():
            self.parent.update((1,))
            if until is not None:
                self.handle.deleteTimer(until)
                self.waiting.clear()
        elif children:
            new = first + self.wait_ms if until is None else min(until, first + self.wait_ms)
            if new != until:
                if until is not None:
                    self.handle.deleteTimer(until)
                self.handle.registerTimer(new)
            self.waiting.update((n + children, new))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists() and not self.parent.exists():
            yield _row(key, self.names, n_children=self.waiting.get()[0])
        self.waiting.clear()

    def close(self) -> None:
        pass


def late_parents(children: DataFrame, parents: DataFrame, keys: list[str], at: str, wait: datetime.timedelta = datetime.timedelta(days=1), late: str = "1 hour") -> DataFrame:
    """(keys, n_children): keys whose parent has not come when the watermark (`late` behind the newest row) passes the
    first child's time and `wait`, with the children that came until then. NULL keys refer to nothing. A parent that has
    come once is known for good; children whose wait goes on when the stream is drained are not sent yet."""
    wait_ms = round(wait.total_seconds() * 1000)
    side = lambda df, child: df.select(*keys, F.col(at).cast("timestamp").alias("at"), F.unix_millis(F.col(at).cast("timestamp")).alias("at_ms"), F.lit(child).alias("is_child"))
    both = side(children, True).unionByName(side(parents, False)).withWatermark("at", late)
    for k in keys:
        both = both.where(F.col(k).isNotNull())
    out = StructType([*(both.schema[k] for k in keys), StructField("n_children", LongType())])
    return _with_store(both).groupBy(*keys).transformWithStateInPandas(_Late(keys, wait_ms), out, "Append", "EventTime")
