"""The status of a document as a state machine over a stream: legal transitions only, and a timer for checks that hang."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docaudit.plans.profiles import FAILED, TRANSITIONS, UNDER_WAY

#: Groups that documents are dealt to; the state of one is read and written together.
GROUPS = 4096
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StatusMachine(StatefulProcessor):
    """The status of each document of a group. Signals wait until the watermark has passed them, and are then taken in the order of time
    and tie, so that the outcome does not depend on how the stream was cut into batches.

    Calls and frames are dear by the group, not by the row: a batch's signals go to state as one element of lists, and all that are due
    leave it at once. A group has one timer, the earliest that any of its documents needs.
    """

    def __init__(self, timeout_us: int, kind: str):
        self.timeout, self.kind = timeout_us, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = handle.getValueState("states", f"keys array<{self.kind}>, statuses array<string>, since array<long>")
        self.waiting = handle.getListState("waiting", f"at array<long>, tie array<long>, signal array<string>, keys array<{self.kind}>")
        self.timer = handle.getValueState("timer", "at long")

    def wake(self, at: int | None) -> None:
        """Has the group woken at that time (in ms) or earlier, if a timer is set for that already."""
        known = self.timer.get()[0] if self.timer.exists() else None
        if at is None or (known is not None and known <= at):
            return
        if known is not None:
            self.handle.deleteTimer(known)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        late, first = timerValues.getCurrentWatermarkInMs(), None
        for some in rows:
            new = some[some["at"] // 1000 >= late]
            if len(new):
                self.waiting.appendValue(tuple(new[c].tolist() for c in ("at", "tie", "signal", "key")))
                first = min(int(new["at"].min()) // 1000, first) if first is not None else int(new["at"].min()) // 1000
        self.wake(first)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed, out = timerValues.getCurrentWatermarkInMs(), []
        waiting = sorted(x for some in self.waiting.get() for x in zip(*some, strict=True)) if self.waiting.exists() else []
        states = {k: (status, since) for k, status, since in zip(*self.states.get(), strict=True)} if self.states.exists() else {}
        due = sum(x[0] // 1000 < passed for x in waiting)
        for at, tie, signal, doc in waiting[:due]:
            status, since = states.get(doc, (None, 0))
            if status == UNDER_WAY and since + self.timeout <= at:
                out.append((doc, since + self.timeout, None, None, status, FAILED, True))
                status, since = FAILED, since + self.timeout
            legal = signal in TRANSITIONS.get(status or "", ())
            out.append((doc, at, tie, signal, status, signal if legal else status, legal))
            if legal:
                status, since = signal, at
            if status is not None:
                states[doc] = (status, since)
        for doc, (status, since) in states.items():
            if status == UNDER_WAY and (since + self.timeout) // 1000 < passed:
                out.append((doc, since + self.timeout, None, None, status, FAILED, True))
                states[doc] = (FAILED, since + self.timeout)
        left = waiting[due:]
        self.waiting.clear()
        if left:
            self.waiting.appendValue(tuple(map(list, zip(*left, strict=True))))
        if states:
            self.states.update((list(states), [status for status, _ in states.values()], [since for _, since in states.values()]))
        self.timer.clear()  # the one that went off
        self.wake(min([x[0] // 1000 for x in left[:1]] + [(since + self.timeout) // 1000 for status, since in states.values() if status == UNDER_WAY], default=None))
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "tie", "signal", "before", "after", "legal"]).astype({"tie": "Int64"})

    def close(self) -> None:
        pass


def transitions(signals: DataFrame, key: str, time: str, tie: str, signal: str, timeout_us: int, delay: str, groups: int = GROUPS) -> DataFrame:
    """(key, at, tie, signal, before, after, legal) of a stream of signals: a row for each signal, legal or not, and one without a
    signal for each check that a timer gave up `timeout_us` microseconds after it began.

    Signals that come later than `delay` behind the latest are dropped; those within it wait as state. Rows without a key, time, tie
    or signal are left out. A key's state is its status and the signals of the delay, however long its history. Keys are dealt by hash to
    `groups` groups, whose state is read and written together: more of them for very many keys, but a checkpoint needs the number that it
    was begun with. Keys are whole numbers, texts, dates, decimals or booleans.
    """
    kind = signals.schema[key].dataType
    if not isinstance(kind, (T.IntegralType, T.StringType, T.DateType, T.DecimalType, T.BooleanType)):
        raise TypeError(f"{key} is {kind.simpleString()}; keys must be whole numbers, texts, dates, decimals or booleans")
    own = signals.select(F.col(key).alias("key"), F.col(time).cast("timestamp").alias("ts"), F.col(tie).cast("long").alias("tie"), F.col(signal).alias("signal")).dropna()
    marked = own.withWatermark("ts", delay).withColumns({"at": F.unix_micros("ts"), "part": F.pmod(F.xxhash64("key"), F.lit(groups))})
    schema = T.StructType([
        T.StructField("key", kind), T.StructField("at", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("signal", T.StringType()),
        T.StructField("before", T.StringType()), T.StructField("after", T.StringType()), T.StructField("legal", T.BooleanType()),
    ])
    return marked.groupBy("part").transformWithStateInPandas(StatusMachine(timeout_us, kind.simpleString()), schema, "append", "eventTime")


def run_machine(signals: DataFrame, key: str, time: str, tie: str, signal: str, timeout_us: int, delay: str, sink: str, checkpoint: str, groups: int = GROUPS) -> StreamingQuery:
    """The transitions of a stream, appended to Parquet files; it ends when all of the source is read. Started again with its checkpoint it
    goes on where it was."""
    spark, name = signals.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)  # which lists and timers need; a query keeps the settings that it was started with
    try:
        out = transitions(signals, key, time, tie, signal, timeout_us, delay, groups)
        return out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)
