"""Keyed state with expiry: a cache whose entries hold for a time, and runs that end when all is done or nothing moves.

Both are stateful processors with event-time timers. A key keeps one small value, whatever its history, and loses it when the
watermark passes its time, so state is bounded by the keys that are alive. Rows of a key within a micro-batch are put in order
of time; over batches the source's order counts, and rows behind the watermark are dropped by Spark. Results don't depend
on how the stream is cut into batches, and a query that is stopped goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timers_store(spark: SparkSession):
    """The state store that timers need, for queries that start inside; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    parts = list(rows)
    whole = parts[0] if len(parts) == 1 else pd.concat(parts)
    return whole.sort_values(by, kind="stable") if len(whole) > 1 else whole


def _moved(handle: StatefulProcessorHandle, old: int | None, new: int) -> None:
    """Sets a key's one timer, whose time follows from its state: asking for it would cost more calls than the state itself."""
    if old != new:
        if old is not None:
            handle.deleteTimer(old)
        handle.registerTimer(new)


def _ms(at) -> pd.Series:
    return at.astype("datetime64[us]").astype("int64")


class _Cache(StatefulProcessor):
    def __init__(self, hold_us: int):
        self.hold = hold_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", StructType([StructField("content", LongType()), StructField("at", LongType())]))

    def _timer(self, at: int) -> int:
        return (at + self.hold) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        content, at = self.entry.get() or (None, None)
        timer, wrote, out = None if at is None else self._timer(at), False, []
        batch = _ordered(rows, ["at", "number"])
        for number, when, write, new in zip(batch["number"], _ms(batch["at"]), batch["write"], batch["content"]):
            if write:
                content, at, wrote = int(new), int(when), True
            else:
                hit = at is not None and at > when - self.hold
                out.append((key[0], int(number), bool(hit), content if hit else None))
        if wrote:
            self.entry.update((content, at))
            _moved(self.handle, timer, self._timer(at))
        if out:
            yield pd.DataFrame({"key": pd.Series([o[0] for o in out], dtype="int64"), "number": pd.Series([o[1] for o in out], dtype="int64"), "hit": pd.Series([o[2] for o in out], dtype=bool), "content": pd.Series([o[3] for o in out], dtype="Int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entry.clear()
        return iter([])

    def close(self) -> None:
        pass


def cache_reads(operations: DataFrame, hold: str = "24 hours", late: str = "1 second") -> DataFrame:
    """operations (key, at, number, write, content) -> key, number, hit, content of each read.

    A read hits if the key was written before it (by time, then number) and less than `hold` ago; content is the last one written.
    """
    us = int(pd.Timedelta(hold).total_seconds() * 1_000_000)
    return operations.withWatermark("at", late).groupBy("key").transformWithStateInPandas(_Cache(us), "key long, number long, hit boolean, content long", "Append", "EventTime")


class _Runs(StatefulProcessor):
    def __init__(self, idle_us: int):
        self.idle = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", StructType([StructField("open", LongType()), StructField("done", LongType()), StructField("at", LongType()), StructField("ended", StringType())]))

    def _timer(self, at: int) -> int:
        return (at + self.idle) // 1000 + 1

    def _out(self, key, ends: list[tuple[int, str, int]]) -> pd.DataFrame:
        at, reason, done = zip(*ends)
        return pd.DataFrame({"run": pd.Series([key[0]] * len(ends), dtype="int64"), "ended_us": pd.Series(at, dtype="int64"), "reason": list(reason), "done": pd.Series(done, dtype="int64")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        open_, done, at, ended = self.run.get() or (0, 0, None, "")
        timer, out = None if at is None else self._timer(at), []
        batch = _ordered(rows, ["at", "number"])
        for when, found, finished in zip(_ms(batch["at"]), batch["found"], batch["finished"]):
            when = int(when)
            if at is not None and when - at > self.idle and not ended:
                out.append((at + self.idle, "idle", done))  # its time was up before this row came
                ended = "idle"
            if ended:  # a run that goes on after its end begins anew
                open_, done, ended = 0, 0, ""
            open_, done, at = open_ + int(found) - int(finished), done + int(finished), when
            if done and open_ <= 0:
                out.append((at, "done", done))
                ended = "done"
        self.run.update((open_, done, at, ended))
        _moved(self.handle, timer, self._timer(at))
        if out:
            yield self._out(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        open_, done, at, ended = self.run.get()
        self.run.clear()
        if not ended:
            yield self._out(key, [(at + self.idle, "idle", done)])

    def close(self) -> None:
        pass


def run_ends(events: DataFrame, idle: str, late: str = "1 second") -> DataFrame:
    """events (run, at, number, found, finished) -> run, ended_us, reason, done for each end of a run.

    done: as much is finished as was found; idle: nothing came for `idle`. What comes after an end begins another run. A run
    that is neither done nor idle at the stream's last watermark hasn't ended.
    """
    us = int(pd.Timedelta(idle).total_seconds() * 1_000_000)
    return events.withWatermark("at", late).groupBy("run").transformWithStateInPandas(_Runs(us), "run long, ended_us long, reason string, done long", "Append", "EventTime")


def replayed(rows: DataFrame, stream_of, folder: str, at: str, parts: int = 3) -> DataFrame:
    """Runs a streaming query over stored rows: `parts` stretches of time come one after the other as files below `folder`.

    stream_of: streaming DataFrame -> streaming DataFrame. The query stops after each stretch and is started again on its
    checkpoint. Returns what its sink holds.
    """
    from pyspark.sql import functions as F

    spark = rows.sparkSession
    bounds = rows.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    source, sink = f"{folder}/in", f"{folder}/out"
    rows.limit(0).write.parquet(source)
    span = (bounds["hi"] - bounds["lo"]) / parts if bounds["lo"] is not None else None
    with timers_store(spark):
        for i in range(parts):
            if span is not None:
                part = rows.where(F.col(at) >= F.lit(bounds["lo"] + i * span))
                part = part.where(F.col(at) < F.lit(bounds["lo"] + (i + 1) * span)) if i < parts - 1 else part
                part.write.mode("append").parquet(source)
            made = stream_of(spark.readStream.schema(rows.schema).parquet(source))
            made.writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(sink)
