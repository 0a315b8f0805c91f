"""Admission and scheduling of streams, in two ways with the same results.

``stream_admit`` and ``stream_schedule`` keep a few numbers per key in RocksDB and take the rows of a key in a
micro-batch in one task; the size of a micro-batch is set at the source.  ``admit_sink`` and ``schedule_sink`` run the
table operators on each micro-batch, which spread a key over tasks, and keep what the next micro-batch has to know in
a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleanery import constants as C
from gleanery.operators.joins import broadcast_if_small, join_back
from gleanery.operators.schedule import SECOND, _Log, admit_calls, politeness_schedule
from gleanery.streaming.files import EPOCH, batch_sink, use_rocksdb


class _Admission(StatefulProcessor):
    def __init__(self, us: str, tie: str, limit: int, window: int):
        self.us, self.tie, self.limit, self.window = us, tie, limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("admitted_us", T.StructType([T.StructField("us", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values([self.us, self.tie], kind="stable")
        log = _Log(self.limit, self.window, [row[0] for row in self.log.get()])
        batch["admitted"] = log.admit(batch[self.us].to_numpy())
        self.log.put([(time,) for time in log.times])
        batch["code"] = np.where(batch["admitted"], 200, 429).astype("int32")
        yield batch

    def close(self) -> None:
        pass


class _Spacing(StatefulProcessor):
    """``most`` is the longest delay there is; with it a host goes once no request to come can still be delayed by it.

    ``places`` are the positions of arrival, tie and delay in a row, ``names`` those of the columns made.  Every call of the state costs
    as much as many rows, so a host is read once and written once, and its timer stays where it is until it fires.
    """

    def __init__(self, places: tuple[int, int, int], names: list[str], ttl_ms: int | None, most: int | None = None):
        self.places, self.names, self.ttl_ms, self.most = places, names, ttl_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState(
            "last_start", T.StructType([T.StructField("us", T.LongType())]), ttlDurationMs=self.ttl_ms
        )

    def _free(self, last: int) -> int:
        """The first millisecond at which a request can no longer be delayed by a start at ``last``."""
        return (last + self.most) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        arrival, tie, delay = self.places
        made, width = Row(*self.names), len(self.names) - 1
        known = self.last.get()
        last = None if known is None else known[0]
        done = []
        for row in sorted(rows, key=lambda r: (r[arrival] is None, r[arrival] or 0, r[tie] is None, r[tie] or 0)):
            start = None
            if row[arrival] is not None and row[delay] is not None:
                start = row[arrival] if last is None else max(row[arrival], last + row[delay])
                last = start
            done.append(made(*row[:width], start))
        if last is not None and (known is None or last != known[0] or self.ttl_ms is not None):
            self.last.update((last,))
            if self.most is not None and known is None:
                self.handle.registerTimer(max(self._free(last), timerValues.getCurrentWatermarkInMs() + 1))
        yield from done

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.last.get()
        if known is not None:
            free = self._free(known[0])
            if free > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(free)
            else:
                self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_admit(calls: DataFrame, key: str, us: str, tie: str, limit: int = C.INBOUND_CALLS_PER_SECOND,
                 window_us: int = SECOND) -> DataFrame:
    """Add ``admitted`` and ``code`` per key, as ``admit_calls`` does for a table."""
    use_rocksdb(calls.sparkSession)
    schema = T.StructType([
        *calls.schema.fields, T.StructField("admitted", T.BooleanType()), T.StructField("code", T.IntegerType()),
    ])
    return calls.groupBy(key).transformWithStateInPandas(_Admission(us, tie, limit, window_us), schema, "Append", "None")


def stream_schedule(requests: DataFrame, key: str, arrival: str, tie: str, delay: str, start: str = "start_us",
                    ttl_ms: int | None = None, most_delay_us: int | None = None, late: str = "0 seconds") -> DataFrame:
    """Add start times per host, as ``politeness_schedule`` does for a table.

    With ``most_delay_us``, the longest delay of any request, a host is forgotten once the watermark, ``late`` behind the
    newest arrival, lies that much past its last start: no request to come can be delayed by it any more, so results are
    those without forgetting, and ``availableNow`` works.  Arrivals must be microseconds since 1970; a request later
    than ``late`` is dropped by the watermark.

    With ``ttl_ms`` a host is forgotten after that much wall-clock time, which bounds the state.  Spark then keeps
    running empty micro-batches to expire state, so use a processing-time trigger with it, not ``availableNow``.
    """
    use_rocksdb(requests.sparkSession)
    schema = T.StructType([*requests.schema.fields, T.StructField(start, T.LongType())])
    names = requests.columns
    spacing = _Spacing(tuple(map(names.index, (arrival, tie, delay))), schema.names, ttl_ms, most_delay_us)
    # Rows whose key is null would not be taken as one group.
    hosts = requests.withColumns({"_host": F.coalesce(F.col(key).cast("string"), F.lit("")), "_no_host": F.col(key).isNull()})
    if most_delay_us is not None:
        timed = hosts.withColumn("_at", F.timestamp_micros(arrival)).withWatermark("_at", late)
        return timed.groupBy("_host", "_no_host").transformWithState(spacing, schema, "Append", "EventTime")
    return hosts.groupBy("_host", "_no_host").transformWithState(spacing, schema, "Append", "ProcessingTime" if ttl_ms else "None")


def _folder(path: str, part: str, epoch: int) -> str:
    return f"{path}/{part}/{EPOCH}={epoch}"


def _known(batch: DataFrame, path: str, epoch: int, schema: T.StructType) -> DataFrame:
    """What the micro-batch before this one left behind."""
    spark = batch.sparkSession
    return spark.read.schema(schema).parquet(_folder(path, "state", epoch - 1)) if epoch else spark.createDataFrame([], schema)


def admit_sink(calls: DataFrame, path: str, checkpoint: str, key: str, us: str, tie: str,
               limit: int = C.INBOUND_CALLS_PER_SECOND, window_us: int = SECOND, trigger: dict | None = None):
    """Start writing decided calls to ``path/rows``, one folder per micro-batch, overwritten when it is repeated.

    The state is the calls admitted within the last window of each key, at most ``limit`` of them.  Put before the
    calls of the next micro-batch they are admitted again, which rebuilds the log.
    """
    state_schema = T.StructType([calls.schema[c] for c in (key, us, tie)])

    def write(batch: DataFrame, epoch: int) -> None:
        known = _known(batch, path, epoch, state_schema).withColumn("_known", F.lit(True))
        rows = batch.withColumn("_known", F.lit(False)).unionByName(known, allowMissingColumns=True)
        decided = _folder(path, "decided", epoch)
        admit_calls(rows, us, tie, limit, window_us, key).write.mode("overwrite").parquet(decided)
        decided = batch.sparkSession.read.parquet(decided)
        decided.where("NOT _known").drop("_known").write.mode("overwrite").parquet(_folder(path, "rows", epoch))
        admitted = decided.where("admitted").select(key, us, tie)
        newest = broadcast_if_small(admitted.groupBy(key).agg(F.max(us).alias("_newest")))
        state = join_back(admitted, newest, [key]).where(F.col(us) > F.col("_newest") - window_us).drop("_newest")
        state.write.mode("overwrite").parquet(_folder(path, "state", epoch))

    return batch_sink(calls, write, checkpoint, trigger)


def schedule_sink(requests: DataFrame, path: str, checkpoint: str, key: str, arrival: str, tie: str, delay: str,
                  start: str = "start_us", trigger: dict | None = None):
    """Start writing scheduled requests to ``path/rows``; the state is the last start of each key."""
    state_schema = T.StructType([requests.schema[key], T.StructField("_last", T.LongType())])

    def write(batch: DataFrame, epoch: int) -> None:
        known = _known(batch, path, epoch, state_schema)
        rows = join_back(batch, broadcast_if_small(known), [key])
        target = _folder(path, "rows", epoch)
        scheduled = politeness_schedule(rows, key, arrival, tie, delay, start, last_start="_last").drop("_last")
        scheduled.write.mode("overwrite").parquet(target)
        lasts = batch.sparkSession.read.parquet(target).select(key, F.col(start).alias("_last")).unionByName(known)
        lasts.groupBy(key).agg(F.max("_last").alias("_last")).write.mode("overwrite").parquet(
            _folder(path, "state", epoch))

    return batch_sink(requests, write, checkpoint, trigger)
