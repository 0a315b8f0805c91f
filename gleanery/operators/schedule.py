"""Polite crawl schedules, and admission of calls by a sliding log.

Times are whole microseconds (``bigint``), so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleanery import constants as C
from gleanery.operators.scan import (
    CHUNK, Running, before, carried_on, in_chunks, running_max, scanned, with_row_number,
)
from gleanery.operators.trailing import trailing_counts
from gleanery.session import as_column, checkpointed

SECOND = 1_000_000


def micros(ts: Column | str) -> Column:
    """A timestamp as microseconds since 1970, UTC."""
    return F.unix_micros(as_column(ts).cast("timestamp"))


def from_micros(us: Column | str) -> Column:
    return F.timestamp_micros(as_column(us))


# -- delays -------------------------------------------------------------------
def domain_delay(domain: Column | str) -> tuple[Column, Column]:
    """``(min, max)`` seconds between two requests to a host; only exact host names have their own."""
    domain = as_column(domain)
    low, high = F.lit(C.DEFAULT_DELAY[0]), F.lit(C.DEFAULT_DELAY[1])
    for host, (host_low, host_high) in C.DOMAIN_DELAYS.items():
        low = F.when(domain == host, host_low).otherwise(low)
        high = F.when(domain == host, host_high).otherwise(high)
    return low, high


def with_domain_delay(df: DataFrame, domain: str = "domain") -> DataFrame:
    """Add ``min_delay`` and ``max_delay``: five constants, so an expression and no join."""
    low, high = domain_delay(domain)
    return df.withColumns({"min_delay": low, "max_delay": high})


def unit_hash(url: Column | str) -> Column:
    """A repeatable number in [0, 1) per URL."""
    return F.conv(F.substring(F.md5(as_column(url)), 1, 8), 16, 10).cast("double") / F.lit(float(2 ** 32))


def jitter(url: Column | str, low: Column | str = "min_delay", high: Column | str = "max_delay") -> Column:
    """Delay in seconds: between ``low`` and ``high``, fixed per URL so that a schedule can be repeated."""
    low, high = as_column(low), as_column(high)
    return low + unit_hash(url) * (high - low)


def delay_micros(url: Column | str, low: Column | str = "min_delay", high: Column | str = "max_delay") -> Column:
    return F.floor(jitter(url, low, high) * SECOND).cast("bigint")


# -- schedules -----------------------------------------------------------------
def politeness_schedule(df: DataFrame, key: str, arrival: str, tie: str, delay: str, start: str = "start_us",
                        chunks: int | None = None, last_start: str | None = None) -> DataFrame:
    """Start times with ``start >= arrival`` and, per key, ``start >= previous start + delay``.

    ``last_start`` names a column with the last start of the key before these rows, null where there was none.

    With the running total of delays ``T``, the start is ``T`` plus the running maximum of ``arrival - T``.  Both are
    carried from chunk to chunk, so a host that holds a large part of the frontier is spread over many tasks.  The rows
    are shuffled once.
    """
    columns = [Running("_total", "sum", "_delay"), Running("_lead", "max", "_arrival", less="_total")]
    rows = df.withColumns({"_owner": F.struct(key), "_delay": F.col(delay), "_arrival": F.col(arrival)})
    local = scanned(rows, ["_owner"], [arrival, tie], columns, chunks)

    def into(totals: DataFrame) -> DataFrame:
        earlier = before([CHUNK], ["_owner"])
        summed = totals.withColumn("_total_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
        return summed.withColumn("_lead_before", F.max(F.col("_lead") - F.col("_total_before")).over(earlier))

    passed = carried_on(local, ["_owner"], ["_total", "_lead"], into)
    earlier = F.coalesce(F.col("_total_before"), F.lit(0))
    known = [F.col(last_start)] if last_start else []
    lead = F.greatest(F.col("_lead_before"), F.col("_lead") - earlier, *known)
    return passed.select(*df.columns, (earlier + F.col("_total") + lead).alias(start))


def global_schedule(df: DataFrame, arrival: str, tie: str, per_second: int = C.OUTBOUND_REQUESTS_PER_SECOND,
                    step_us: int = int(C.GLOBAL_STEP_SECONDS * SECOND), start: str = "global_us",
                    chunks: int | None = None) -> DataFrame:
    """Start times with at most ``per_second`` starts per ``step_us``: each start is at least one step after the one
    ``per_second`` places before it.

    Row ``i`` of the order belongs to chain ``i mod per_second``; a chain is a schedule with a constant delay, so its
    running total is known from ``i`` and only a running maximum has to be carried.

    Applied after :func:`politeness_schedule` it can only delay rows further; the gap of two rows of one host may
    then shrink when the earlier one was delayed more.
    """
    ranked = with_row_number(df, [arrival, tie], "_i", chunks)
    total = F.floor(F.col("_i") / per_second).cast("bigint") * step_us
    chained = ranked.withColumns({"_chain": F.col("_i") % per_second, "_total": total})
    led = running_max(chained, ["_chain"], ["_i"], F.col(arrival) - F.col("_total"), "_lead")
    return led.select(*df.columns, (F.col("_total") + F.col("_lead")).alias(start))


def trailing_rate(df: DataFrame, us: str, keys: Sequence[str] = (), window_us: int = SECOND, name: str = "calls",
                  chunks: int | None = None) -> DataFrame:
    """Add the number of rows in the trailing ``window_us``, the row itself and rows of the same time included.

    Rows are shuffled once, by range of key and time; see :mod:`gleanery.operators.trailing`.
    """
    return trailing_counts(df, us, list(keys), window_us, name, chunks)


# Rounds in which a chunk may be run from a log that is not final yet.
_GUESSING_ROUNDS = 2


# -- admission --------------------------------------------------------------------
class _Log:
    """Times of the last admitted calls of one key: all a sliding log has to remember."""

    def __init__(self, limit: int, window: int, times: Sequence[int] = ()):
        self.limit, self.window, self.times = limit, window, list(times)

    def admit(self, us: np.ndarray) -> np.ndarray:
        """Decide a sorted run of calls.  Rejected stretches are jumped over by binary search."""
        admitted = np.zeros(len(us), bool)
        i, size = 0, len(us)
        while i < size:
            if len(self.times) == self.limit:
                free_at = self.times[0] + self.window
                if us[i] < free_at:
                    i += int(np.searchsorted(us[i:], free_at))
                    continue
                self.times.pop(0)
            admitted[i] = True
            self.times.append(int(us[i]))
            i += 1
        return admitted


def _decide(batches: Iterator[pa.RecordBatch], key: str, us: str, limit: int, window: int,
            logs: dict[int, tuple[object, list[int]]]):
    """Yield ``(batch, admitted)`` per batch, then ``(None, (chunk, first key, last key, last log))``."""
    log = current = chunk = first = None
    started = False
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_pylist()
        times = batch.column(us).to_numpy(zero_copy_only=False)
        if not started:
            started, chunk, first = True, batch.column(CHUNK)[0].as_py(), keys[0]
            current, carried = logs.get(chunk, (None, []))
            log = _Log(limit, window, carried) if current == keys[0] and carried else None
            current = keys[0] if log else None
        edges = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
        admitted = []
        for begin, end in zip(edges, edges[1:]):
            if log is None or keys[begin] != current:
                log, current = _Log(limit, window), keys[begin]
            admitted.append(log.admit(times[begin:end]))
        yield batch, np.concatenate(admitted)
    if started:
        yield None, (chunk, first, current, log.times)


def admit_calls(df: DataFrame, us: str, tie: str, limit: int = C.INBOUND_CALLS_PER_SECOND, window_us: int = SECOND,
                per: str | None = None, chunks: int | None = None) -> DataFrame:
    """Add ``admitted`` and ``code`` (429 for a rejected call): a call passes while fewer than ``limit`` admitted
    calls lie within the last ``window_us``; one exactly that old no longer counts, and rejected calls never do.

    Greedy admission depends on what was admitted before, but only through the last ``limit`` admitted times.  Each
    chunk is decided on its own from an assumed log; a chunk whose true incoming log differs is decided again, until
    nothing changes.  Quiet moments make chunks independent, so one repeat is the rule.  Where a key stays over its
    limit through many chunks these follow one after the other, each being run when the one before it is final; only
    the chunks of a round are read.  The driver holds one short log per chunk and no rows.  ``limit <= 0`` admits
    everything.
    """
    if limit <= 0:
        return df.withColumns({"admitted": F.lit(True), "code": F.lit(200)})
    key = per or "_all"
    work = df if per else df.withColumn(key, F.lit(0))
    pieces = in_chunks(work, [key, us, tie], chunks)
    key_type = pieces.schema[key].dataType
    log_schema = T.StructType([
        T.StructField("chunk", T.IntegerType()), T.StructField("first_key", key_type),
        T.StructField("last_key", key_type), T.StructField("times", T.ArrayType(T.LongType())),
    ])
    log_arrow = to_arrow_schema(log_schema)
    narrow = pieces.select(CHUNK, key, us)

    def final_logs(assumed: dict, only: list[int] | None = None) -> dict:
        """Run chunks (all, or only some) from the assumed logs; one short row comes back per chunk."""

        def run(batches):
            for batch, result in _decide(batches, key, us, limit, window_us, assumed):
                if batch is None:
                    yield pa.RecordBatch.from_pylist([dict(zip(log_arrow.names, result))], schema=log_arrow)

        decided = narrow.mapInArrow(run, log_schema).rdd  # partition n is chunk n
        return {r["chunk"]: r for r in decided.context.runJob(decided, list, only)}

    incoming: dict[int, tuple[object, list[int]]] = {}
    logs = final_logs(incoming)
    numbers, rounds = sorted(logs), 0
    while True:
        changed, settled = {}, True
        for earlier, later in zip(numbers, numbers[1:]):
            # A chunk inherits the log of the one before it when it goes on with the same key.
            log = (logs[earlier]["last_key"], list(logs[earlier]["times"]))
            if log[0] != logs[later]["first_key"]:
                settled = True
                continue
            stale = incoming.get(later) != log
            if stale and (settled or rounds < _GUESSING_ROUNDS):
                changed[later] = log
            settled = settled and not stale
        if not changed:
            break
        rounds += 1
        incoming.update(changed)
        logs.update(final_logs(dict(incoming), sorted(changed)))

    true_logs = dict(incoming)
    schema = T.StructType([*pieces.schema.fields, T.StructField("admitted", T.BooleanType())])

    def label(batches):
        for batch, result in _decide(batches, key, us, limit, window_us, true_logs):
            if batch is not None:
                yield batch.append_column("admitted", pa.array(result))

    return (
        pieces.mapInArrow(label, schema)
        .select(*df.columns, "admitted", F.when(F.col("admitted"), 200).otherwise(429).alias("code"))
    )
