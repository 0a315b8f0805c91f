"""Rows in a trailing window of time, counted where the sorted rows lie.

Rows are shuffled once, by range of key and time.  Inside a chunk the count is a difference of two ranks.  What a chunk
cannot see are the ranks at window starts before its first row: only these are asked of earlier chunks, and only the
rows between the first and the last time asked for take part in the answer.  A window much shorter than a chunk so asks
for almost nothing; with one longer than a chunk every window start is asked for, and every row is needed once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.operators.scan import CHUNK, Running, before, carried_on, chunked, same_as_next, scanned
from gleanery.session import checkpointed, stored_table

OWNER, TIME = "_owner", "_us"


def _ranks(owner: np.ndarray, times: np.ndarray, asked_owner: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """How many of the sorted rows come before or at each asked owner and time."""
    n = len(times)
    kind = np.concatenate([np.zeros(n, np.int8), np.ones(len(asked), np.int8)])
    order = np.lexsort((kind, np.concatenate([times, asked]), np.concatenate([owner, asked_owner])))
    ranks = np.empty(n + len(asked), np.int64)
    ranks[order] = np.cumsum(order < n)
    return ranks[n:]


def _whole_times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that rows of one key and time stay together; more than a chunk is never held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        joined = batch if not held else pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), batch])
        changes = np.flatnonzero(~(same_as_next(joined.column(OWNER)) & same_as_next(joined.column(TIME))))
        if len(changes):
            cut = int(changes[-1]) + (0 if held else 1)  # the last row of the batch before stands first
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.concat_batches(held)


def _count(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Add ``_upper`` and ``_low``: the chunk's rows of the key up to the time, and up to one window before it."""
    last, kept, passed = None, np.zeros(0, np.int64), 0
    for batch in _whole_times(batches):
        owners, times = batch.column(OWNER), batch.column(TIME).to_numpy(zero_copy_only=False)
        n = len(times)
        goes_on = last is not None and bool(same_as_next(pa.concat_arrays([last, owners.slice(0, 1)]))[0])
        if not goes_on:
            kept, passed = np.zeros(0, np.int64), 0
        number = np.concatenate([[0], np.cumsum(~same_as_next(owners))])
        every_owner = np.concatenate([np.zeros(len(kept), np.int64), number])
        every_time = np.concatenate([kept, times])
        begun = np.searchsorted(every_owner, number, "left")  # rows of the keys before this one
        known = np.where(number == 0, passed, 0)
        upper = _ranks(every_owner, every_time, number, times) - begun + known
        low = _ranks(every_owner, every_time, number, times - window) - begun + known
        own = every_time[every_owner == number[-1]]
        gone = int(np.searchsorted(own, times[-1] - window, "right"))
        passed = gone + (passed if number[-1] == 0 else 0)
        last, kept = owners.slice(n - 1, 1), own[gone:]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(upper), pa.array(low)], [*batch.schema.names, "_upper", "_low"])


def _asked_ranks(requests: DataFrame, spans: DataFrame, rows: DataFrame, window: int, chunks: int | None) -> DataFrame:
    """``_owner, _at, _found``: how many rows of the key there are up to each time asked for."""
    parts = spans.select(OWNER, CHUNK, "_first", "_last", "_before", "_upto")
    later = parts.where(F.col("_before") > 0).select(
        F.col(OWNER).alias("_for"), F.col(CHUNK).alias("_by"), (F.col("_first") - window).alias("_lo"),
        F.least(F.col("_last") - window, F.col("_first") - 1).alias("_hi"))
    # Times asked of one chunk lie side by side: one stretch for each chunk is enough.
    needed = parts.join(later, (F.col(OWNER) == F.col("_for")) & (F.col(CHUNK) < F.col("_by")) &
                        (F.col("_first") <= F.col("_hi")) & (F.col("_last") >= F.col("_lo")))
    needed = needed.groupBy(OWNER, CHUNK).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    inside = rows.join(F.broadcast(needed), [OWNER, CHUNK])
    known = inside.where(F.col(TIME).between(F.col("_lo"), F.col("_hi"))).groupBy(OWNER, F.col(TIME).alias("_at")).agg(
        F.max("_rank").alias("_r"))
    floors = inside.where(F.col(TIME) < F.col("_lo")).groupBy(OWNER, F.col("_lo").alias("_at")).agg(F.max("_rank").alias("_r"))
    ends = spans.select(OWNER, F.col("_last").alias("_at"), F.col("_upto").alias("_r"))
    values = known.unionByName(floors).unionByName(ends).withColumn("_kind", F.lit(0))
    asked = requests.groupBy(OWNER, "_at").agg(F.lit(None).cast("bigint").alias("_r")).withColumn("_kind", F.lit(1))
    # Ranks grow with time, so the last one at or before a time is the largest so far.
    local = scanned(values.unionByName(asked), [OWNER], ["_at", "_kind"], [Running("_found", "max", "_r")], chunks)
    passed = carried_on(local, [OWNER], ["_found"], lambda totals: totals.withColumn(
        "_found_before", F.max("_found").over(before([CHUNK], [OWNER]))))
    found = F.coalesce(F.greatest("_found", "_found_before"), F.lit(0))
    return passed.where("_kind = 1").select(OWNER, "_at", found.alias("_found"))


def trailing_counts(df: DataFrame, us: str, keys: Sequence[str], window_us: int, name: str,
                    chunks: int | None = None) -> DataFrame:
    """Every row with the number of rows of its key in the trailing ``window_us``, those of the same time included.

    Null keys are keys like any other; a row without a time counts nowhere and has null.  Rows of one time may fill
    many chunks; only rows alike in every column are bound to one.
    """
    owner = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    # Inside a struct a null key is a value like any other, for the windows and for the joins alike.
    rows = df.where(F.col(us).isNotNull()).withColumns(
        {OWNER: owner, TIME: F.col(us).cast("bigint"), "_tie": F.xxhash64(*df.columns)})
    order = [OWNER, TIME, "_tie"]
    pieces = chunked(rows, order, chunks).sortWithinPartitions(*order).drop("_tie")
    counted = T.StructType([*pieces.schema.fields, T.StructField("_upper", T.LongType()), T.StructField("_low", T.LongType())])
    local = stored_table(pieces.mapInArrow(lambda batches: _count(batches, window_us), counted), "trailing")

    # One row for each chunk and key; of those with several chunks there are at most two in a chunk.
    parts = local.groupBy(OWNER, CHUNK).agg(
        F.max("_upper").alias("_n"), F.min("_upper").alias("_n_first"), F.min(TIME).alias("_first"), F.max(TIME).alias("_last"))
    whole = W.partitionBy(OWNER)
    spans = parts.withColumn("_chunks", F.count("*").over(whole)).where("_chunks > 1").withColumn(
        "_before", F.coalesce(F.sum("_n").over(before([CHUNK], [OWNER])), F.lit(0)))
    # Rows of a chunk's last time that lie in later chunks: the first times of those.
    edges = spans.select(OWNER, CHUNK, F.inline(F.array(
        F.struct(F.col("_first").alias("_at"), F.col("_n_first").alias("_more"), F.lit(False).alias("_end")),
        F.struct(F.col("_last").alias("_at"), F.lit(0).cast("bigint").alias("_more"), F.lit(True).alias("_end")))))
    after = W.partitionBy(OWNER, "_at").orderBy(CHUNK).rangeBetween(1, W.unboundedFollowing)
    edges = edges.withColumn("_more", F.coalesce(F.sum("_more").over(after), F.lit(0))).where("_end").select(OWNER, CHUNK, "_more")
    spans = checkpointed(spans.join(edges, [OWNER, CHUNK]).withColumn("_upto", F.col("_before") + F.col("_n") + F.col("_more")))

    carried = F.broadcast(spans.select(OWNER, CHUNK, "_first", "_last", "_before", "_more"))
    rows = local.join(carried, [OWNER, CHUNK], "left")
    more = F.when(F.col(TIME) == F.col("_last"), F.col("_more")).otherwise(0)
    rows = rows.withColumn("_rank", F.coalesce("_before", F.lit(0)) + F.col("_upper") + F.coalesce(more, F.lit(0)))
    unseen = (F.coalesce("_before", F.lit(0)) > 0) & (F.col("_low") == 0)
    seen = rows.where(~unseen).withColumn(name, F.col("_rank") - F.col("_low") - F.coalesce("_before", F.lit(0)))
    outside = rows.where(unseen).withColumn("_at", F.col(TIME) - window_us)
    found = _asked_ranks(outside.select(OWNER, "_at"), spans, rows.select(OWNER, CHUNK, TIME, "_rank"), window_us, chunks)
    outside = outside.join(found, [OWNER, "_at"]).withColumn(name, F.col("_rank") - F.col("_found"))
    columns = [*df.columns, name]
    untimed = df.where(F.col(us).isNull()).withColumn(name, F.lit(None).cast("bigint"))
    return seen.select(*columns).unionByName(outside.select(*columns)).unionByName(untimed.select(*columns))
