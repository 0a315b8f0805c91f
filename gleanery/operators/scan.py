"""Running totals and ranks over a whole table, or over keys of any size, without putting one key into one task.

Rows are range-partitioned by the full order, so a partition ("chunk") is a stretch of that order and a large key
spans many chunks.  Values are computed inside each chunk; one summary row per chunk and key carries the running
value on; the two are put together with a join on chunk and key.  The summaries number at most
``chunks + keys``, and at most ``chunks`` for any one key.

Where the order begins with the key, :func:`scanned` steps through the sorted partitions where they are, so the rows
are shuffled once, and only the first key of a chunk can have anything carried to it: at most one row per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.operators.joins import broadcast_if_small
from gleanery.session import checkpointed, shuffle_width, stored_table

CHUNK = "_chunk"


def chunked(df: DataFrame, order: Sequence[str | Column], chunks: int | None = None) -> DataFrame:
    """Add the chunk number.  ``order`` must be total.

    Range bounds are sampled, so a second evaluation could draw other ones: store what is derived from the result
    (:func:`gleanery.session.checkpointed`) before using it twice.
    """
    width = chunks or shuffle_width(df.sparkSession)
    return df.repartitionByRange(width, *order).withColumn(CHUNK, F.spark_partition_id())


def in_chunks(df: DataFrame, order: Sequence[str | Column], chunks: int | None = None) -> DataFrame:
    """Stored chunks: partition ``n`` holds chunk ``n`` in order."""
    return checkpointed(chunked(df, order, chunks).sortWithinPartitions(*order))


def before(order: Sequence[str | Column], keys: Sequence[str]):
    """All chunks of a key before the current one."""
    window = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    return window.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)


def up_to_here(order: Sequence[str | Column], keys: Sequence[str]):
    """All rows of a key up to the current one, inside its chunk."""
    return W.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


def with_row_number(df: DataFrame, order: Sequence[str | Column], name: str, chunks: int | None = None) -> DataFrame:
    """Add the rank from 0 over the whole table; the rows are shuffled once."""
    # The lower 33 bits of Spark's own numbers count the rows of a sorted partition.
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    numbered = stored_table(chunked(df, order, chunks).sortWithinPartitions(*order).withColumn("_inside", inside), "ranked")
    offsets = (
        numbered.groupBy(CHUNK).agg((F.max("_inside") + 1).alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before([CHUNK], [])), F.lit(0)))
        .select(CHUNK, "_offset")
    )
    # One row per chunk: always small enough to broadcast.
    return (
        numbered.join(F.broadcast(offsets), CHUNK)
        .withColumn(name, F.col("_offset") + F.col("_inside")).drop("_offset", "_inside")
    )


class Running(NamedTuple):
    """A column to add: the running ``sum`` or ``max`` of ``value``, less the running column ``less`` named earlier."""

    name: str
    kind: str
    value: str
    less: str | None = None


def same_as_next(column: pa.Array) -> np.ndarray:
    """For every row but the last, whether the next one has the same value; nulls are alike, and so are NaNs."""
    kind = column.type
    here, there = column.slice(0, len(column) - 1), column.slice(1)
    here_null, there_null = (c.is_null().to_numpy(zero_copy_only=False) for c in (here, there))
    if pa.types.is_struct(kind):
        same = np.ones(len(here), bool)
        for child in column.flatten():
            same &= same_as_next(child)
    elif pa.types.is_nested(kind):
        values = column.to_pylist()
        same = np.fromiter((a == b for a, b in zip(values, values[1:])), bool, len(here))
    else:
        same = pc.equal(here, there).fill_null(False).to_numpy(zero_copy_only=False)
        if pa.types.is_floating(kind):
            here_nan, there_nan = (pc.is_nan(c).fill_null(False).to_numpy(zero_copy_only=False) for c in (here, there))
            same = same | (here_nan & there_nan)
    return (here_null & there_null) | (same & ~here_null & ~there_null)


def _running_max(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Running maxima of stretches; ``start`` holds the first row of each row's stretch."""
    best, row, step = values.copy(), np.arange(len(values)), 1
    longest = int((row - start).max(initial=0))
    while step <= longest:
        reached = row[row - step >= start]
        best[reached] = np.maximum(best[reached], best[reached - step])
        step *= 2
    return best


def _scan(batches: Iterator[pa.RecordBatch], keys: Sequence[str], columns: Sequence[Running]) -> Iterator[pa.RecordBatch]:
    """Add the running columns to one sorted partition; a key's values go on from batch to batch."""
    lowest = np.iinfo(np.int64).min
    last_keys, carried = None, {}
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        first = np.ones(n, bool)
        key_columns = [batch.column(k) for k in keys]
        if n > 1:
            first[1:] = ~np.logical_and.reduce([same_as_next(c) for c in key_columns])
        goes_on = last_keys is not None and all(
            bool(same_as_next(pa.concat_arrays([old, c.slice(0, 1)]))[0]) for old, c in zip(last_keys, key_columns))
        start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        head = (start == 0) & goes_on  # rows of the key the batch before ended with
        running, added = {}, []
        for c in columns:
            column = batch.column(c.value)
            known = column.is_valid().to_numpy(zero_copy_only=False)
            values = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if c.less:
                less, less_known = running[c.less]
                values, known = values - less, known & less_known
            before, had = carried.get(c.name, (0, False))
            count = np.cumsum(known)
            seen = count - (count[start] - known[start]) > 0
            if c.kind == "sum":
                values = np.where(known, values, 0)
                total = np.cumsum(values)
                result = total - (total[start] - values[start]) + np.where(head & had, before, 0)
            else:
                result = _running_max(np.where(known, values, lowest), start)
                result = np.where(head & had, np.maximum(result, before), result)
            seen = seen | (head & had)
            running[c.name] = result, seen
            added.append(pa.array(result, pa.int64(), mask=~seen))
        carried = {name: (values[-1], bool(known[-1])) for name, (values, known) in running.items()}
        last_keys = [c.slice(n - 1, 1) for c in key_columns]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *(c.name for c in columns)])


def scanned(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[Running],
            chunks: int | None = None) -> DataFrame:
    """Stored chunks of the order ``keys, order`` with the running columns of each chunk and key, from one shuffle.

    Values are whole numbers.  Nulls add nothing; a running value is null until its key had one that is not.  Null keys
    are keys like any other.
    """
    pieces = chunked(df, [*keys, *order], chunks).sortWithinPartitions(*keys, *order)
    pieces = pieces.withColumns({c.value: F.col(c.value).cast("bigint") for c in columns})
    schema = T.StructType([*pieces.schema.fields, *(T.StructField(c.name, T.LongType()) for c in columns)])
    return stored_table(pieces.mapInArrow(lambda batches: _scan(batches, keys, columns), schema), "scanned")


def carried_on(local: DataFrame, keys: Sequence[str], values: Sequence[str], into: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of :func:`scanned` with what ``into`` adds to the summaries, null for a key that begins in its chunk.

    A summary row has a key, a chunk and the largest of each of ``values``.  Only the first key of a chunk can have an
    earlier chunk, so at most one row per chunk is broadcast.
    """
    totals = local.groupBy(*keys, CHUNK).agg(*(F.max(v).alias(v) for v in values))
    begun = F.count("*").over(before([CHUNK], keys)) > 0
    carried = into(totals.withColumn("_begun", begun)).where("_begun").drop("_begun", *values)
    left, right = local.alias("_rows"), F.broadcast(carried).alias("_carried")
    same = F.col(f"_rows.{CHUNK}") == F.col(f"_carried.{CHUNK}")
    for k in keys:
        same &= F.col(f"_rows.{k}").eqNullSafe(F.col(f"_carried.{k}"))
    added = [F.col(f"_carried.{c}") for c in carried.columns if c not in (*keys, CHUNK)]
    return left.join(right, same, "left").select("_rows.*", *added)


def _running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, name: str,
             fold: Callable[[Column | str], Column], combine: Callable[[Column, Column], Column],
             summary: Callable[[str], Column]) -> DataFrame:
    local = checkpointed(df.withColumn("_local", fold(value).over(up_to_here(order, keys))))
    carried = (
        local.groupBy(*keys, CHUNK).agg(summary("_local").alias("_chunk_value"))
        .withColumn("_before", fold("_chunk_value").over(before([CHUNK], keys)))
        .select(*keys, CHUNK, "_before")
    )
    return (
        local.join(broadcast_if_small(carried), [*keys, CHUNK])
        .withColumn(name, combine(F.col("_before"), F.col("_local"))).drop("_before", "_local")
    )


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column,
                name: str) -> DataFrame:
    """Add the running maximum of ``value`` per key, on rows that have their chunk; keys must not be null."""
    return _running(df, keys, order, value, name, F.max, F.greatest, F.max)


def running_count(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column,
                  name: str) -> DataFrame:
    """Add the running sum of a ``value`` that is never negative, as :func:`running_max` does the maximum."""
    def add(earlier: Column, here: Column) -> Column:
        return F.coalesce(earlier, F.lit(0)) + here

    # The last running sum of a chunk is also its largest.
    return _running(df, keys, order, value, name, F.sum, add, F.max)
