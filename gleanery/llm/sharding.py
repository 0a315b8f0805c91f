"""Resharding by minimum-cost flow: from old shards' sizes and new capacities, the transfers that move the fewest bytes.

The files of a table are its old shards' blocks, in order of file and row.  A flow from old shards to new ones costs
nothing where bytes stay and the same for every byte that moves, with the nearer shard before the farther.  What it
sends from one shard to another is a stretch of the old shard's bytes, hence of its rows, so a plan is a few row numbers:
every row finds its new shard and its place there by arithmetic, and no row is shuffled.  Files that lie in one stretch
which stays are left as they are; only the others are written anew.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.registry import query, table
from gleanery.llm.text import stored
from gleanery.operators.joins import broadcast_if_small

SHARDS = 16
# Rows summed up together; the ones in which a cut falls are gone through row by row.
LOT_ROWS = 16_384


class Stretch(NamedTuple):
    """Rows ``first`` to below ``end`` of shard ``old`` go to shard ``new``, from ``slot`` on."""

    old: int
    new: int
    first: int
    end: int
    slot: int


def move_costs(old: int, new: int) -> np.ndarray:
    """Staying is free; every move costs so much that no choice of nearer shards is worth one more."""
    apart = np.abs(np.arange(old)[:, None] - np.arange(new)[None, :])
    return np.where(apart == 0, 0, 2 * (max(old, new) + 1) ** 3 + apart**2).astype(np.int64)


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], costs: np.ndarray) -> np.ndarray:
    """Amounts ``(old, new)`` of least total cost that place all of ``supply`` within ``capacity``.

    Successive shortest paths with potentials.  The graph has one node for each shard, whatever the table holds.
    """
    n, m = costs.shape
    left, room = np.array(supply, dtype=object), np.array(capacity, dtype=object)
    if left.sum() > room.sum():
        raise ValueError(f"{left.sum()} bytes do not fit into {room.sum()}")
    flow = np.zeros((n, m), dtype=object)
    potential = np.zeros(n + m, np.int64)
    infinite = np.iinfo(np.int64).max // 4
    while (left > 0).any():
        away = np.full(n + m, infinite, np.int64)
        away[:n][left > 0] = 0
        parent, done = np.full(n + m, -1), np.zeros(n + m, bool)
        while True:
            node = int(np.where(done, infinite, away).argmin())
            if done[node] or away[node] >= infinite:
                break
            done[node] = True
            if node < n:
                there, step = np.arange(n, n + m), costs[node]
            else:  # back along what already flows
                there = np.flatnonzero(flow[:, node - n] > 0)
                step = -costs[there, node - n]
            reach = away[node] + step + potential[node] - potential[there]
            better = ~done[there] & (reach < away[there])
            away[there[better]] = reach[better]
            parent[there[better]] = node
        open_ = np.flatnonzero((room > 0) & (away[n:] < infinite)) + n
        end = int(open_[(away[open_] + potential[open_]).argmin()])
        potential += np.minimum(away, away[end])
        path = [end]
        while parent[path[-1]] >= 0:
            path.append(int(parent[path[-1]]))
        steps = list(zip(path[1:], path))
        amount = min([left[path[-1]], room[end - n], *(flow[b, a - n] for a, b in steps if a >= n)])
        for a, b in steps:
            if a < n:
                flow[a, b - n] += amount
            else:
                flow[b, a - n] -= amount
        left[path[-1]] -= amount
        room[end - n] -= amount
    return flow


def equal_shares(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def _size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def located(documents: DataFrame) -> DataFrame:
    """``documents`` as struct ``_row``, with the ``file`` and ``place`` each row was read from."""
    meta = documents.metadataColumn("_metadata")
    return documents.select(F.struct("*").alias("_row"), meta["file_path"].alias("file"), meta["row_index"].alias("place"))


def old_layout(rows: DataFrame, old_shards: int) -> DataFrame:
    """Lots of rows of ``(file, place, size)``: ``old, file, lot, n, bytes, rows_before, bytes_before`` in their old shard.

    Files by path are dealt to the old shards in turn.
    """
    lot = F.floor(F.col("place") / LOT_ROWS).alias("lot")
    lots = stored(rows.groupBy("file", lot).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "shard-lots")
    files = lots.select("file").distinct().withColumn("file_no", F.row_number().over(Window.orderBy("file")) - 1)  # a row a file
    lots = lots.join(broadcast_if_small(files), "file").withColumn("old", F.col("file_no") % old_shards)
    before = Window.partitionBy("old").orderBy("file_no", "lot").rowsBetween(Window.unboundedPreceding, -1)
    return lots.select(
        "old", "file", "lot", "n", "bytes", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"))


def plan_transfers(rows: DataFrame, lots: DataFrame, old_shards: int, capacities: Sequence[int] | None = None) -> list[Stretch]:
    """The stretches of every old shard, by order of rows; capacities default to equal shares of SHARDS."""
    sizes = {r["old"]: (r["n"], r["bytes"]) for r in lots.groupBy("old").agg(
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).collect()}
    supply = [sizes.get(i, (0, 0))[1] for i in range(old_shards)]
    capacities = equal_shares(sum(supply), SHARDS) if capacities is None else capacities
    flow = min_cost_flow(supply, capacities, move_costs(old_shards, len(capacities)))
    # What stays comes first, the transfers follow by new shard.
    order = [sorted(np.flatnonzero(flow[i] > 0).tolist(), key=lambda j, i=i: (j != i, j)) for i in range(old_shards)]
    cuts = [(i, k, int(sum(flow[i, j] for j in order[i][:k]))) for i in range(old_shards) for k in range(1, len(order[i]))]
    at = _rows_before_cuts(rows, lots, cuts)
    slots = [0] * len(capacities)
    plan = []
    for i in range(old_shards):
        bounds = [0, *(at[i, k] for k in range(1, len(order[i]))), sizes.get(i, (0, 0))[0]]
        for j, first, end in zip(order[i], bounds, bounds[1:]):
            plan.append(Stretch(i, j, first, end, slots[j]))
            slots[j] += end - first
    return plan


def _rows_before_cuts(rows: DataFrame, lots: DataFrame, cuts: list[tuple[int, int, int]]) -> dict[tuple[int, int], int]:
    """How many rows of the old shard lie before each cut ``(old, number, bytes)``: those with their middle before it."""
    if not cuts:
        return {}
    spark = rows.sparkSession
    wanted = F.broadcast(spark.createDataFrame(cuts, "old int, cut int, at long"))  # fewer than old and new shards
    inside = (F.col("bytes_before") <= F.col("at")) & (F.col("at") < F.col("bytes_before") + F.col("bytes"))
    hit = lots.join(wanted, "old").where(inside).select("old", "cut", "at", "file", "lot", "rows_before", "bytes_before").collect()
    hit_lots = F.broadcast(spark.createDataFrame(
        [tuple(r) for r in hit], "old int, cut int, at long, file string, lot long, rows_before long, bytes_before long"))
    near = rows.where(F.col("file").isin([r["file"] for r in hit])).withColumn("lot", F.floor(F.col("place") / LOT_ROWS))
    near = near.join(hit_lots, ["file", "lot"])
    order = Window.partitionBy("old", "cut").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    middle = 2 * (F.col("bytes_before") + F.sum("size").over(order)) - F.col("size")
    near = near.withColumn("left", (middle < 2 * F.col("at")).cast("long"))
    found = near.groupBy("old", "cut").agg((F.first("rows_before") + F.sum("left")).alias("rows")).collect()
    return {(r["old"], r["cut"]): r["rows"] for r in found}


def resharded(documents: DataFrame, old_shards: int = SHARDS, capacities: Sequence[int] | None = None) -> tuple[DataFrame, list[Stretch], DataFrame]:
    """Rows as ``_row, file, place, size, old, shard, slot``; the plan; and ``file, old, first_row, n`` of the files.

    ``documents`` is read from files and has a ``text``; a row's size is its bytes in UTF-8 and one more, null as empty.
    Capacities are bytes of the new shards (equal shares unless given); a row goes where its middle byte goes, so a shard
    is off its capacity by half a row at each end of each stretch.  Slots number a shard's rows from 0.  Repeated rows are
    rows of their own, null ids are kept, clashing columns stay inside ``_row``; an empty table gives an empty one.
    """
    rows = located(documents).withColumn("size", _size(F.col("_row.text")))
    narrow = rows.select("file", "place", "size")
    lots = stored(old_layout(narrow, old_shards), "shard-layout")
    plan = plan_transfers(narrow, lots, old_shards, capacities)
    files = lots.groupBy("file").agg(F.first("old").alias("old"), F.min("rows_before").alias("first_row"), F.sum("n").alias("n"))
    spark = documents.sparkSession
    stretches = spark.createDataFrame([tuple(s) for s in plan], "old int, shard int, first long, end long, first_slot long")
    numbered = rows.join(broadcast_if_small(files.drop("n")), "file").withColumn("_no", F.col("first_row") + F.col("place"))
    within = (numbered["old"] == stretches["old"]) & (F.col("_no") >= F.col("first")) & (F.col("_no") < F.col("end"))
    placed = numbered.join(F.broadcast(stretches), within)  # fewer than old and new shards
    return placed.select("_row", "file", "place", "size", numbered["old"], "shard", (
        F.col("first_slot") + F.col("_no") - F.col("first")).alias("slot")), plan, files


def rewrite_affected(documents: DataFrame, folder: str, old_shards: int = SHARDS, capacities: Sequence[int] | None = None) -> DataFrame:
    """Write the files that the new layout changes; ``shard, file, n, rewritten`` of all files of the new layout.

    A file all of whose rows stay where they are is named as it is.  The rows of the others go to ``folder/shard=…`` with
    their ``slot``; a shard's rows in order of ``slot`` are those of its kept files, then of its new ones, in turn.
    """
    placed, plan, files = resharded(documents, old_shards, capacities)
    spark = documents.sparkSession
    stays = [tuple(s) for s in plan if s.old == s.new]
    kept = spark.createDataFrame(stays, "old int, shard int, first long, end long, first_slot long")
    whole = (F.col("first_row") >= F.col("first")) & (F.col("first_row") + F.col("n") <= F.col("end"))
    kept = stored(files.join(F.broadcast(kept), "old").where(whole).select("shard", "file", "n"), "shard-kept")
    moved = placed.join(broadcast_if_small(kept.select("file")), "file", "left_anti")
    moved.select("_row.*", F.col("slot").alias("_slot"), F.col("shard").alias("_shard")).write.partitionBy("_shard").parquet(folder)
    own = [T.StructField("_slot", T.LongType()), T.StructField("_shard", T.IntegerType())]
    new = spark.read.schema(T.StructType([*documents.schema.fields, *own])).parquet(folder)
    new = new.groupBy(F.col("_shard").alias("shard"), new.metadataColumn("_metadata")["file_path"].alias("file")).agg(F.count("*").alias("n"))
    return kept.withColumn("rewritten", F.lit(False)).unionByName(new.withColumn("rewritten", F.lit(True)))


@query("op13_flow_reshard")
def flow_reshard(spark, folder):
    placed, _, _ = resharded(table(spark, folder, "documents").select("doc_id", "text"))
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    return placed.select(
        "_row.doc_id", "size", F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
