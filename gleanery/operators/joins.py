"""Joins on keys: size-checked broadcasts, and rows without a key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What every executor may hold of a broadcast table of keys.
BROADCAST_BYTES = 128 << 20
_ROW_BYTES = 64


def broadcast_if_small(keys: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """Mark a narrow table for broadcast when its measured size allows it; else leave the choice to Spark.

    Worth its small job where the other side is a wide table: without the mark Spark may have shuffled that side by
    the time it learns how few keys there are.  ``bound`` is measured instead where it is cheaper to compute; it must
    have the rows of ``keys`` or more of them.
    """
    bound = keys if bound is None else bound
    kinds = {f.name: f.dataType.typeName() for f in bound.schema.fields}
    text = [F.col(n) if kind == "string" else F.to_json(n) for n, kind in kinds.items() if kind in ("string", "struct")]
    size = sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in text), F.lit(_ROW_BYTES)).cast("long")
    measured = bound.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()["bytes"]
    return F.broadcast(keys) if measured <= BROADCAST_BYTES else keys


def join_back(rows: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row with the values of its key; rows whose key is null have theirs like any other."""
    left, right = rows.alias("_rows"), values.alias("_values")
    same = reduce(lambda a, b: a & b, (F.col(f"_rows.{k}").eqNullSafe(F.col(f"_values.{k}")) for k in keys))
    added = [F.col(f"_values.{c}") for c in values.columns if c not in keys]
    return left.join(right, same, "left").select("_rows.*", *added)
