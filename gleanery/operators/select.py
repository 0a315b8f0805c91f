"""The n-th row of a table in a given order, found by histograms instead of a sort.

The order is a list of binary columns compared byte by byte.  Each round skips the bytes all remaining rows share, counts
the rows by their next two bytes, and goes on with the one bin that holds the n-th row; columns come one after the
other.  Rows are never moved: an exchange holds at most 65 793 counts of a task, and at the end the few rows left.
"""

from __future__ import annotations

from collections.abc import Sequence
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

# Bytes a histogram tells apart: 256 ** 2 bins, and those of rows that end within them.
STEP = 2
# So few rows are put in order directly.
FEW = 1 << 12


def newest_first(ts: Column) -> Column:
    """A timestamp as eight bytes in falling order, null last."""
    falling = F.unhex(F.lpad(F.hex(F.lit(1 << 62) - F.unix_micros(ts)), 16, "0"))
    return F.coalesce(falling, F.lit(b"\xff" * 8))


def text_bytes(text: Column) -> Column:
    """A text in the order of its code points; null as the empty text."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def nth_row(df: DataFrame, order: Sequence[Column], n: int) -> Row | None:
    """The ``n``-th row (from 1), none if there are fewer.  Of rows equal in all of ``order`` any may be returned.

    ``df`` is read once or more for every round: hand over a table, not a long computation.
    """
    rows, left = df, n
    for key in order:
        while True:
            low, high, count = rows.agg(F.min(key), F.max(key), F.count("*")).first()
            if left < 1 or left > count:
                return None
            if count <= FEW:
                return rows.orderBy(*order).limit(left).collect()[-1]
            if low == high:
                break
            piece = F.substring(key, len(commonprefix([bytes(low), bytes(high)])) + 1, STEP)
            bins = rows.groupBy(piece.alias("piece")).agg(F.count("*").alias("n")).collect()
            for value, size in sorted((bytes(row["piece"]), row["n"]) for row in bins):
                if left <= size:
                    break
                left -= size
            rows = rows.where(piece == F.lit(value))
    return rows.first()
