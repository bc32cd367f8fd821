"""Global positions by range-partitioned offsets.

Rows are sorted into ranges over the cluster, each range counts its rows, the
counts' running sums are the ranges' first positions, and a row's position is
its range's first one plus its place inside.  No row and no key reaches the
driver; what is gathered is one count a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcela.session import checkpointed


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with ``name``, the 0-based place of each row in ``order``.

    Rows that ``order`` does not tell apart are numbered among themselves in
    some order, so it should be total.  An empty table gives an empty one.
    The sorted rows are written once to the checkpoint folder: the ranges
    that are counted are then those that are numbered, whatever is lost.
    """
    at, part, first = f"{name}__at", f"{name}__part", f"{name}__first"
    rows = checkpointed(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()))
    rows = rows.withColumns({part: F.shiftright(at, 33), at: F.col(at).bitwiseAND(F.lit((1 << 33) - 1))})
    # One row a range, so this window over all of them is small whatever the table's size.
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ranges = (rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
              .select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first)))
    return (rows.join(ranges, part)
            .select(*[F.col(f"`{c}`") for c in df.columns], (F.col(at) + F.col(first)).alias(name)))
