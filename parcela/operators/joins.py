"""Scalar values read from one-row frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar_row(one_row: DataFrame) -> dict[str, Column]:
    """The columns of a one-row aggregate as scalar-subquery values.

    The row is read as ONE struct-valued scalar subquery, so every field
    reference reuses the same subquery and the aggregate runs once; no join
    and no collect to the driver.
    """
    s = one_row.select(F.struct(*one_row.columns).alias("s")).scalar()
    return {c: s.getField(c) for c in one_row.columns}
