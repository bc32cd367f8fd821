"""Exact quantiles without a value map in one task.

Values are counted by a grouped aggregate (reduced before the shuffle), so a
frequent value costs one row.  Each value falls into a bucket that is a
monotone function of it; bucket totals (at most some ten thousand rows,
whatever the input: the bucket number has that many values) give the bucket
that holds each wanted rank, and only these buckets are put in order to pick
the ranks.  Interpolation is linear, as in ``percentile``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets a factor of e: finite doubles span 710 such factors on either side of zero.
BUCKETS_PER_E = 64


def _bucket(x: Column) -> Column:
    return F.floor(F.signum(x) * F.log1p(F.abs(x)) * BUCKETS_PER_E).cast("int")


def exact_quantiles(df: DataFrame, value: Column, probabilities: Sequence[float],
                    groups: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """(groups..., p, q): quantile ``q`` for each probability.  Null and NaN values
    are not counted; a group without values has no row.  ``weight`` is the number of
    times a row's value counts (once by default)."""
    g = list(groups)
    rows = df.select(*g, value.cast("double").alias("_x"), *([] if weight is None else [weight.alias("_w")]))
    times = F.count(F.lit(1)) if weight is None else F.sum("_w")
    # The value beside its key, as an aggregate: what the join infers of the bucket does not
    # go below the counting, so both uses of the counts share one pass over the rows.
    counted = (rows.where("_x IS NOT NULL AND NOT isnan(_x)").withColumnRenamed("_x", "_k")
               .groupBy(*g, "_k").agg(times.alias("_n"), F.max("_k").alias("_x")).withColumn("_b", _bucket(F.col("_x"))).drop("_k"))
    order = Window.partitionBy(*g).orderBy("_b")
    before = F.sum("_bn").over(order.rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("_bn").over(Window.partitionBy(*g))
    buckets = (counted.groupBy(*g, "_b").agg(F.sum("_n").alias("_bn"))
               .select(*g, "_b", "_bn", F.coalesce(before, F.lit(0)).alias("_before"), total.alias("_total")))
    # Every probability asks for the two ranks about its position.
    at = [F.struct(F.lit(float(p)).alias("p"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("pos")) for p in probabilities]
    wanted = (buckets.select(*g, "_b", "_bn", "_before", F.inline(F.array(*at)))
              .select("*", F.inline(F.array(F.struct(F.lit(0).alias("side"), F.floor("pos").alias("rank")),
                                            F.struct(F.lit(1).alias("side"), F.ceil("pos").alias("rank")))))
              .where("rank >= _before AND rank < _before + _bn")
              .select(*[F.col(c).alias(f"_k{c}") for c in g], F.col("_b").alias("_kb"), "_before", "p", "pos", "side", "rank"))
    # At most two rows a probability and group.
    match = F.col("_b") == F.col("_kb")
    for c in g:
        match = match & F.col(c).eqNullSafe(F.col(f"_k{c}"))
    inside = Window.partitionBy(*g, "_b", "p", "side").orderBy("_x")
    ranked = (counted.join(wanted, match).withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
              .where("rank < _upto AND rank >= _upto - _n"))
    low = F.max(F.when(F.col("side") == 0, F.col("_x")))
    high = F.max(F.when(F.col("side") == 1, F.col("_x")))
    share = F.max(F.col("pos") - F.floor("pos"))
    return ranked.groupBy(*g, "p").agg((low + (high - low) * share).alias("q"))


def value_counts(df: DataFrame, value: Column, *more: Column) -> DataFrame:
    """(k, more..., n, x): rows of each value (and of each of ``more``), counted in one pass that every reader shares.

    A null value has a row, too.  ``x`` stands beside its key, as an aggregate, so
    that no filter on it goes below the counting.
    """
    names = [f"m{i}" for i in range(len(more))]
    keyed = df.select(value.cast("double").alias("k"), *[m.alias(n) for m, n in zip(more, names)])
    # No projection above: one that reorders the aggregates would keep Spark from reusing their exchange.
    return keyed.groupBy("k", *names).agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("x"))


def counted_mean(value: Column, times: Column) -> Column:
    """The mean of values that count ``times`` each; null without values."""
    return F.try_divide(F.sum(value * times), F.sum(F.when(value.isNotNull(), times)))


def quantile_row(df: DataFrame, value: Column, named: dict[str, float], approximate: bool = False,
                 accuracy: int = 10_000, weight: Column | None = None) -> DataFrame:
    """One row, a column for each named probability; null without values.  ``weight`` is
    the number of times a row's value counts, for exact quantiles.

    ``approximate`` takes ``percentile_approx``: a value of the data whose rank is
    off by no more than one part in ``accuracy`` of the rows.
    """
    if approximate:
        return df.agg(*[F.percentile_approx(value.cast("double"), F.lit(p), F.lit(accuracy)).alias(n) for n, p in named.items()])
    found = exact_quantiles(df, value, sorted(set(named.values())), weight=weight)
    return found.agg(*[F.max(F.when(F.col("p") == F.lit(float(p)), F.col("q"))).alias(n) for n, p in named.items()])
