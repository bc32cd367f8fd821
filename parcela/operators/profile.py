"""Profiling and inspection.

Counts and null counts are one aggregate each (partial + final, no
per-column jobs).  The before / during / after cleaning report is computed
in a single pass over the raw rows: the clean expressions are evaluated
alongside the raw columns and every stage is a conditional count.
Quantile statistics are exact and distributed (``quantiles``); the box-plot
fences that depend on them are fed back as scalar subqueries (no join, no collect).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.operators.clean import CLEAN_NAMES, normalized_columns, parsed_columns
from parcela.operators.joins import scalar_row
from parcela.operators.quantiles import counted_mean, exact_quantiles, quantile_row, value_counts
from parcela.schema import PRICE, PRICE_TRIM_HIGH, PRICE_TRIM_LOW

RAW_NAMES = ["title", "link", "price", "area", "category", "direction", "liability",
             "location", "street", "floor_num", "toilet_num", "livingroom_num",
             "bedroom_num"]
DROPPED_NAMES = [c for c in RAW_NAMES if c not in ("title", "link")]


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row, one null count per column (named after the column)."""
    cols = columns or df.columns
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])


def table_overview(df: DataFrame) -> DataFrame:
    """P3 + P1 + P8: (position, column_name, type, rows, nulls, is_empty), a row a column."""
    nulls = {f"_{i}": F.count_if(F.col(f"`{c}`").isNull()) for i, c in enumerate(df.columns)}
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in nulls.items()])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("column_name"), F.lit(kind).alias("type"), F.col("rows"),
                 F.col(f"_{i}").alias("nulls"), (F.col("rows") == 0).alias("is_empty")) for i, (name, kind) in enumerate(df.dtypes)])))


def preview(df: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    """First ``n`` rows under an explicit order (Spark has no file order)."""
    return df.orderBy(*order).limit(n)


def _long(stage_aggs: list[tuple[str, str, Column, Column]]) -> Column:
    return F.inline(F.array(*[
        F.struct(F.lit(s).alias("stage"), F.lit(c).alias("column_name"),
                 rows.cast("bigint").alias("rows"), nulls.cast("bigint").alias("nulls"))
        for s, c, rows, nulls in stage_aggs]))


def cleaning_report(raw: DataFrame) -> DataFrame:
    """(stage, column_name, rows, nulls) for raw, after the null drop, and clean.

    One scan and one aggregate for all three stages.
    """
    kept = F.col("price").isNotNull() & F.col("area").isNotNull()
    # The cleaning job's own two steps, beside the raw columns.
    texts = raw.select(F.struct(*RAW_NAMES).alias("_raw"), kept.alias("_kept"), *normalized_columns())
    staged = texts.select("_raw.*", "_kept", *[e.alias(f"_c_{n}") for e, n in zip(parsed_columns(), CLEAN_NAMES)])
    staged = staged.withColumn("_clean", F.col("_kept") & F.col(f"_c_{PRICE}").isNotNull())
    aggs = [F.count(F.lit(1)).alias("raw_rows"),
            F.count_if(F.col("_kept")).alias("drop_rows"),
            F.count_if(F.col("_clean")).alias("clean_rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"raw_{c}") for c in RAW_NAMES]
    aggs += [F.count_if(F.col("_kept") & F.col(c).isNull()).alias(f"drop_{c}") for c in DROPPED_NAMES]
    aggs += [F.count_if(F.col("_clean") & F.col(f"_c_{c}").isNull()).alias(f"clean_{c}")
             for c in CLEAN_NAMES]
    wide = staged.agg(*aggs)
    entries = ([("raw", c, F.col("raw_rows"), F.col(f"raw_{c}")) for c in RAW_NAMES]
               + [("after_drop", c, F.col("drop_rows"), F.col(f"drop_{c}")) for c in DROPPED_NAMES]
               + [("clean", c, F.col("clean_rows"), F.col(f"clean_{c}")) for c in CLEAN_NAMES])
    return wide.select(_long(entries))


def price_summary(df: DataFrame, col: str = PRICE, approximate: bool = False) -> DataFrame:
    """P5: typed twin of ``summary()`` with exact quartiles.

    Values are counted once; quartiles, moments and extremes come from the counts.
    """
    x = F.col(col).cast("double")
    named = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    if approximate:
        return df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("stddev"), F.min(x).alias("min"),
                      F.max(x).alias("max")).withColumns(scalar_row(quantile_row(df, x, named, approximate)))
    values = value_counts(df, x)
    x, n = F.col("x"), F.col("n")
    q = scalar_row(quantile_row(values, x, named, weight=n))
    mean = scalar_row(values.agg(counted_mean(x, n).alias("mean")))["mean"]
    count = F.coalesce(F.sum(F.when(x.isNotNull(), n)), F.lit(0).cast("bigint"))
    # Squares about the mean: sums of squares about zero would lose digits.
    spread = F.sqrt(F.try_divide(F.sum((x - mean) * (x - mean) * n), F.nullif(count - 1, F.lit(0))))
    return values.agg(count.alias("count"), counted_mean(x, n).alias("mean"), spread.alias("stddev"),
                      F.min(x).alias("min"), F.max(x).alias("max")).withColumns(q)


def price_boxplot(df: DataFrame, col: str = PRICE, low: float = PRICE_TRIM_LOW,
                  high: float = PRICE_TRIM_HIGH) -> DataFrame:
    """Box-plot statistics of the price before and after the trim.

    Prices are counted once by stage and value; the quartiles come from these
    counts, and so do whiskers (most extreme value inside 1.5 IQR of the
    quartiles) and outlier counts.
    """
    x = F.col(col).cast("double")
    stages = F.when(x.between(low, high), F.array(F.lit("before_trim"), F.lit("after_trim"))).otherwise(F.array(F.lit("before_trim")))
    vals = df.where(x.isNotNull()).select(F.explode(stages).alias("stage"), x.alias("x"))
    # The price beside its key, as an aggregate: no filter on it goes below the counting.
    counted = vals.groupBy("stage", F.col("x").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("x"))
    quart = (exact_quantiles(counted, F.col("x"), [0.25, 0.5, 0.75], ["stage"], F.col("n")).groupBy("stage")
             .agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
             .withColumn("iqr", F.col("q3") - F.col("q1")))
    fenced = counted.join(quart, "stage").withColumn(
        "inside", F.col("x").between(F.col("q1") - 1.5 * F.col("iqr"), F.col("q3") + 1.5 * F.col("iqr")))
    return fenced.groupBy("stage", "q1", "median", "q3", "iqr").agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("inside"), F.col("x"))).alias("whisker_low"),
        F.max(F.when(F.col("inside"), F.col("x"))).alias("whisker_high"),
        F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("outliers"))
