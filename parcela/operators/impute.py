"""Missing-value handling and target preparation.

Sentinels (-1) become a 0/1 flag plus the column's median over the
non-sentinel rows.  All medians come from one grouped count of (column,
value) and are fed back as one scalar subquery, instead of one driver round
trip per column.  Exact medians by default; ``approximate`` switches to
``percentile_approx`` with a documented accuracy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.operators.joins import scalar_row
from parcela.operators.quantiles import exact_quantiles
from parcela.schema import IMPUTE_COLUMNS, PRICE, PRICE_TRIM_HIGH, PRICE_TRIM_LOW, UNKNOWN_NUMBER


def trim_prices(df: DataFrame, low: float = PRICE_TRIM_LOW,
                high: float = PRICE_TRIM_HIGH) -> DataFrame:
    """keep ``low <= price_per_m2 <= high`` (bounds are parameters)."""
    return df.filter(F.col(PRICE).between(low, high))


def sentinel_medians(df: DataFrame, columns: list[str] = IMPUTE_COLUMNS,
                     approximate: bool = False, accuracy: int = 10_000) -> DataFrame:
    """One row; per column the median over non-sentinel rows,
    the sentinel count and the null count.

    ``approximate`` takes ``percentile_approx``, whose rank is off by at most one
    part in ``accuracy`` of the rows.
    """
    number = {c: F.col(f"`{c}`").cast("double") for c in columns}
    if approximate:
        counts = [a for c, v in number.items() for a in (F.count_if(v == UNKNOWN_NUMBER).alias(f"{c}__sentinels"),
                                                         F.count_if(v.isNull()).alias(f"{c}__nulls"))]
        return df.agg(*counts, *[F.percentile_approx(F.when(v != UNKNOWN_NUMBER, v), F.lit(0.5), F.lit(accuracy)).cast("double").alias(f"{c}__median")
                                 for c, v in number.items()])
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), v.alias("k")) for c, v in number.items()])
    # The value beside its key, as an aggregate: no filter on it goes below the
    # counting, so medians and counts share this one pass over the rows.
    counted = df.select(F.inline(pairs)).groupBy("c", "k").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("v"))
    medians = exact_quantiles(counted, F.when(F.col("v") != UNKNOWN_NUMBER, F.col("v")), [0.5], ["c"], F.col("n"))
    none = F.lit(None).cast("bigint")
    found = (medians.select("c", "q", none.alias("sentinels"), none.alias("nulls"))
             .unionByName(counted.select("c", F.lit(None).cast("double").alias("q"), F.when(F.col("v") == UNKNOWN_NUMBER, F.col("n")).alias("sentinels"),
                                         F.when(F.col("v").isNull(), F.col("n")).alias("nulls"))))
    of = lambda c, x: F.when(F.col("c") == c, F.col(x))
    counts = [F.coalesce(F.sum(of(c, x)), F.lit(0).cast("bigint")).alias(f"{c}__{x}") for c in columns for x in ("sentinels", "nulls")]
    return found.agg(*counts, *[F.max(of(c, "q")).alias(f"{c}__median") for c in columns])


def flag_and_fill(df: DataFrame, columns: list[str] = IMPUTE_COLUMNS,
                  medians: dict[str, Column | float] | None = None,
                  approximate: bool = False) -> DataFrame:
    """K7: ``<c>_missing_flag`` = (c == -1); -1 replaced by the median.

    A null (not -1) keeps flag 0 and stays null.  ``medians`` may carry
    stored training medians (scoring); otherwise they are computed from
    ``df`` itself in a single pass.
    """
    if medians is None:
        stats = scalar_row(sentinel_medians(df, columns, approximate))
        medians = {c: stats[f"{c}__median"] for c in columns}
    out = []
    for name in df.columns:
        if name in columns:
            v = F.col(name).cast("double")
            m = medians[name]
            m = m if isinstance(m, Column) else F.lit(float(m))
            out.append(F.when(v == UNKNOWN_NUMBER, m).otherwise(v).alias(name))
        else:
            out.append(F.col(name))
    flags = [F.when(F.col(c) == UNKNOWN_NUMBER, 1).otherwise(0).alias(f"{c}_missing_flag")
             for c in columns]
    return df.select(*out, *flags)


def fill_with_median(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """K8: -1 -> median of the non-sentinel rows, no flag (page preprocessing)."""
    stats = scalar_row(sentinel_medians(df, columns, approximate))
    out = []
    for name in df.columns:
        if name in columns:
            v = F.col(f"`{name}`").cast("double")
            m = stats[f"{name}__median"]
            out.append(F.when(v == UNKNOWN_NUMBER, m).otherwise(v).alias(name))
        else:
            out.append(F.col(f"`{name}`"))
    return df.select(*out)


#: Short names that page tables carry beside the full ones.
SHORT_NAMES = {"area (m2)": "area_m2", "street (m)": "street_width_m"}
PAGE_COLUMNS = ["area (m2)", *IMPUTE_COLUMNS, "street (m)"]


def with_short_names(df: DataFrame) -> DataFrame:
    """A short-named copy of area and street.  A table with the short name alone is left
    as it is; ``ValueError`` if it has neither."""
    for full, short in SHORT_NAMES.items():
        if full in df.columns:
            df = df.withColumn(short, F.col(f"`{full}`"))
        elif short not in df.columns:
            raise ValueError(f"no column {full!r} or {short!r}")
    return df


def page_table(clean: DataFrame) -> DataFrame:
    """C5 + K8: short-named copies, then all six numbers without sentinels."""
    named = with_short_names(clean)
    return fill_with_median(named, [c for c in PAGE_COLUMNS if c in named.columns])


def log_target(df: DataFrame) -> DataFrame:
    """K9: ``price_log = log1p(price_per_m2)``; price read back as double."""
    return df.withColumns({PRICE: F.col(PRICE).cast("double"),
                           "price_log": F.log1p(F.col(PRICE).cast("double"))})


def model_table(clean: DataFrame, low: float = PRICE_TRIM_LOW, high: float = PRICE_TRIM_HIGH,
                approximate: bool = False) -> DataFrame:
    """Training table: typed, flagged + median-filled counts, trimmed, log target.

    Medians are taken before the trim, as in the source training job.
    """
    typed = clean.withColumns({"area (m2)": F.col("area (m2)").cast("double"),
                               "street (m)": F.col("street (m)").cast("double")})
    return log_target(trim_prices(flag_and_fill(typed, approximate=approximate), low, high))
