"""Market statistics over clean listings.

All statistics are single aggregates with partial (map-side) combining, so
a city or district holding a third of the rows is reduced per partition
before any shuffle.  Quantiles are exact and distributed
(``quantiles``), with ``approximate`` as a parameter.  Top-k reports end in TakeOrderedAndProject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.operators.joins import scalar_row
from parcela.operators.quantiles import counted_mean, quantile_row, value_counts
from parcela.schema import AREA, PRICE


def _price() -> Column:
    return F.col(PRICE).cast("double")


def avg_price_by_city(clean: DataFrame) -> DataFrame:
    """A7 + L1: mean price per m2 by city, highest first (null cities dropped)."""
    return (clean.filter(F.col("city_province").isNotNull())
                 .groupBy("city_province")
                 .agg(F.avg(_price()).alias("avg_price_per_m2"),
                      F.count(F.lit(1)).alias("listings"))
                 .orderBy(F.desc("avg_price_per_m2"), "city_province"))


def top_cities_by_price(clean: DataFrame, n: int = 10) -> DataFrame:
    """L2: the ``n`` cities with the highest mean price per m2."""
    return avg_price_by_city(clean).limit(n)


def price_overview(clean: DataFrame, approximate: bool = False) -> DataFrame:
    """A1 + A2: mean, max, min and exact (interpolating) median price per m2."""
    x = _price()
    if approximate:
        median = scalar_row(quantile_row(clean, x, {"m": 0.5}, approximate))["m"]
        return clean.agg(F.avg(x).alias("avg_price"), F.max(x).alias("max_price"),
                         F.min(x).alias("min_price"), F.count(x).alias("listings")).withColumn("median_price", median)
    prices = value_counts(clean, x)
    x, n = F.col("x"), F.col("n")
    median = scalar_row(quantile_row(prices, x, {"m": 0.5}, weight=n))["m"]
    listings = F.coalesce(F.sum(F.when(x.isNotNull(), n)), F.lit(0).cast("bigint"))
    return prices.agg(counted_mean(x, n).alias("avg_price"), F.max(x).alias("max_price"),
                      F.min(x).alias("min_price"), listings.alias("listings")).withColumn("median_price", median)


def price_quartiles(clean: DataFrame, approximate: bool = False) -> DataFrame:
    """A3: exact 25 % and 75 % quantiles (the default price-range bounds)."""
    return quantile_row(clean, _price(), {"q25": 0.25, "q75": 0.75}, approximate)


def _range_bounds(rows: DataFrame, low: float | None, high: float | None, price: Column, weight: Column | None = None):
    if low is not None and high is not None:
        return F.lit(float(low)), F.lit(float(high))
    q = scalar_row(quantile_row(rows, price, {"q25": 0.25, "q75": 0.75}, weight=weight))
    lo = F.lit(float(low)) if low is not None else q["q25"]
    hi = F.lit(float(high)) if high is not None else q["q75"]
    return lo, hi


def in_price_range(clean: DataFrame, low: float | None = None,
                   high: float | None = None) -> DataFrame:
    """listings with ``low <= price <= high``; bounds default to the quartiles."""
    lo, hi = _range_bounds(clean, low, high, _price())
    return clean.filter(_price().between(lo, hi))


def price_range_share(clean: DataFrame, low: float | None = None,
                      high: float | None = None) -> DataFrame:
    """F5 + A8: count and truncated percentage of listings in the range, with the
    mean price and mean area of those listings, in one pass: (price, area) pairs are
    counted, and bounds and means come from the counts."""
    counted = value_counts(clean, _price(), F.col(AREA).cast("double"))
    x, n, area = F.col("x"), F.col("n"), F.col("m0")
    lo, hi = _range_bounds(counted, low, high, x, n)
    inside = x.between(lo, hi)
    total = F.coalesce(F.sum(n), F.lit(0).cast("bigint"))
    hits = F.coalesce(F.sum(F.when(inside, n)), F.lit(0).cast("bigint"))
    return counted.agg(
        lo.alias("range_low"), hi.alias("range_high"),
        hits.alias("in_range"), total.alias("total"),
        F.when(total > 0, F.floor(F.lit(100) * hits / total)).otherwise(F.lit(0))
         .cast("bigint").alias("pct"),
        counted_mean(F.when(inside, x), n).alias("avg_price"),
        counted_mean(F.when(inside, area), n).alias("avg_area"))


def price_range_listings(clean: DataFrame, low: float | None = None,
                         high: float | None = None, n: int = 10) -> DataFrame:
    """L3: the first ``n`` listings in the price range, by listing id."""
    return (in_price_range(clean, low, high)
            .select("listing_id", "city_province", "district",
                    F.col(AREA).cast("double").alias("area_m2"),
                    _price().alias(PRICE), "category")
            .orderBy("listing_id").limit(n))


def distinct_places(clean: DataFrame, approximate: bool = False) -> DataFrame:
    """A5: number of distinct cities and districts (nulls not counted)."""
    cd = F.approx_count_distinct if approximate else F.count_distinct
    return clean.agg(cd("city_province").alias("cities"), cd("district").alias("districts"))


def most_common(clean: DataFrame, col: str) -> DataFrame:
    """The most frequent non-null value (ties: smallest value) and its count."""
    return (clean.filter(F.col(col).isNotNull()).groupBy(col)
                 .agg(F.count(F.lit(1)).alias("listings"))
                 .orderBy(F.desc("listings"), col).limit(1))


def avg_price_by_district(clean: DataFrame, city: str | None = None) -> DataFrame:
    """A7 + F6: mean price per district (within ``city`` if given), highest first."""
    df = clean if city is None else clean.filter(F.col("city_province") == F.lit(city))
    # Groups without a place are dropped by a count: a filter on the places would be
    # pushed down to the rows, with copies of the address parse.
    placed = F.count_if(F.col("district").isNotNull() & F.col("city_province").isNotNull())
    return (df.groupBy("city_province", "district")
              .agg(F.avg(_price()).alias("avg_price_per_m2"), placed.alias("listings"))
              .where("listings > 0")
              .orderBy("city_province", F.desc("avg_price_per_m2"), "district"))


def districts_in_city(clean: DataFrame, city: str | None = None) -> DataFrame:
    """L4 + F6: sorted distinct districts of each city (or of one city)."""
    df = clean.filter(F.col("district").isNotNull() & F.col("city_province").isNotNull())
    if city is not None:
        df = df.filter(F.col("city_province") == F.lit(city))
    return df.select("city_province", "district").distinct().orderBy("city_province", "district")


OPTION_FIELDS = ["city_province", "category", "direction", "liability"]


def sorted_options(clean: DataFrame, fields: list[str] = OPTION_FIELDS) -> DataFrame:
    """L4: sorted distinct values of each selectable field, as (field, value)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))
                      for f in fields])
    return (clean.select(F.inline(pairs)).filter(F.col("value").isNotNull())
                 .distinct().orderBy("field", "value"))
