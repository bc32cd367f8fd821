"""Market-statistics valuation and comparable listings.

``statistical_estimate`` values any number of requests at once.  The mean
price of every (category, district), category and district comes from ONE
``cube`` aggregate; each request is mapped to the single lookup key its given
fields select, so one equi-join replaces a cascade of joins.  The lookup
table has one row per group; AQE broadcasts it when its measured size is
small, and otherwise runs a shuffle join whose skewed partitions it splits.

``comparables`` finds, for each request, the first k listings (by listing
id) in the same city and district with ``0.7 a < area < 1.3 a``.  Areas lie
on a fine logarithmic grid, and every listing stands in its grid cell and in
the cells of twice, four times, ... that size, up to the request's span.
Only a cell's first ids can be chosen, so these are kept (a group-limited
window, computed partially before the shuffle).  A request's range is a few
dozen whole cells plus the two finest cells at its ends, where areas are
compared one by one.  All joins are on city, district and cell, so a
district with very many listings spreads over its cells, and work grows with
listings and requests, not with their product.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcela.schema import AREA, GOOD_DIRECTIONS, PRICE

ALL = "*"


def _given(c: Column) -> Column:
    """A field is a filter unless it is missing or empty; blanks are a value that nothing matches."""
    return c.isNotNull() & (c.cast("string") != "")


def _key(value: Column, given: Column) -> Column:
    return F.when(given, F.concat(F.lit("="), value)).otherwise(F.lit(ALL))


def group_means(listings: DataFrame) -> DataFrame:
    """J2 lookup: mean price for (category, district), category, district and all.

    Keys: ``=value`` for a grouped level, ``*`` for a rolled-up level.
    """
    # Sums by category and district first: only these are rolled up, not the rows.
    price = F.col(PRICE).cast("double")
    sums = (listings.groupBy("category", "district")
                    .agg(F.sum(price).alias("_s"), F.count(price).alias("_n"), F.count(F.lit(1)).alias("_rows")))
    g = (sums.cube("category", "district")
             .agg(F.try_divide(F.sum("_s"), F.sum("_n")).alias("group_avg"),
                  F.sum("_rows").alias("group_rows"),
                  F.grouping("category").alias("_gc"), F.grouping("district").alias("_gd")))
    return g.select(
        F.when(F.col("_gc") == 1, F.lit(ALL)).otherwise(F.concat(F.lit("="), "category")).alias("_kc"),
        F.when(F.col("_gd") == 1, F.lit(ALL)).otherwise(F.concat(F.lit("="), "district")).alias("_kd"),
        "group_avg", "group_rows")


def adjustment_factor(req: DataFrame) -> Column:
    """K17 factors: bedrooms (>=3: 1.1, exactly 1: 0.9), good direction 1.05,
    area (<50: 1.1, >100: 0.95)."""
    bed = F.col("bedroom_num").cast("int")
    area = F.col(AREA).cast("double")
    f_bed = F.when(bed >= 3, 1.1).when((bed <= 1) & (bed > 0), 0.9).otherwise(1.0)
    f_dir = F.when(F.col("direction").isin(*GOOD_DIRECTIONS), 1.05).otherwise(1.0)
    f_area = F.when((area < 50) & (area > 0), 1.1).when(area > 100, 0.95).otherwise(1.0)
    return f_bed * f_dir * f_area


def statistical_estimate(requests: DataFrame, listings: DataFrame,
                         id_col: str = "request_id", carry: Sequence[str] = ()) -> DataFrame:
    """K17 for a whole table of requests.

    Mean of the listings matching the given category AND district (a blank
    field is not a filter); if none match, the whole table's mean (never a
    coarser group).  Area <= 0 or missing, or no listings, gives 0.
    Returns the per-m2 estimate and the total (per m2 x area) separately, and
    the request columns named in ``carry``.
    """
    means = group_means(listings)
    overall = means.where((F.col("_kc") == ALL) & (F.col("_kd") == ALL)).agg(F.max("group_avg")).scalar()
    cg, dg = _given(F.col("category")), _given(F.col("district"))
    req = requests.select(
        id_col, *carry, "category", "district", "direction", "bedroom_num", AREA,
        _key(F.col("category"), cg).alias("_kc"), _key(F.col("district"), dg).alias("_kd"),
        F.when(cg & dg, "category_district").when(cg, "category").when(dg, "district")
         .otherwise("all").alias("_level"))
    joined = req.join(means, ["_kc", "_kd"], "left")
    area = F.col(AREA).cast("double")
    base = F.coalesce(F.col("group_avg"), overall)
    valid = area.isNotNull() & (area > 0) & base.isNotNull()
    per_m2 = base * adjustment_factor(joined)
    return joined.select(
        id_col, *carry,
        F.when(F.col("group_avg").isNotNull(), F.col("_level")).otherwise("all").alias("mean_source"),
        base.alias("mean_price"),
        F.when(valid, per_m2).otherwise(F.lit(0.0)).alias("price_per_m2_est"),
        F.when(valid, per_m2 * area).otherwise(F.lit(0.0)).alias("total_est"))


#: Finest grid cells in the span of a request's range, as a power of two.
GRID_BITS = 13


def _cell(area: Column, low: float, high: float) -> Column:
    """Number of an area's finest grid cell; a larger area has no smaller number."""
    return F.floor(F.log(area) * F.lit((1 << GRID_BITS) / math.log(high / low))).cast("bigint")


def _whole_cells(first: Column, end: Column) -> Column:
    """The fewest cells (level, cell) that make up the finest cells ``first`` to before ``end``.

    From the finest level up, an end that is not shared with its neighbour is taken
    on its own; the rest is halved.
    """
    def step(s: Column, level: Column) -> Column:
        going = s["a"] < s["z"]
        left, right = going & (F.pmod(s["a"], F.lit(2)) == 1), going & (F.pmod(s["z"], F.lit(2)) == 1)
        a = F.when(left, s["a"] + 1).otherwise(s["a"])
        z = F.when(right, s["z"] - 1).otherwise(s["z"])
        cell = lambda number: F.struct(level.alias("level"), number.alias("cell"))
        # An odd left end that is also the only cell is taken once.
        found = F.concat(s["cells"], F.when(left, F.array(cell(s["a"]))).otherwise(F.slice(F.array(cell(s["a"])), 1, 0)),
                         F.when(right & (z >= a), F.array(cell(z))).otherwise(F.slice(F.array(cell(z)), 1, 0)))
        return F.struct(F.floor(a / 2).cast("bigint").alias("a"), F.floor(z / 2).cast("bigint").alias("z"), found.alias("cells"))

    none = F.array().cast("array<struct<level:int,cell:bigint>>")
    start = F.struct(first.alias("a"), end.alias("z"), none.alias("cells"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(GRID_BITS)), start, step, lambda s: s["cells"])


def comparables(requests: DataFrame, listings: DataFrame, k: int = 5,
                id_col: str = "request_id", exclude_self: bool = False,
                low: float = 0.7, high: float = 1.3) -> DataFrame:
    """Up to ``k`` comparable listings per request, ranked by listing id.

    ``exclude_self`` drops listings whose id equals the request id (when the
    requests are listings themselves).  Requests that repeat an id are ranked
    apart if city, district or area differ, and answered once if not; listings
    that repeat an id are ranked by area and price.
    """
    keep = k + 1 if exclude_self else k
    place = ["city_province", "district"]
    details = ["listing_id", "area_m2", PRICE, "bedroom_num", "floor_num", "category"]
    cand = (listings.select("listing_id", *place, F.col(AREA).cast("double").alias("area_m2"),
                            F.col(PRICE).cast("double").alias(PRICE), "bedroom_num", "floor_num", "category")
            .where("area_m2 > 0 AND city_province IS NOT NULL AND district IS NOT NULL")
            .withColumn("_fine", _cell(F.col("area_m2"), low, high)))

    def first_ids(df: DataFrame, by: list[str]) -> DataFrame:
        # dense_rank: rows of one id stand or fall together
        w = Window.partitionBy(*by).orderBy("listing_id")
        return df.withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= keep).drop("_r")

    few = first_ids(cand, [*place, "area_m2"])
    # Level -1 keeps the first ids of every area, for the ends of ranges; one table, so that one pass makes all.
    levels = F.explode(F.sequence(F.lit(-1), F.lit(GRID_BITS)))
    cells = few.withColumn("level", levels).withColumns({
        "cell": F.expr("shiftright(_fine, greatest(level, 0))"), "_own": F.when(F.col("level") < 0, F.col("area_m2"))})
    cells = first_ids(cells.drop("_fine"), [*place, "level", "cell", "_own"]).drop("_own")

    # One distinct pass over the requests for their ranges and for the answers.
    req = (requests.select(F.col(id_col).alias("_rid"), F.col("city_province").alias("_rc"),
                           F.col("district").alias("_rd"), F.col(AREA).cast("double").alias("_ra"))
           .where("_ra > 0 AND _rc IS NOT NULL AND _rd IS NOT NULL").distinct())
    key = ["_rc", "_rd", "_ra"]
    # The count keeps the two distinct steps apart, so that the first is the requests' own and shared.
    keys = (req.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0").drop("_n")
            .withColumn("_a", _cell(F.col("_ra") * F.lit(low), low, high)).withColumn("_z", _cell(F.col("_ra") * F.lit(high), low, high)))
    ends = F.transform(F.array_distinct(F.array("_a", "_z")), lambda c: F.struct(F.lit(-1).alias("level"), c.alias("cell")))
    asked = keys.select(*key, F.inline(F.concat(_whole_cells(F.col("_a") + 1, F.col("_z")), ends)))
    found = asked.join(cells.withColumnsRenamed({"city_province": "_rc", "district": "_rd"}), ["_rc", "_rd", "level", "cell"])
    inside = (F.col("area_m2") > F.col("_ra") * F.lit(low)) & (F.col("area_m2") < F.col("_ra") * F.lit(high))
    per_key = first_ids(found.where((F.col("level") >= 0) | inside).select(*key, *details), key)

    # The answers of a range as one short list; a request cuts its own from it, without a shuffle.
    # Of the rows of one id no more than k can be chosen.
    one_id = Window.partitionBy(*key, "listing_id").orderBy("area_m2", PRICE)
    lists = (per_key.withColumn("_r", F.row_number().over(one_id)).where(F.col("_r") <= k)
             .groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*details))).alias("_found")))
    found = F.col("_found")
    if exclude_self:
        found = F.filter(found, lambda x: x["listing_id"] != F.col("_rid"))
    chosen = req.join(lists, key).select(F.col("_rid").alias(id_col), F.posexplode(F.slice(found, 1, k)).alias("_at", "_row"))
    return chosen.select(id_col, (F.col("_at") + 1).alias("rank"), "_row.*")
