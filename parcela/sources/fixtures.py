"""Raw listings derived from the driver's TPC-H-style tables.

The reference ships no data, so scraped-listing text is derived row by row
from ``lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ part`` by a fixed rule
(FIXTURES.md §3): every raw column is text, with the same shapes, units,
markers and gaps that the cleaning rules have to handle.

Join plan: all joins are equi-joins left to the planner, so AQE picks
broadcast or shuffle from sizes in bytes.  The projections are pushed into
each parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _s(c: Column) -> Column:
    return c.cast("string")


def derive_raw(lineitem: DataFrame, orders: DataFrame, customer: DataFrame,
               nation: DataFrame, part: DataFrame) -> DataFrame:
    """Join the five tables and spell each listing field as scraped text."""
    li = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                         "l_quantity", "l_extendedprice", "l_returnflag")
    o = orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    c = customer.select("c_custkey", "c_nationkey")
    n = nation.select("n_nationkey", "n_name")
    p = part.select("p_partkey", "p_name", "p_type")

    placed = c.join(n, c.c_nationkey == n.n_nationkey)
    orders_placed = o.join(placed, o.o_custkey == placed.c_custkey)
    rows = (li.join(orders_placed, li.l_orderkey == orders_placed.o_orderkey)
              .join(p, li.l_partkey == p.p_partkey))

    rid = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    u = F.floor(F.col("l_extendedprice") / 100).cast("bigint")
    q = F.col("l_quantity").cast("bigint")
    base = rows.select(
        rid.alias("_id"), u.alias("_u"), q.alias("_q"),
        "l_partkey", "l_suppkey", "l_returnflag", "o_orderpriority",
        "c_custkey", "n_name", "p_name", "p_type")

    i = F.col("_id")
    uu = F.col("_u")
    area_num = _s(F.lit(20) + F.lit(3) * F.col("_q"))
    address = F.concat(F.lit("Street "), _s(F.col("l_suppkey")), F.lit(", "),
                       F.col("n_name"), F.lit(" D"), _s(F.col("c_custkey") % 5),
                       F.lit(", "), F.col("n_name"))
    return base.select(
        ((i * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("listing_id"),
        F.col("p_name").alias("title"),
        F.concat(F.lit("https://example.invalid/"), _s(i)).alias("link"),
        F.when(i % 20 == 0, F.lit(None).cast("string"))
         .when(i % 20 == 1, F.lit("Thương lượng"))
         .when(i % 20 == 2, F.lit("1,5 tỷ/m2"))
         .when(i % 20 == 3, F.concat(F.lit("~"), _s(uu), F.lit(" nghìn/m2")))
         .when(i % 20 == 4, F.concat(F.lit("12,345,"), _s(F.lit(100) + uu % 900)))
         .otherwise(F.concat(F.lit("~"), _s(F.lit(1) + uu % 130), F.lit(","), _s(uu % 10),
                             F.lit(" triệu/m2"))).alias("price"),
        F.when(i % 23 == 0, F.lit(None).cast("string"))
         .when(i % 29 == 0, F.concat(area_num, F.lit(",5 m2")))
         .otherwise(F.concat(area_num, F.lit(" m2"))).alias("area"),
        F.when(i % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("p_type")).alias("category"),
        F.when(i % 3 == 0, F.lit(None).cast("string"))
         .when(F.col("l_returnflag") == "A", F.lit("Đông"))
         .when(F.col("l_returnflag") == "N", F.lit("Nam"))
         .otherwise(F.lit("Tây Bắc")).alias("direction"),
        F.when(i % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")).alias("liability"),
        F.when(i % 31 == 0, F.lit(None).cast("string"))
         .when(i % 37 == 0, F.col("n_name"))
         .when(i % 2 == 0, F.concat(address, F.lit("  Lưu tin ")))
         .otherwise(address).alias("location"),
        F.when(i % 4 == 0, F.lit(None).cast("string"))
         .when(i % 41 == 0, F.lit("abc"))
         .when(i % 7 == 0, F.concat(_s(i % 9), F.lit("m - "), _s(i % 9 + 4), F.lit("m")))
         .otherwise(F.concat(_s(F.lit(3) + i % 17), F.lit("m"))).alias("street"),
        F.when(i % 6 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(_s(F.lit(1) + i % 5), F.lit(" tầng"))).alias("floor_num"),
        F.when(i % 7 == 0, F.lit(None).cast("string")).otherwise(_s(F.lit(1) + i % 4)).alias("toilet_num"),
        F.when(i % 8 == 0, F.lit(None).cast("string")).otherwise(_s(F.lit(1) + i % 3)).alias("livingroom_num"),
        F.when(i % 9 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(_s(F.lit(1) + i % 6), F.lit(" phòng"))).alias("bedroom_num"),
    )


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw (all-text) listings for one scale-factor folder of driver tables."""
    t = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
         for name in ("lineitem", "orders", "customer", "nation", "part")}
    return derive_raw(t["lineitem"], t["orders"], t["customer"], t["nation"], t["part"])
