"""Positions over range partitions."""

from pyspark.sql import functions as F

from parcela.operators.numbering import numbered


def test_positions_follow_the_order(spark):
    df = spark.range(0, 2000, numPartitions=7).select(F.pmod(F.xxhash64("id"), F.lit(97)).alias("k"), "id", F.lit("x").alias("a b"))
    got = numbered(df.repartition(5), [F.desc("k"), F.asc("id")], "rank").collect()
    want = sorted(((r.k, r.id) for r in df.collect()), key=lambda x: (-x[0], x[1]))
    assert [(r.k, r.id) for r in sorted(got, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got) == list(range(2000))
    assert got[0].asDict().keys() == {"k", "id", "a b", "rank"}


def test_equal_rows_nulls_and_none(spark):
    df = spark.createDataFrame([(None,)] * 3 + [(5,)] * 4 + [(2,)], "v int")
    got = sorted((r.position, r.v) for r in numbered(df, [F.col("v").asc_nulls_last()]).collect())
    assert got == [(0, 2), (1, 5), (2, 5), (3, 5), (4, 5), (5, None), (6, None), (7, None)]
    assert numbered(df.limit(0), [F.col("v")]).count() == 0
