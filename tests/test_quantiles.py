"""Exact distributed quantiles against the built-in aggregate."""

import pytest
from pyspark.sql import functions as F

from parcela.operators.quantiles import exact_quantiles, quantile_row


def test_matches_percentile_by_group(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 50 != 0, (F.hash("id") % 1000) / 7.0).alias("x"))
    df = df.unionAll(df.select("g", F.lit(1e300))).unionAll(df.select(F.lit(None), F.lit(-2.5))).unionAll(df.select(F.lit(9), F.lit(None).cast("double")))
    probs = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    got = {(r.g, r.p): r.q for r in exact_quantiles(df, F.col("x"), probs, ["g"]).collect()}
    want = {(r.g, p): q for r in df.groupBy("g").agg(F.percentile("x", F.array(*[F.lit(p) for p in probs])).alias("q")).collect()
            if r.q for p, q in zip(probs, r.q)}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_rows(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (float("nan"),), (None,), (2.0,), (10.0,)], "x double")
    assert quantile_row(df, F.col("x"), {"a": 0.5, "b": 0.25}).first().asDict() == {"a": 2.5, "b": 1.75}
    assert quantile_row(df.limit(0), F.col("x"), {"a": 0.5}).first().a is None
    assert quantile_row(df.where("x < 5"), F.col("x"), {"a": 0.5}, approximate=True).first().a == 2.0
