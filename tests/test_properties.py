"""Properties of imputation, trimming, grouping and partition independence."""

import pytest
from pyspark.sql import functions as F

from parcela.operators import evaluate, impute, market, profile
from parcela.schema import IMPUTE_COLUMNS, PRICE


def test_flags_and_fill(clean_small):
    before = clean_small.agg(*[F.count_if(F.col(c) == -1).alias(c) for c in IMPUTE_COLUMNS]).first()
    filled = impute.flag_and_fill(clean_small)
    after = filled.agg(*[F.count_if(F.col(c) == -1).alias(c) for c in IMPUTE_COLUMNS],
                       *[F.sum(f"{c}_missing_flag").alias(f"{c}_f") for c in IMPUTE_COLUMNS]).first()
    for c in IMPUTE_COLUMNS:
        assert after[c] == 0                      # no sentinel survives
        assert after[f"{c}_f"] == before[c]       # flag sum = sentinel count
    # A second fill changes nothing (no sentinel left; flags all 0).
    again = impute.flag_and_fill(filled.select(*clean_small.columns))
    diff = again.select(*clean_small.columns).exceptAll(filled.select(*clean_small.columns))
    assert diff.count() == 0


def test_medians_ignore_sentinels(spark):
    df = spark.createDataFrame([(1,), (-1,), (3,), (-1,), (5,)], "bedroom_num int")
    m = impute.sentinel_medians(df, ["bedroom_num"]).first()
    assert m["bedroom_num__median"] == 3.0 and m["bedroom_num__sentinels"] == 2


def test_trim_is_subset(clean_small):
    trimmed = impute.trim_prices(clean_small)
    assert trimmed.exceptAll(clean_small).count() == 0
    lo, hi = trimmed.agg(F.min(PRICE), F.max(PRICE)).first()
    assert lo >= 2e6 and hi <= 1e8


def test_group_counts_add_up(clean_small):
    total = clean_small.count()
    by_city = market.avg_price_by_city(clean_small).agg(F.sum("listings")).first()[0]
    nulls = clean_small.filter(F.col("city_province").isNull()).count()
    assert by_city + nulls == total


def test_report_matches_counts(spark, sf_dir, clean_small):
    from parcela.sources.fixtures import raw_listings
    rep = profile.cleaning_report(raw_listings(spark, sf_dir))
    clean_rows = rep.filter("stage = 'clean'").select("rows").distinct().collect()
    assert [r.rows for r in clean_rows] == [clean_small.count()]


def test_result_does_not_depend_on_partitioning(clean_small):
    a = market.avg_price_by_district(clean_small).collect()
    b = market.avg_price_by_district(clean_small.repartition(7, "listing_id")).collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_metrics_identity_and_evaluator(spark):
    from pyspark.ml.evaluation import RegressionEvaluator
    rows = [(float(y), float(y) * 1.1 + (i % 3)) for i, y in enumerate(range(1, 200))]
    df = spark.createDataFrame(rows, "actual_price double, predicted_price double")
    m = evaluate.regression_metrics(df).first()
    assert m.mse == pytest.approx(m.rmse ** 2)
    for name in ("rmse", "mse", "mae", "r2"):
        ev = RegressionEvaluator(labelCol="actual_price", predictionCol="predicted_price", metricName=name)
        assert m[name] == pytest.approx(ev.evaluate(df), rel=1e-9)
