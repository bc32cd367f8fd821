"""Medians, sentinel counts and box-plot figures come from one pass over the rows."""

import pytest
from pyspark.sql import functions as F

from parcela.operators import estimate, impute, market, profile
from parcela.schema import AREA, IMPUTE_COLUMNS, PRICE


def _scans(df) -> int:
    """Exchanges that read the source and are no reuse of another, in the plan as it ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("FileScan parquet")


def _rows_read(spark, t, query) -> float:
    """Times that ``query`` evaluates the price of a row of ``t``, its subqueries included, a row."""
    seen = spark.sparkContext.accumulator(0)

    def price(x):
        seen.add(1)
        return x

    query(t.withColumn(PRICE, F.udf(price, "float")(PRICE))).collect()
    return seen.value / t.count()


def _table(spark, scratch):
    rows = [(1.0 * p, *c) for p, c in zip([3e6, 3e6, 5e6, 9e8], [(1, -1, None, 2), (1, 4, -1, 2), (3, 5, None, -1), (1, -1, None, -1)])]
    path = f"{scratch}/t"
    spark.createDataFrame(rows, f"{PRICE} double, " + ", ".join(f"{c} int" for c in IMPUTE_COLUMNS)).write.parquet(path)
    return spark.read.parquet(path)


def test_sentinel_medians_scan_once(spark, scratch):
    t = _table(spark, scratch)
    out = impute.sentinel_medians(t)
    r, (a, b, c, d) = out.first(), IMPUTE_COLUMNS
    assert (r[f"{a}__median"], r[f"{b}__median"], r[f"{c}__median"], r[f"{d}__median"]) == (1.0, 4.5, None, 2.0)
    assert [r[f"{x}__sentinels"] for x in (a, b, c, d)] == [0, 2, 1, 2]
    assert [r[f"{x}__nulls"] for x in (a, b, c, d)] == [0, 0, 3, 0]
    empty = impute.sentinel_medians(t.where(F.lit(False))).first()
    assert empty[f"{a}__sentinels"] == 0 and empty[f"{a}__median"] is None
    assert _scans(out) == 1


def test_box_plot_scans_once(spark, scratch):
    out = profile.price_boxplot(_table(spark, scratch))
    got = {r.stage: (r.q1, r["median"], r.q3, r.n, r.outliers) for r in out.collect()}
    assert got == {"before_trim": (3e6, 4e6, 228.75e6, 4, 1), "after_trim": (3e6, 3e6, 4e6, 3, 0)}
    assert _scans(out) == 1


def _priced(spark, scratch):
    rows = [(k, p, a, "c", "d", "x") for k, (p, a) in enumerate([(3e6, 10.0), (3e6, None), (5e6, 20.0), (9e8, 7.0), (None, 5.0), (4e6, 10.0)])]
    path = f"{scratch}/p"
    spark.createDataFrame(rows, f"listing_id long, {PRICE} float, `{AREA}` float, city_province string, district string, category string").write.parquet(path)
    return spark.read.parquet(path)


def test_price_figures_scan_once(spark, scratch):
    t = _priced(spark, scratch)
    summary, overview, share = profile.price_summary(t), market.price_overview(t), market.price_range_share(t)
    x = F.col(PRICE).cast("double")
    want = t.agg(F.count(x), F.avg(x), F.stddev_samp(x), F.min(x), F.max(x), F.percentile(x, 0.25), F.percentile(x, 0.5), F.percentile(x, 0.75)).first()
    got = summary.first()
    assert summary.columns == ["count", "mean", "stddev", "min", "max", "p25", "p50", "p75"] and tuple(got) == pytest.approx(tuple(want))
    assert overview.first().asDict() == pytest.approx({"avg_price": want[1], "max_price": 9e8, "min_price": 3e6, "listings": 5, "median_price": 4e6})
    assert share.first().asDict() == pytest.approx({"range_low": 3e6, "range_high": 5e6, "in_range": 4, "total": 6, "pct": 66, "avg_price": 3.75e6, "avg_area": 40 / 3})
    assert [r.listing_id for r in market.price_range_listings(t).collect()] == [0, 1, 2, 5]
    assert [_rows_read(spark, t, q) for q in (profile.price_summary, market.price_overview, market.price_range_share)] == [1, 1, 1]


def test_price_figures_without_rows(spark, scratch):
    none = _priced(spark, scratch).where(F.lit(False))
    assert profile.price_summary(none).first().asDict() == {"count": 0, **dict.fromkeys(["mean", "stddev", "min", "max", "p25", "p50", "p75"])}
    assert market.price_overview(none).first().listings == 0
    r = market.price_range_share(none).first()
    assert (r.in_range, r.total, r.pct, r.avg_price) == (0, 0, 0, None)


def test_quantiles_scan_once(spark, scratch):
    out = market.price_quartiles(_priced(spark, scratch))
    assert tuple(out.first()) == (3e6, 5e6) and _scans(out) == 1


def test_estimates_read_listings_once(spark, scratch):
    t = _priced(spark, scratch).withColumns({"direction": F.lit("x"), "bedroom_num": F.lit(1), "floor_num": F.lit(1)})
    asked = t.drop(PRICE).withColumnRenamed("listing_id", "request_id")
    assert _rows_read(spark, t, lambda x: estimate.statistical_estimate(asked, x)) == 1
    assert _rows_read(spark, t, lambda x: estimate.comparables(asked, x, k=2, exclude_self=True)) <= 1
