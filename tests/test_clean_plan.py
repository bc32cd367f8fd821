"""The cleaning plan: one parse of the price a row, and methods that HotSpot compiles."""

from pyspark.sql import functions as F

from parcela.operators.clean import clean
from parcela.schema import PRICE
from parcela.sources.fixtures import raw_listings


def test_price_is_parsed_once_a_row(spark, sf_dir):
    plan = clean(raw_listings(spark, sf_dir)).groupBy("district").agg(F.avg(PRICE))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("/m2$") == 1


def test_sessions_of_others_compile_the_cleaning(spark, sf_dir):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "65535")
        clean(raw_listings(spark, sf_dir))
        assert int(spark.conf.get(key)) <= 8000
    finally:
        spark.conf.set(key, before)


def test_repeated_and_unreadable_prices(spark):
    names = ["listing_id", "price", "area", "category", "direction", "liability", "location", "street", "floor_num", "toilet_num", "livingroom_num", "bedroom_num"]
    row = lambda i, price: (i, price, "80 m2", *[None] * 9)
    raw = spark.createDataFrame([row(1, "~2,5 triệu/m2"), row(1, "~2,5 triệu/m2"), row(2, "Thương lượng"), row(3, None)],
                                "listing_id bigint, " + ", ".join(f"{n} string" for n in names[1:]))
    assert [(r.listing_id, r[PRICE]) for r in clean(raw).collect()] == [(1, 2500000.0), (1, 2500000.0)]


def test_districts_parse_the_address_without_pushed_copies(spark, sf_dir):
    from parcela.operators.market import avg_price_by_district
    rows = clean(raw_listings(spark, sf_dir))
    plan = avg_price_by_district(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Lưu tin\\s*$") == 1


def test_district_means_leave_out_missing_places(spark):
    from parcela.operators.market import avg_price_by_district
    rows = spark.createDataFrame([("A", "x", 2.0), ("A", "x", None), ("A", None, 5.0), (None, "x", 7.0), ("B", "", 1.0)],
                                 f"city_province string, district string, {PRICE} double")
    assert [tuple(r) for r in avg_price_by_district(rows).collect()] == [("A", "x", 2.0, 2), ("B", "", 1.0, 1)]
    assert [tuple(r) for r in avg_price_by_district(rows, "B").collect()] == [("B", "", 1.0, 1)]
