"""Rule tables for the cleaning rules (X20-X25), including the source's quirks."""

import math

import pytest
from pyspark.sql import functions as F

from parcela.functions import rules
from parcela.schema import UNKNOWN_TEXT


def _apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()
    return [r.out for r in rows]


PRICE_CASES = [
    ("~45,5 triệu/m2", 45.5e6),
    ("~850 nghìn/m2", 850e3),
    ("12,345,678", 12345678.0),
    ("Thương lượng", None),            # negotiable -> dropped later
    ("1,5 tỷ/m2", None),               # billions are lost (quirk Q1)
    ("1 tỷ 500 triệu", 1500e6),        # digits concatenate (quirk Q2)
    ("1.200 triệu/m2", 1200e6),        # dots deleted inside million values
    ("~~5 triệu / m2", 52e6),          # '/ m2' is not stripped, its 2 is kept
    ("", None),
    (None, None),
]


def test_price_rule(spark):
    got = _apply(spark, [v for v, _ in PRICE_CASES], rules.parse_price)
    for (text, want), g in zip(PRICE_CASES, got):
        if want is None:
            assert g is None, text
        else:
            assert g == pytest.approx(want, rel=1e-7), text


def test_area_rule(spark):
    got = _apply(spark, ["80 m2", "80,5 m2", "1.200 m2", "m2", "", None], rules.parse_area)
    assert got[0] == 80.0
    assert got[1] is None
    assert got[2] == pytest.approx(1.2)
    assert got[3:] == [None, None, None]


def test_count_rules(spark):
    assert _apply(spark, ["abc", "3.0", " 3 ", "-1", "2", "+4", "1e3", ""], rules.to_int) == \
        [None, 3, 3, -1, 2, 4, None, None]
    assert _apply(spark, ["3 tầng", "3tầng", "-1", "abc tầng"], rules.parse_floors) == [3, 3, -1, None]
    assert _apply(spark, ["2 phòng", "-1"], rules.parse_rooms) == [2, -1]


def test_fill_rules(spark):
    assert _apply(spark, [None, "x"], rules.fill_count) == ["-1", "x"]
    assert _apply(spark, [None, "x"], rules.fill_text) == [UNKNOWN_TEXT, "x"]


def test_address_rule(spark):
    values = [None, "", "A", "A, B", "A,B,C,D Lưu tin", "Street 1, N D1, N  Lưu tin "]
    city = _apply(spark, values, lambda c: rules.city_of(rules.fill_text(c)))
    district = _apply(spark, values, lambda c: rules.district_of(rules.fill_text(c)))
    assert city == [UNKNOWN_TEXT, "", "A", "B", "D", "N"]
    assert district == [None, None, None, "A", "C", "N D1"]


def test_street_rule(spark):
    values = [None, "-", "3-", "3 - 5 - 9", "m", "8m", "5m - 7m", "abc"]
    got = _apply(spark, values, rules.parse_street)
    assert got == [-1.0, -1.0, -1.0, 4.0, -1.0, 8.0, 6.0, -1.0]


def test_clean_schema_and_sentinels(clean_small):
    from parcela.schema import CLEAN
    assert [(f.name, f.dataType) for f in clean_small.schema.fields] == \
        [(f.name, f.dataType) for f in CLEAN.fields]
    row = clean_small.agg(F.count_if(F.col("price_per_m2").isNull()).alias("np"),
                          F.min("street (m)").alias("smin")).first()
    assert row.np == 0
    assert row.smin == -1.0 and not math.isnan(row.smin)
