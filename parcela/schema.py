"""Declared schemas and fixed values for every stage of the listings pipeline.

One ``StructType`` per stage replaces header inference: raw listings are
all text, clean listings carry the typed columns the cleaning job emits.
"""

from __future__ import annotations

from pyspark.sql.types import (
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

# ---------------------------------------------------------------------------
# Fixed values. These must equal the source data's own markers and unit words
# for parsing to give the right results; they are kept here verbatim, in the
# order they appear in a listing, in Unicode NFC form.
# ---------------------------------------------------------------------------
UNIT_MILLION = "triệu"            # price unit: million VND
UNIT_THOUSAND = "nghìn"           # price unit: thousand VND
SAVED_MARKER = "Lưu tin"          # "save listing" button text glued to addresses
FLOOR_WORD = "tầng"               # "floors" suffix
ROOM_WORD = "phòng"               # "rooms" suffix
UNKNOWN_TEXT = "Không xác định"   # "unknown" label for missing text
UNKNOWN_NUMBER = -1               # sentinel for missing numbers
GOOD_DIRECTIONS = ("Đông", "Nam", "Đông Nam")  # east, south, south-east

# Trim range for price per m2 (VND) applied before modelling.
PRICE_TRIM_LOW = 2e6
PRICE_TRIM_HIGH = 1e8

# Column groups.
COUNT_COLUMNS = ["floor_num", "toilet_num", "livingroom_num", "bedroom_num"]
IMPUTE_COLUMNS = ["bedroom_num", "toilet_num", "floor_num", "livingroom_num"]
NUMERIC_FEATURES = ["area (m2)", "floor_num", "toilet_num", "livingroom_num",
                    "bedroom_num", "street (m)"]
CATEGORICAL_FEATURES = ["category", "direction", "liability", "district",
                        "city_province"]
FLAG_COLUMNS = [f"{c}_missing_flag" for c in IMPUTE_COLUMNS]

AREA = "area (m2)"
STREET = "street (m)"
PRICE = "price_per_m2"

RAW = StructType([
    StructField("listing_id", LongType()),
    StructField("title", StringType()),
    StructField("link", StringType()),
    StructField("price", StringType()),
    StructField("area", StringType()),
    StructField("category", StringType()),
    StructField("direction", StringType()),
    StructField("liability", StringType()),
    StructField("location", StringType()),
    StructField("street", StringType()),
    StructField("floor_num", StringType()),
    StructField("toilet_num", StringType()),
    StructField("livingroom_num", StringType()),
    StructField("bedroom_num", StringType()),
])

CLEAN = StructType([
    StructField("listing_id", LongType()),
    StructField(PRICE, FloatType()),
    StructField(AREA, FloatType()),
    StructField("category", StringType()),
    StructField("direction", StringType()),
    StructField("liability", StringType()),
    StructField("floor_num", IntegerType()),
    StructField("toilet_num", IntegerType()),
    StructField("livingroom_num", IntegerType()),
    StructField("bedroom_num", IntegerType()),
    StructField("district", StringType()),
    StructField("city_province", StringType()),
    StructField(STREET, FloatType()),
])
