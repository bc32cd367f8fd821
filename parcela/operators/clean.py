"""Raw listings -> clean listings (one narrow, codegen'd pass; no shuffle).

Order of the rules follows the source job: drop title/link, drop rows whose
raw price or area is missing, fill count and text gaps with sentinels,
split the address, parse the price and drop rows where it is unreadable,
then parse area, floors, rooms and street width and cast.  Everything is a
single Project + Filter over the scan, so a filter on a clean column can be
pushed below it by the optimizer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcela.functions import rules
from parcela.schema import AREA, COUNT_COLUMNS, PRICE, STREET
from parcela.session import compiled_methods


def drop_unpriced(raw: DataFrame) -> DataFrame:
    """rows with a raw price and area; title and link dropped."""
    return raw.drop("title", "link").na.drop(subset=["price", "area"])


def normalized_columns() -> list:
    """Step 1: texts that several rules read (filled, markers stripped, split).

    Kept as its own projection so each is computed once per row; the
    optimizer does not inline a non-trivial column that is read repeatedly,
    and each projection becomes its own generated method (small enough to be
    JIT-compiled).
    """
    return [
        rules.normalize_price_text("price").alias("_p"),
        F.col("area"),
        *[rules.fill_text(c).alias(c) for c in ("category", "direction", "liability")],
        *[rules.fill_count(c).alias(c) for c in COUNT_COLUMNS],
        rules.address_parts(rules.fill_text("location")).alias("_loc"),
        rules.street_parts("street").alias("_street"),
    ]


def parsed_columns() -> list:
    """Step 2: the clean columns from the normalised texts."""
    return [
        rules.price_from_text("_p").alias(PRICE),
        rules.parse_area("area").alias(AREA),
        F.col("category"), F.col("direction"), F.col("liability"),
        rules.parse_floors("floor_num").alias("floor_num"),
        rules.to_int("toilet_num").alias("toilet_num"),
        rules.to_int("livingroom_num").alias("livingroom_num"),
        rules.parse_rooms("bedroom_num").alias("bedroom_num"),
        rules.district_from_parts("_loc").alias("district"),
        rules.city_from_parts("_loc").alias("city_province"),
        rules.street_from_parts("_street").alias(STREET),
    ]


CLEAN_NAMES = [PRICE, AREA, "category", "direction", "liability", "floor_num",
               "toilet_num", "livingroom_num", "bedroom_num", "district",
               "city_province", STREET]


def clean(raw: DataFrame) -> DataFrame:
    """Apply X20-X25 and return the CLEAN schema (plus ``listing_id`` if present)."""
    keep_id = ["listing_id"] if "listing_id" in raw.columns else []
    compiled_methods(raw.sparkSession)
    price, *others = parsed_columns()
    texts = drop_unpriced(raw).select(*keep_id, *normalized_columns())
    # A generated column: the filter on it stays above, and the price is parsed once
    # a row instead of again in every copy of the filter that is pushed down.
    priced = texts.select("*", F.explode(F.array(price)).alias(PRICE))
    # the source filters NOT LIKE '%negotiable%' on the parsed float,
    # which only removes the rows whose price could not be read.
    return priced.filter(F.col(PRICE).isNotNull()).select(*keep_id, PRICE, *others)
