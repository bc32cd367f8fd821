"""Cleaning rules as Column expressions.

Every rule is a pure function from text columns to a typed column, built
only from JVM-side functions so a whole cleaning pass stays inside one
whole-stage-codegen span.  ``try_*`` forms are used throughout because
Spark 4 runs with ANSI semantics, where a plain cast of bad text raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcela.schema import (
    FLOOR_WORD,
    ROOM_WORD,
    SAVED_MARKER,
    UNIT_MILLION,
    UNIT_THOUSAND,
    UNKNOWN_NUMBER,
    UNKNOWN_TEXT,
)


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fill_count(c: str | Column) -> Column:
    """A missing count becomes the text sentinel ``'-1'``."""
    return F.coalesce(_c(c), F.lit(str(UNKNOWN_NUMBER)))


def fill_text(c: str | Column) -> Column:
    """A missing label becomes the unknown marker."""
    return F.coalesce(_c(c), F.lit(UNKNOWN_TEXT))


def _when_contains(c: Column, needle: str, fn) -> Column:
    """Apply a regex rewrite only to rows containing ``needle``; a row without
    it cannot match, so the result is the same at a fraction of the cost."""
    return F.when(c.contains(needle), fn(c)).otherwise(c)


def strip_suffix(c: str | Column, word: str) -> Column:
    """Remove a trailing unit word and the spaces before it."""
    return _when_contains(_c(c), word, lambda x: F.regexp_replace(x, rf"\s*{word}$", ""))


def to_int(c: str | Column) -> Column:
    """Lenient text -> int: optional sign, digits, optional fraction (truncated).

    ``' 3 '`` -> 3, ``'3.0'`` -> 3, ``'-1'`` -> -1, ``'abc'`` / ``'1e3'`` -> null.
    Plain integers take the cheap cast; only the rest go through the pattern.
    """
    c = _c(c)
    whole = F.regexp_extract(c, r"^\s*([+-]?[0-9]+)(\.[0-9]*)?\s*$", 1)
    return F.coalesce(_try_cast(c, "int"), _try_cast(whole, "int"))


def _try_cast(c: Column, to: str) -> Column:
    return c.try_cast(to)


def normalize_price_text(c: str | Column) -> Column:
    """X20 step 1: remove every ``~`` and a trailing ``/m2``."""
    # Input referenced once: this text is inlined into the pushed-down
    # price filter, where Spark does not share common subexpressions.
    return F.regexp_replace(F.translate(_c(c), "~", ""), r"\s*/m2$", "")


def price_from_text(p: str | Column) -> Column:
    """X20 step 2, on normalised text: a ``million`` price keeps its digits and
    commas, the comma is the decimal mark, times 1e6; ``thousand`` likewise
    times 1e3; anything else drops thousands commas and is read as a number.
    Unreadable text (negotiable, billions) becomes null.  -> float."""
    p = _c(p)
    unit = F.when(p.contains(UNIT_MILLION), F.lit(1_000_000.0)).when(p.contains(UNIT_THOUSAND), F.lit(1_000.0))
    # With a unit word: digits and commas only, comma as the decimal mark.
    # Without: thousands commas dropped.  One extraction serves both.
    text = F.when(unit.isNotNull(), F.translate(F.regexp_replace(p, "[^0-9,]", ""), ",", "."))\
            .otherwise(F.translate(p, ",", ""))
    value = _try_cast(text, "double") * F.coalesce(unit, F.lit(1.0))
    return value.cast("float")


def parse_price(c: str | Column) -> Column:
    """Listing price text -> VND per m2 as float (both steps)."""
    return price_from_text(normalize_price_text(c))


def parse_area(c: str | Column) -> Column:
    """``'80 m2'`` -> 80.0; decimal commas are unreadable -> null."""
    return _try_cast(_when_contains(_c(c), "m2", lambda x: F.regexp_replace(x, r"\s*m2$", "")), "float")


def parse_floors(c: str | Column) -> Column:
    """``'3 tầng'`` -> 3 (input already sentinel-filled)."""
    return to_int(strip_suffix(c, FLOOR_WORD))


def parse_rooms(c: str | Column) -> Column:
    """``'2 phòng'`` -> 2 (input already sentinel-filled)."""
    return to_int(strip_suffix(c, ROOM_WORD))


def address_parts(location: str | Column) -> Column:
    """X23 step 1: drop a trailing save-marker, split on commas."""
    loc = _when_contains(_c(location), SAVED_MARKER,
                         lambda x: F.regexp_replace(x, rf"\s*{SAVED_MARKER}\s*$", ""))
    return F.split(loc, ",")


def district_from_parts(parts: str | Column) -> Column:
    """Trimmed last-but-one comma part of the address, null if absent."""
    return F.trim(F.try_element_at(_c(parts), F.lit(-2)))


def city_from_parts(parts: str | Column) -> Column:
    """Trimmed last comma part of the address."""
    return F.trim(F.try_element_at(_c(parts), F.lit(-1)))


def district_of(location: str | Column) -> Column:
    return district_from_parts(address_parts(location))


def city_of(location: str | Column) -> Column:
    return city_from_parts(address_parts(location))


def street_parts(c: str | Column) -> Column:
    """X24 step 1: remove every ``m`` and split on ``-`` (null stays null)."""
    return F.split(F.translate(_c(c), "m", ""), "-")


def street_from_parts(parts: str | Column) -> Column:
    """X24 step 2: with a second part the mean of the first two parts,
    otherwise the first part; null input, unreadable parts or an empty
    second part give the sentinel -1.  -> float."""
    parts = _c(parts)
    first = _try_cast(F.get(parts, F.lit(0)), "float")
    second = F.get(parts, F.lit(1))
    value = (F.when(parts.isNull(), F.lit(float(UNKNOWN_NUMBER)))
             .when(second.isNotNull(), (first + _try_cast(second, "float")) / F.lit(2))
             .otherwise(first.cast("double")))
    return F.coalesce(value, F.lit(float(UNKNOWN_NUMBER))).cast("float")


def parse_street(c: str | Column) -> Column:
    """Street width in metres; ``'5m - 7m'`` -> 6, unknown -> -1."""
    return street_from_parts(street_parts(c))
