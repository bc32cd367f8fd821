"""Price rounding and display text (X10-X13) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The display words of the tiered price text.
BILLION = "billion"
MILLION = "million"
THOUSAND = "thousand"
CURRENCY = "VND"


def round_half_even(c: Column) -> Column:
    """``int(round(x))`` (Python rounds half to even)."""
    return F.bround(c, 0).cast("bigint")


def thousands(c: Column) -> Column:
    """Integer with thousands separators, ``{:,.0f}``."""
    return F.format_number(c, 0)


def one_decimal(c: Column) -> Column:
    """Fixed one-decimal text, ``{:.1f}`` (no thousands separators)."""
    return F.translate(F.format_number(c.cast("double"), 1), ",", "")


def billions(total: Column) -> Column:
    """A whole amount in billions."""
    return total / F.lit(1e9)


def price_text(price: Column) -> Column:
    """X11: tiered text for a whole-VND amount.

    >= 1e9: "B billion [M million] VND"; >= 1e6: "M million [T thousand] VND";
    >= 1e3: "T thousand VND"; else "P VND".  A zero second part is omitted.
    """
    p = price.cast("bigint")
    b, rb = F.floor(p / 1_000_000_000), F.pmod(p, F.lit(1_000_000_000))
    m, rm = F.floor(p / 1_000_000), F.pmod(p, F.lit(1_000_000))
    sp = F.lit(" ")
    unit = F.lit(" " + CURRENCY)
    billions = F.when(F.floor(rb / 1_000_000) == 0, F.concat(thousands(b), sp, F.lit(BILLION), unit)) \
        .otherwise(F.concat(thousands(b), sp, F.lit(BILLION), sp, thousands(F.floor(rb / 1_000_000)),
                            sp, F.lit(MILLION), unit))
    millions = F.when(F.floor(rm / 1_000) == 0, F.concat(thousands(m), sp, F.lit(MILLION), unit)) \
        .otherwise(F.concat(thousands(m), sp, F.lit(MILLION), sp, thousands(F.floor(rm / 1_000)),
                            sp, F.lit(THOUSAND), unit))
    return (F.when(p >= 1_000_000_000, billions)
             .when(p >= 1_000_000, millions)
             .when(p >= 1_000, F.concat(thousands(F.floor(p / 1_000)), sp, F.lit(THOUSAND), unit))
             .otherwise(F.concat(thousands(p), unit)))


def total_price(price_per_m2: Column, area: Column) -> Column:
    """``int(round(int(round(p)) * area))``."""
    return round_half_even(round_half_even(price_per_m2) * area.cast("double"))
