"""Scoring whole tables of valuation requests.

A request table is aligned to the model's expected columns, blank and
non-numeric inputs are normalised, count sentinels are flagged and filled
with the medians stored at training time (a single request no longer
imputes the median of an empty set), and the fitted pipeline transforms
every row.  Nothing is collected: the result is a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from parcela.functions.text import price_text, round_half_even
from parcela.operators.models import PriceModel, predict
from parcela.schema import AREA, CATEGORICAL_FEATURES, IMPUTE_COLUMNS, STREET, UNKNOWN_NUMBER

BLANK_TEXT = ("nan", "None", "NaN")
#: Names a request may use instead.
ALIASES = {AREA: "area", STREET: "street"}


def _number(c: Column, is_text: bool) -> Column:
    """A number; blank or unreadable text is null."""
    return F.nullif(F.trim(c), F.lit("")).try_cast("double") if is_text else c.cast("double")


def with_alias(requests: DataFrame, name: str) -> DataFrame:
    """Column ``name`` copied from its short alias where only that is present.

    Raises ``ValueError`` if the table has neither.
    """
    if name in requests.columns:
        return requests
    if ALIASES[name] not in requests.columns:
        raise ValueError(f"no column {name!r} or {ALIASES[name]!r}")
    return requests.withColumn(name, F.col(ALIASES[name]))


def normalize_requests(requests: DataFrame) -> DataFrame:
    """C7 + C8: add missing columns and normalise values.

    Counts: blank, unreadable or missing column -> -1.  Area and street: blank
    -> 0, unreadable or null -> null (such a row gets no prediction), a missing
    column -> -1 (after the short alias was tried).  Text: missing or 'nan' /
    'None' / 'NaN' -> ''.
    """
    for c in (AREA, STREET):
        if c not in requests.columns and ALIASES[c] in requests.columns:
            requests = with_alias(requests, c)
    types = dict(requests.dtypes)
    out = [F.col(f"`{c}`") for c in requests.columns
           if c not in IMPUTE_COLUMNS + [AREA, STREET] + CATEGORICAL_FEATURES]
    for c in IMPUTE_COLUMNS:
        src = F.col(c) if c in types else F.lit(None).cast("string")
        value = _number(src, types.get(c, "string") == "string")
        out.append(F.coalesce(value, F.lit(float(UNKNOWN_NUMBER))).alias(c))
    for c in (AREA, STREET):
        if c in types:
            value = _number(F.col(f"`{c}`"), types[c] == "string")
            if types[c] == "string":
                value = F.when(F.trim(f"`{c}`") == "", F.lit(0.0)).otherwise(value)
            out.append(value.alias(c))
        else:
            out.append(F.lit(float(UNKNOWN_NUMBER)).alias(c))
    for c in CATEGORICAL_FEATURES:
        src = F.col(c).cast(StringType()) if c in types else F.lit(None).cast("string")
        out.append(F.when(src.isNull() | src.isin(*BLANK_TEXT), F.lit("")).otherwise(src).alias(c))
    return requests.select(*out)


def flag_with_stored_medians(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """K7 at scoring time: flags from -1, fill with the training medians."""
    cols = []
    for name in df.columns:
        if name.endswith("_missing_flag"):
            continue  # recomputed below from the request's own values
        if name in IMPUTE_COLUMNS:
            v = F.col(name).cast("double")
            cols.append(F.when(v == UNKNOWN_NUMBER, F.lit(medians[name])).otherwise(v).alias(name))
        else:
            cols.append(F.col(f"`{name}`"))
    flags = [F.when(F.col(c) == UNKNOWN_NUMBER, 1).otherwise(0).alias(f"{c}_missing_flag")
             for c in IMPUTE_COLUMNS]
    return df.select(*cols, *flags)


def score(model: PriceModel, requests: DataFrame, id_col: str = "request_id") -> DataFrame:
    """Price per m2 (``expm1`` of the log prediction), its whole-VND
    rounding, the total for the requested area and its display text."""
    ready = flag_with_stored_medians(normalize_requests(requests), model.medians)
    pred = predict(model.pipeline, ready)
    per_m2 = round_half_even(F.col("predicted_price"))
    total = round_half_even(per_m2 * F.col(AREA))
    return pred.select(id_col, F.col("prediction").alias("prediction_log"),
                       "predicted_price", per_m2.alias("price_per_m2_int"),
                       total.alias("total_price"), price_text(total).alias("total_text"))
