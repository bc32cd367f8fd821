"""Feature engineering (K1-K6) with Spark ML stages.

Label indexing, one-hot encoding, vector assembly and standardisation are
the stock ``pyspark.ml`` estimators: their fits are distributed aggregates
(label counts, column summaries) and their transforms are per-row
expressions.  The train/test split is a deterministic function of the
listing key, so it does not change with partitioning (``randomSplit`` does).
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.schema import CATEGORICAL_FEATURES, FLAG_COLUMNS, NUMERIC_FEATURES

SPLIT_MODULUS = 1000003
SPLIT_MULTIPLIER = 7919


def split_bucket(key: str | Column = "listing_id") -> Column:
    """K6: a bucket 0..99 mixed from the key (plain integer arithmetic, no overflow)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.pmod(k, F.lit(SPLIT_MODULUS)) * F.lit(SPLIT_MULTIPLIER), F.lit(100))


def train_test_split(df: DataFrame, test_pct: int = 20,
                     key: str = "listing_id") -> tuple[DataFrame, DataFrame]:
    """K6: reproducible (1 - test_pct%) / test_pct% split by key bucket."""
    b = split_bucket(key)
    return df.filter(b >= test_pct), df.filter(b < test_pct)


def indexers(categorical: list[str] = CATEGORICAL_FEATURES, suffix: str = "_idx"):
    """K1: frequency-ordered label index (ties alphabetical); unseen and null
    labels -> numLabels.  One multi-column stage: all label counts in one pass."""
    return [StringIndexer(inputCols=list(categorical), outputCols=[c + suffix for c in categorical],
                          handleInvalid="keep")]


def encoders(categorical: list[str] = CATEGORICAL_FEATURES, suffix: str = "_idx"):
    """K2: one-hot with the last category (the unseen bucket) dropped."""
    return [OneHotEncoder(inputCols=[c + suffix for c in categorical],
                          outputCols=[c + "_vec" for c in categorical])]


def feature_stages(numeric: list[str] = NUMERIC_FEATURES, flags: list[str] = FLAG_COLUMNS,
                   categorical: list[str] = CATEGORICAL_FEATURES,
                   handle_invalid: str = "skip", scale: bool = True):
    """K1-K4 stages: indexers, encoders, assembler (flags, numerics, one-hots), scaler.

    Labels are counted over all rows.  A row with a null or NaN number cannot be
    assembled and is left out from there on; ``scorable`` tells such rows, so that
    predictions keep them and reports count them.  The scaler divides only: centring
    would make every vector dense and is one constant of a linear model's intercept.
    """
    stages = indexers(categorical) + encoders(categorical)
    stages.append(VectorAssembler(inputCols=flags + numeric + [c + "_vec" for c in categorical],
                                  outputCol="features", handleInvalid=handle_invalid))
    if scale:
        stages.append(StandardScaler(inputCol="features", outputCol="scaled_features",
                                     withMean=False, withStd=True))
    return stages


def scorable(numeric: list[str] = NUMERIC_FEATURES) -> Column:
    """True for rows whose numbers are all present: only these can be assembled."""
    out = F.lit(True)
    for c in numeric:
        out = out & F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`").cast("double"))
    return out


def feature_pipeline(**kw) -> Pipeline:
    """K5: the feature stages as one Pipeline (fit on train only)."""
    return Pipeline(stages=feature_stages(**kw))
