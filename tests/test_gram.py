"""Regression from mergeable statistics (K10) against plain least squares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcela.operators import dictionary, features, gram, impute, models
from parcela.schema import CATEGORICAL_FEATURES, FLAG_COLUMNS, NUMERIC_FEATURES


def rows_of(spark, n=400):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 2)) * [3, 50] + [1, 200]
    y = 2 + x @ [0.5, -0.01] + rng.normal(size=n) * 0.1
    groups = ["hot" if i % 3 else f"g{i % 7}" for i in range(n)]
    rows = [(g, float(a), float(b), 4.0, float(t)) for g, (a, b), t in zip(groups, x, y)]
    return rows, spark.createDataFrame(rows + [("hot", None, 1.0, 4.0, 1.0), ("hot", 1.0, 1.0, 4.0, None), ("hot", float("nan"), 1.0, 4.0, 1.0)],
                                       "`g r` string, a double, `b c` double, same double, y double")


def test_groups_and_constant_columns(spark):
    rows, df = rows_of(spark)
    got = {}
    for r in gram.solve(gram.gram(df, ["a", "b c", "same"], "y", ["g r"]), 4).collect():
        got.setdefault((r["g r"], r.n), {})[r.feature] = r.coefficient
    assert len(got) == 8
    for (g, n), w in got.items():
        mine = [r for r in rows if r[0] == g]
        want = np.linalg.lstsq(np.array([[1, a, b] for _, a, b, _, _ in mine]), np.array([r[4] for r in mine]), rcond=None)[0]
        assert n == len(mine) and [w[0], w[1], w[2]] == pytest.approx(want.tolist(), rel=1e-6) and w[3] == 0


def test_states_merge(spark):
    _, df = rows_of(spark)
    df = df.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(3)))
    whole = gram.gram(df, ["a", "b c"], "y", ["g r"])
    parts = gram.merge(*[gram.gram(df.where(F.col("part").eqNullSafe(k)), ["a", "b c"], "y", ["g r"]) for k in range(3)])
    key = lambda frame: {(r["g r"], r.i, r.j): r.s for r in frame.collect()}
    a, b = key(whole), key(parts)
    assert a.keys() == b.keys() and [a[k] for k in a] == pytest.approx([b[k] for k in a])


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([("a", 2.0, 7.0), ("b", 1.0, 3.0), ("b", 1.0, 5.0)], "g string, x double, y double")
    got = {(r.g, r.feature): r.coefficient for r in gram.solve(gram.gram(df, ["x"], "y", ["g"]), 2).collect()}
    assert got == {("a", 0): 7.0, ("a", 1): 0.0, ("b", 0): 4.0, ("b", 1): 0.0}
    assert gram.solve(gram.gram(df.limit(0), ["x"], "y", ["g"]), 2).count() == 0
    told = gram.predict(df, gram.solve(gram.gram(df, ["x"], "y", ["g"]), 2), ["x"], ["g"])
    assert sorted((r.g, r.prediction) for r in told.collect()) == [("a", 7.0), ("b", 4.0), ("b", 4.0)]


def test_full_model_predicts_like_the_stock_learner(spark, clean_small):
    """Coefficients of dependent slots are free, fitted values are not."""
    train, _ = features.train_test_split(impute.model_table(clean_small))
    numbers = [*FLAG_COLUMNS, *NUMERIC_FEATURES]
    d = dictionary.label_dictionary(train)
    sizes = dictionary.label_counts(d)
    w = {r.feature: r.coefficient for r in gram.solve(gram.gram_with_labels(train, numbers, CATEGORICAL_FEATURES, d, models.LABEL), 1 + len(numbers) + sum(sizes.values())).collect()}
    fitted = models.fit_pipeline(train, models.linear_regression(maxIter=500, tol=1e-12))
    known = dictionary.encode(models.predict_all({"m": fitted}, train).where("prediction_m IS NOT NULL"), d)
    got, want, at = [], [], {}
    start = 1 + len(numbers)
    for c, n in sizes.items():
        at[c], start = start, start + n
    for r in known.collect():
        got.append(w[0] + sum(w[k] * float(r[c]) for k, c in enumerate(numbers, 1)) + sum(w[at[c] + r[c + "_idx"]] for c in sizes if r[c + "_idx"] < sizes[c]))
        want.append(r.prediction_m)
    assert got == pytest.approx(want, abs=1e-3)
    y = [r[models.LABEL] for r in known.collect()]
    assert abs(sum(a - b for a, b in zip(y, got))) < 1e-6 * len(y)          # the intercept's normal equation
