"""Label dictionaries and sparse moments (K1, K2, K4)."""

import math

import pytest
from pyspark.sql import functions as F

from parcela.operators import dictionary, features, impute
from parcela.schema import CATEGORICAL_FEATURES


def test_order_ties_nulls_and_unseen(spark):
    rows = [("b", "x"), ("a", None), ("b", "y"), ("c", "y"), (None, "z"), ("a", "z")]
    df = spark.createDataFrame(rows, "`kind of` string, place string")
    d = dictionary.label_dictionary(df, ["kind of", "place"])
    got = {(r.column_name, r.label): (r.n, r.label_index) for r in d.collect()}
    assert got == {("kind of", "a"): (2, 0), ("kind of", "b"): (2, 1), ("kind of", "c"): (1, 2),
                   ("place", "y"): (2, 0), ("place", "z"): (2, 1), ("place", "x"): (1, 2)}
    new = spark.createDataFrame([("c", "never"), (None, "x")], df.schema)
    assert sorted((r["kind of_idx"], r.place_idx) for r in dictionary.encode(new, d, ["kind of", "place"]).collect()) == [(2, 3), (3, 2)]
    both = df.withColumn("learn", F.lit(True)).unionByName(new.withColumn("learn", F.lit(False)))
    shown = {(r.column_name, r.label): (r.label_index, r.vec_size, r.hot_pos, r.listings) for r in dictionary.indexed_labels(both, F.col("learn"), ["kind of", "place"]).collect()}
    assert shown["kind of", "c"] == (2, 3, 2, 2) and shown["kind of", None] == (3, 3, -1, 2)
    assert shown["place", "never"] == (3, 3, -1, 1) and shown["place", "x"] == (2, 3, 2, 2) and len(shown) == 9
    assert dictionary.label_dictionary(df.limit(0), ["place"]).count() == 0


def test_more_labels_than_a_list_should_hold(spark):
    """No job of the dictionary brings more than a count a column to the driver."""
    df = spark.range(300_000).select(F.concat(F.lit("label "), F.col("id") % 200_000).alias("c"))
    d = dictionary.label_dictionary(df, ["c"])
    assert "StringIndexer" not in d._jdf.queryExecution().toString()
    assert dictionary.label_counts(d, ["c"]) == {"c": 200_000}
    top = d.orderBy("label_index").limit(3).collect()
    assert [(r.label, r.n) for r in top] == [("label 0", 2), ("label 1", 2), ("label 10", 2)]
    assert d.agg(F.count_distinct("label_index"), F.max("label_index")).first()[:] == (200_000, 199_999)


def test_moments_equal_those_of_dense_vectors(clean_small):
    from pyspark.ml.feature import StandardScaler
    train, _ = features.train_test_split(impute.model_table(clean_small))
    stages = features.feature_pipeline(scale=False).fit(train)
    dense = StandardScaler(inputCol="features", outputCol="s", withMean=True).fit(stages.transform(train))
    got = sorted(tuple(r) for r in dictionary.moments(train).collect())
    assert [g[0] for g in got] == list(range(len(dense.mean)))
    assert [g[1] for g in got] == pytest.approx(dense.mean.tolist()) and [g[2] for g in got] == pytest.approx(dense.std.tolist())


def test_vectors_stay_sparse(clean_small):
    from pyspark.ml.linalg import SparseVector
    train, _ = features.train_test_split(impute.model_table(clean_small))
    ready = features.feature_pipeline().fit(train).transform(train).select("scaled_features").limit(50).collect()
    used = 10 + len(CATEGORICAL_FEATURES)
    assert all(isinstance(r[0], SparseVector) and len(r[0].indices) <= used < r[0].size for r in ready)
    assert not any(math.isnan(v) for r in ready for v in r[0].values)
