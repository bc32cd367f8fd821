"""Feature pipeline, model fit / save / load / score on small data."""

import pytest

from parcela.operators import evaluate, features, impute, models, score
from parcela.schema import CATEGORICAL_FEATURES, IMPUTE_COLUMNS, PRICE


@pytest.fixture(scope="module")
def split(clean_small):
    table = impute.model_table(clean_small)
    return features.train_test_split(table)


def test_split_is_deterministic_and_complete(clean_small, split):
    train, test = split
    table = impute.model_table(clean_small)
    assert train.count() + test.count() == table.count()
    again, _ = features.train_test_split(table.repartition(5))
    assert sorted(r.listing_id for r in again.collect()) == sorted(r.listing_id for r in train.collect())


def test_label_order_is_frequency_then_label(split):
    from pyspark.ml import Pipeline
    train, _ = split
    fitted = Pipeline(stages=features.indexers()).fit(train)
    labels = fitted.stages[0].labelsArray
    for col, lab in zip(CATEGORICAL_FEATURES, labels):
        counts = {r[col]: r["count"] for r in train.groupBy(col).count().collect() if r[col] is not None}
        assert list(lab) == sorted(counts, key=lambda v: (-counts[v], v))


def test_fit_save_load_score(spark, clean_small, scratch):
    train, _ = features.train_test_split(impute.model_table(clean_small))
    _, test = features.train_test_split(impute.trim_prices(clean_small))
    fitted = models.fit_pipeline(train, models.gbt(max_iter=3, max_depth=3))
    model = models.PriceModel(fitted, models.training_medians(clean_small))
    path = f"{scratch}/gbt"
    model.save(path)
    loaded = models.PriceModel.load(path)
    assert loaded.medians == pytest.approx(model.medians)
    reqs = test.withColumnRenamed("listing_id", "request_id").drop(PRICE)
    a = score.score(model, reqs).orderBy("request_id").collect()
    b = score.score(loaded, reqs).orderBy("request_id").collect()
    known = [r for r in a if r.prediction_log is not None]
    assert len(a) == len(b) == test.count()
    assert len(a) - len(known) == test.where("`area (m2)` IS NULL").count() > 0      # kept, without a prediction
    assert [r.prediction_log for r in known] == pytest.approx([r.prediction_log for r in b if r.prediction_log is not None])
    assert all(r.total_text.endswith("VND") for r in known)


def test_scoring_sees_the_flags_and_medians_of_training(spark, clean_small):
    """Unfilled test rows come out of scoring as the model table has them."""
    _, want = features.train_test_split(impute.model_table(clean_small))
    _, test = features.train_test_split(impute.trim_prices(clean_small))
    ready = score.flag_with_stored_medians(score.normalize_requests(test), models.training_medians(clean_small))
    cols = ["listing_id", *IMPUTE_COLUMNS, *[f"{c}_missing_flag" for c in IMPUTE_COLUMNS]]
    assert sorted(map(tuple, ready.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    assert sum(r.bedroom_num_missing_flag for r in ready.collect()) > 0


def test_compare_counts_unscored_rows(spark, clean_small):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    train, test = features.train_test_split(impute.model_table(clean_small))
    fitted = models.fit_all(train, {"linear": models.linear_regression(), "tree": models.decision_tree(maxDepth=2)})
    predicted = models.predict_all(fitted, test)
    rows = evaluate.compare_models(predicted, {n: f"prediction_{n}" for n in fitted}).collect()
    assert {r.model for r in rows} == {"linear", "tree"}
    assert all(r.n_total == test.count() and r.n_scored == test.where("`area (m2)` IS NOT NULL").count() for r in rows)
    one = evaluate.evaluate_model(predicted, "prediction_tree").first()
    assert next(r.rmse for r in rows if r.model == "tree") == pytest.approx(one.rmse) and one.mse == pytest.approx(one.rmse ** 2)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= max(1, before)      # clean_small alone, if this is its first use


def test_constant_label_and_no_rows(spark):
    rows = spark.createDataFrame([(5.0, 4.0), (5.0, 6.0), (5.0, None)], "actual_price double, predicted_price double")
    m = evaluate.regression_metrics(rows).first()
    assert (m.n, m.rmse, m.r2) == (2, 1.0, None)
    assert evaluate.regression_metrics(rows.limit(0)).first().n == 0


def test_single_request_uses_training_medians(spark, clean_small):
    medians = models.training_medians(clean_small)
    req = spark.createDataFrame(
        [(1, "80", "", None, "abc", "2", "8", "C", "D", "x", "nan", None)],
        "request_id long, `area (m2)` string, bedroom_num string, floor_num string, "
        "toilet_num string, livingroom_num string, `street (m)` string, city_province string, "
        "district string, category string, direction string, liability string")
    norm = score.normalize_requests(req).first()
    assert norm.bedroom_num == -1 and norm.floor_num == -1 and norm.toilet_num == -1
    assert norm["area (m2)"] == 80.0 and norm.direction == "" and norm.liability == ""
    filled = score.flag_with_stored_medians(score.normalize_requests(req), medians).first()
    for c in IMPUTE_COLUMNS[:3]:
        assert filled[c] is not None
    assert filled.bedroom_num == medians["bedroom_num"] and filled.bedroom_num_missing_flag == 1


def test_missing_and_short_named_columns(spark):
    req = spark.createDataFrame([(1, " ", 2.5)], "request_id long, area string, bedroom_num double")
    norm = score.normalize_requests(req).first()
    assert norm["area (m2)"] == 0.0 and norm["street (m)"] == -1.0 and norm.toilet_num == -1 and norm.bedroom_num == 2.5
    assert impute.with_short_names(spark.createDataFrame([(1.0, 2.0)], "`area (m2)` double, street_width_m double")).columns[-1] == "area_m2"
    with pytest.raises(ValueError):
        impute.with_short_names(spark.createDataFrame([(1.0,)], "area_m2 double"))
    with pytest.raises(ValueError):
        score.with_alias(req, "street (m)")


def test_trees_of_kinds_are_the_trees_of_rows(spark, monkeypatch):
    """The count trees learn from a weighted row a kind and predict what the rows' trees do."""
    from parcela.plans import catalog
    from pyspark.sql import functions as F
    rows = [(*[float((k * m) % 5) for m in (1, 2, 3, 7)], float((k * 13) % 17)) for k in range(60)] * 5
    train = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in IMPUTE_COLUMNS) + ", price_log double")
    monkeypatch.setattr(catalog.features, "train_test_split", lambda t: (train, train))
    monkeypatch.setattr(catalog, "model_table_of", lambda *a: train)
    plain = models.predict_all(catalog._fit_on(train, IMPUTE_COLUMNS, catalog._count_trees()), train, IMPUTE_COLUMNS)
    held_rows = []
    hold = catalog.held
    monkeypatch.setattr(catalog, "held", lambda df: held_rows.append(df.count()) or hold(df))
    got = catalog._count_tree_predictions(spark, "")
    names = [f"prediction_{n}" for n in catalog._count_trees()]
    key = lambda df: sorted(tuple(round(v, 9) for v in r) for r in df.select(*IMPUTE_COLUMNS, *names).distinct().collect())
    assert set(key(got)) == set(key(plain))
    assert held_rows == [train.select(*IMPUTE_COLUMNS).distinct().count()]
