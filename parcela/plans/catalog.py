"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query starts from the driver tables in ``sf_dir`` (raw listings are
derived from them by Spark) and runs over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.functions.text import billions, one_decimal, price_text, total_price
from parcela.operators import boosting, dictionary, estimate, evaluate, features, forest, gram, impute, market, models, profile, score
from parcela.operators.clean import clean
from parcela.operators.joins import scalar_row
from parcela.schema import AREA, CATEGORICAL_FEATURES, FLAG_COLUMNS, IMPUTE_COLUMNS, NUMERIC_FEATURES, PRICE, STREET
from parcela.session import checkpointed, ensure_checkpoint_dir, held
from parcela.sources import io
from parcela.sources.fixtures import raw_listings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def clean_listings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean listings derived from the driver tables.

    Nothing is written or cached: a query that needs the table twice (quantiles,
    then rows) reads it twice, and Spark reuses equal exchanges.
    """
    return clean(raw_listings(spark, sf_dir))


def shared_folder(spark: SparkSession, name: str) -> str:
    """One folder a query and application in the shared checkpoint folder; written over each time."""
    return f"{ensure_checkpoint_dir(spark)}/{spark.sparkContext.applicationId}/{name}"


@register("raw_listings")
def q_raw_listings(spark, sf_dir):
    return raw_listings(spark, sf_dir)


@register("clean_listings")
def q_clean_listings(spark, sf_dir):
    return clean_listings_of(spark, sf_dir)


@register("avg_price_by_city_top10")
def q_avg_price_by_city_top10(spark, sf_dir):
    return market.top_cities_by_price(clean_listings_of(spark, sf_dir), 10)


# --- profiling -------------------------------------------------------------

@register("clean_report")
def q_clean_report(spark, sf_dir):
    return profile.cleaning_report(raw_listings(spark, sf_dir))


@register("null_counts")
def q_null_counts(spark, sf_dir):
    return profile.null_counts(clean_listings_of(spark, sf_dir))


@register("price_summary")
def q_price_summary(spark, sf_dir):
    s = profile.price_summary(impute.trim_prices(clean_listings_of(spark, sf_dir)))
    return s.select("count", *[F.round(c, 4).alias(c) for c in
                               ("mean", "stddev", "min", "p25", "p50", "p75", "max")])


@register("price_boxplot")
def q_price_boxplot(spark, sf_dir):
    b = profile.price_boxplot(clean_listings_of(spark, sf_dir))
    return b.select("stage", "n", "outliers", *[F.round(c, 4).alias(c) for c in
                    ("q1", "median", "q3", "iqr", "whisker_low", "whisker_high")])


# --- market statistics -----------------------------------------------------

@register("price_overview")
def q_price_overview(spark, sf_dir):
    o = market.price_overview(clean_listings_of(spark, sf_dir))
    return o.select("listings", "max_price", "min_price",
                    F.round("avg_price", 4).alias("avg_price"),
                    F.round("median_price", 4).alias("median_price"))


@register("price_quartiles")
def q_price_quartiles(spark, sf_dir):
    q = market.price_quartiles(clean_listings_of(spark, sf_dir))
    return q.select(F.round("q25", 4).alias("q25"), F.round("q75", 4).alias("q75"))


@register("price_range_share")
def q_price_range_share(spark, sf_dir):
    s = market.price_range_share(clean_listings_of(spark, sf_dir))
    return s.select("in_range", "total", "pct",
                    *[F.round(c, 4).alias(c) for c in
                      ("range_low", "range_high", "avg_price", "avg_area")])


@register("price_range_listings")
def q_price_range_listings(spark, sf_dir):
    return market.price_range_listings(clean_listings_of(spark, sf_dir))


@register("distinct_places")
def q_distinct_places(spark, sf_dir):
    return market.distinct_places(clean_listings_of(spark, sf_dir))


@register("most_common_city")
def q_most_common_city(spark, sf_dir):
    return market.most_common(clean_listings_of(spark, sf_dir), "city_province")


@register("most_common_district")
def q_most_common_district(spark, sf_dir):
    return market.most_common(clean_listings_of(spark, sf_dir), "district")


@register("avg_price_by_district")
def q_avg_price_by_district(spark, sf_dir):
    d = market.avg_price_by_district(clean_listings_of(spark, sf_dir))
    return d.select("city_province", "district", "listings",
                    F.round("avg_price_per_m2", 4).alias("avg_price_per_m2"))


@register("districts_in_city")
def q_districts_in_city(spark, sf_dir):
    return market.districts_in_city(clean_listings_of(spark, sf_dir))


@register("sorted_options")
def q_sorted_options(spark, sf_dir):
    return market.sorted_options(clean_listings_of(spark, sf_dir))


# --- imputation and features ------------------------------------------------

def model_table_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute.model_table(clean_listings_of(spark, sf_dir))


@register("impute_medians")
def q_impute_medians(spark, sf_dir):
    stats = impute.sentinel_medians(clean_listings_of(spark, sf_dir))
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__median").alias("median"),
                     F.col(f"{c}__sentinels").alias("sentinels"), F.col(f"{c}__nulls").alias("nulls"))
            for c in impute.IMPUTE_COLUMNS]
    return stats.select(F.inline(F.array(*rows)))


@register("model_table")
def q_model_table(spark, sf_dir):
    m = model_table_of(spark, sf_dir)
    return m.withColumn("price_log", F.round("price_log", 9))


@register("outlier_trim")
def q_outlier_trim(spark, sf_dir):
    c = clean_listings_of(spark, sf_dir)
    x = F.col(PRICE).cast("double")
    return c.agg(F.count(F.lit(1)).alias("rows_before"),
                 F.count_if(x.between(impute.PRICE_TRIM_LOW, impute.PRICE_TRIM_HIGH)).alias("rows_after"),
                 F.count_if(x < impute.PRICE_TRIM_LOW).alias("removed_low"),
                 F.count_if(x > impute.PRICE_TRIM_HIGH).alias("removed_high"))


@register("train_test_split")
def q_train_test_split(spark, sf_dir):
    m = model_table_of(spark, sf_dir)
    return (m.select(F.when(features.split_bucket() < 20, "test").otherwise("train").alias("split"))
             .groupBy("split").agg(F.count(F.lit(1)).alias("rows")))


def _split(spark, sf_dir):
    return features.train_test_split(model_table_of(spark, sf_dir))


@register("label_index")
def q_label_index(spark, sf_dir):
    """K1: the training labels' dictionary, applied to all rows."""
    out = dictionary.indexed_labels(model_table_of(spark, sf_dir), features.split_bucket() >= 20)
    return out.select("column_name", "label", F.col("label_index").cast("double").alias("label_index"), "listings")


@register("one_hot")
def q_one_hot(spark, sf_dir):
    """K2: vector size and hot slot of each label."""
    out = dictionary.indexed_labels(model_table_of(spark, sf_dir), features.split_bucket() >= 20)
    return out.select("column_name", "label", F.col("label_index").cast("double").alias("label_index"), "vec_size", "hot_pos", "listings")


@register("standardize")
def q_standardize(spark, sf_dir):
    """K4: mean and deviation of every slot, from counts: no vector is made."""
    train, _ = _split(spark, sf_dir)
    return dictionary.moments(train).select("feature_index", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@register("impute_medians_approx")
def q_impute_medians_approx(spark, sf_dir):
    stats = impute.sentinel_medians(clean_listings_of(spark, sf_dir), approximate=True)
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__median").alias("median")) for c in impute.IMPUTE_COLUMNS]
    return stats.select(F.inline(F.array(*rows)))


@register("page_table")
def q_page_table(spark, sf_dir):
    return impute.page_table(clean_listings_of(spark, sf_dir))


# --- estimates ---------------------------------------------------------------

def _requests_from(clean_df: DataFrame) -> DataFrame:
    return clean_df.withColumnRenamed("listing_id", "request_id")


@register("statistical_estimate")
def q_statistical_estimate(spark, sf_dir):
    c = clean_listings_of(spark, sf_dir)
    e = estimate.statistical_estimate(_requests_from(c), c)
    return e.select("request_id", "mean_source", "mean_price", "price_per_m2_est", "total_est")


@register("statistical_estimate_requests")
def q_statistical_estimate_requests(spark, sf_dir):
    """K17 and F7 with empty, blank and unseen fields, spread over the listings by id."""
    c = clean_listings_of(spark, sf_dir)
    i = F.col("request_id")
    r = _requests_from(c).withColumns({
        "category": F.when(i % 5 == 0, "").when(i % 7 == 1, "  ").when(i % 7 == 2, "no such kind").otherwise(F.col("category")),
        "district": F.when(i % 3 == 0, F.lit(None).cast("string")).when(i % 11 == 1, "no such place").when(i % 11 == 2, " ")
                     .otherwise(F.col("district"))})
    e = estimate.statistical_estimate(r, c)
    return e.select("request_id", "mean_source", "mean_price", "price_per_m2_est", "total_est")


@register("comparables_top5")
def q_comparables_top5(spark, sf_dir):
    c = clean_listings_of(spark, sf_dir)
    return estimate.comparables(_requests_from(c), c, k=5, exclude_self=True)


@register("price_text")
def q_price_text(spark, sf_dir):
    c = clean_listings_of(spark, sf_dir).filter(F.col(AREA).isNotNull())
    total = total_price(F.col(PRICE), F.col(AREA))
    return c.select("listing_id", F.bround(PRICE, 0).cast("bigint").alias("price_per_m2_int"),
                    total.alias("total_price"), price_text(total).alias("total_text"))


@register("display_text")
def q_display_text(spark, sf_dir):
    c = clean_listings_of(spark, sf_dir).filter(F.col(AREA).isNotNull())
    total = total_price(F.col(PRICE), F.col(AREA))
    return c.select("listing_id", one_decimal(F.col(AREA)).alias("area_text"), billions(total).alias("total_billions"))


# --- sources, sinks and inspection ------------------------------------------------

@register("table_overview")
def q_table_overview(spark, sf_dir):
    return profile.table_overview(clean_listings_of(spark, sf_dir))


@register("preview")
def q_preview(spark, sf_dir):
    return profile.preview(clean_listings_of(spark, sf_dir), ["listing_id", PRICE, AREA])


@register("csv_round_trip")
def q_csv_round_trip(spark, sf_dir):
    """S4, S1, the cleaning job, S4 and S2: raw and clean listings through CSV files."""
    raw, cleaned = shared_folder(spark, "raw_csv"), shared_folder(spark, "clean_csv")
    io.write_csv(raw_listings(spark, sf_dir), raw)
    io.write_csv(clean(io.read_raw_csv(spark, raw)), cleaned)
    return io.read_clean_csv(spark, cleaned)


@register("district_report_city")
def q_district_report_city(spark, sf_dir):
    d = market.avg_price_by_district(clean_listings_of(spark, sf_dir), city="NATION_7")
    return d.select("city_province", "district", "listings", F.round("avg_price_per_m2", 4).alias("avg_price_per_m2"))


# --- models --------------------------------------------------------------------

def _fit_on(train: DataFrame, inputs: list[str], regressors: dict) -> dict:
    """Regressors fitted on a few plain inputs (no encoding or scaling), as pipelines."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler
    assembler = VectorAssembler(inputCols=inputs, outputCol=models.FEATURES)
    with held(assembler.transform(train.where(features.scorable(inputs))).select(models.FEATURES, models.LABEL)) as ready:
        return {name: PipelineModel([assembler, r.fit(ready)]) for name, r in regressors.items()}


def _fit_on_kinds(train: DataFrame, inputs: list[str], regressors: dict) -> dict:
    """Trees fitted on the rows' kinds: equal inputs, with their mean label and their number as weight.

    A split's fall of squared error and a node's mean depend on the rows of a kind
    only through these two, so the trees are those of the rows.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler
    assembler = VectorAssembler(inputCols=inputs, outputCol=models.FEATURES)
    kinds = (train.where(features.scorable(inputs)).groupBy(*[F.col(f"`{c}`") for c in inputs])
             .agg(F.avg(models.LABEL).alias(models.LABEL), F.count(models.LABEL).cast("double").alias("rows")))
    with held(assembler.transform(kinds).select(models.FEATURES, models.LABEL, "rows")) as ready:
        return {name: PipelineModel([assembler, r.copy({r.weightCol: "rows"}).fit(ready)]) for name, r in regressors.items()}


def _coefficients(spark, fitted) -> DataFrame:
    lr = fitted.stages[-1]
    return spark.createDataFrame([(lr.coefficients, float(lr.intercept))], ["w", "intercept"])


@register("linear_regression")
def q_linear_regression(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    train, _ = _split(spark, sf_dir)
    fitted = _fit_on(train, [AREA], {"lr": models.linear_regression(solver="normal")})["lr"]
    return _coefficients(spark, fitted).select(F.round(vector_to_array("w")[0], 8).alias("slope"),
                                               F.round("intercept", 8).alias("intercept"))


@register("linear_regression_two")
def q_linear_regression_two(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    train, _ = _split(spark, sf_dir)
    fitted = _fit_on(train, [AREA, STREET], {"lr": models.linear_regression(solver="normal")})["lr"]
    w = vector_to_array("w")
    return _coefficients(spark, fitted).select(F.round(w[0], 8).alias("slope_area"), F.round(w[1], 8).alias("slope_street"),
                                               F.round("intercept", 8).alias("intercept"))


def _count_trees() -> dict:
    """Small trees over the four counts, whose splits are exact: few distinct values."""
    return {"tree_1": models.decision_tree(maxDepth=1), "tree_2": models.decision_tree(maxDepth=2),
            "forest": models.random_forest(num_trees=1, max_depth=2, bootstrap=False, featureSubsetStrategy="all"),
            "boosted": models.gbt(max_iter=2, max_depth=1)}


def _count_tree_predictions(spark, sf_dir) -> DataFrame:
    train, test = _split(spark, sf_dir)
    return models.predict_all(_fit_on_kinds(train, IMPUTE_COLUMNS, _count_trees()), test, IMPUTE_COLUMNS)


@register("count_trees")
def q_count_trees(spark, sf_dir):
    """K11-K13 on the four counts: predictions of each kind of test row."""
    p = _count_tree_predictions(spark, sf_dir)
    names = [f"prediction_{n}" for n in _count_trees()]
    return p.groupBy(*IMPUTE_COLUMNS).agg(F.count(F.lit(1)).alias("rows"), *[F.round(F.max(n), 8).alias(n) for n in names])


@register("count_tree_metrics")
def q_count_tree_metrics(spark, sf_dir):
    """K14 + K15 over the same models."""
    m = evaluate.compare_models(_count_tree_predictions(spark, sf_dir), {n: f"prediction_{n}" for n in _count_trees()})
    return m.select("model", "n_total", "n_scored", F.round("rmse", 2).alias("rmse"), F.round("mse", -4).alias("mse"),
                    F.round("mae", 2).alias("mae"), F.round("r2", 8).alias("r2"))


@register("saved_model")
def q_saved_model(spark, sf_dir):
    """S5 + S6: a model saved, read back and applied."""
    c = clean_listings_of(spark, sf_dir)
    train, test = features.train_test_split(impute.model_table(c))
    fitted = _fit_on_kinds(train, IMPUTE_COLUMNS, {"tree": _count_trees()["tree_2"]})["tree"]
    folder = shared_folder(spark, "saved_model")
    models.PriceModel(fitted, models.training_medians(c)).save(folder)
    loaded = models.PriceModel.load(folder)
    p = models.predict_all({"tree": loaded.pipeline}, test, IMPUTE_COLUMNS)
    medians = [F.lit(loaded.medians[m]).alias(f"median_{m}") for m in IMPUTE_COLUMNS]
    return p.groupBy(*IMPUTE_COLUMNS).agg(F.count(F.lit(1)).alias("rows"), F.round(F.max("prediction_tree"), 8).alias("prediction")).select("*", *medians)


@register("linear_full")
def q_linear_full(spark, sf_dir):
    """All coefficients of the full feature model, from its Gram matrix."""
    train, _ = _split(spark, sf_dir)
    numbers = [*FLAG_COLUMNS, *NUMERIC_FEATURES]
    with held(train.select(*[F.col(f"`{c}`") for c in [*numbers, *CATEGORICAL_FEATURES, models.LABEL]])) as rows:
        labels = dictionary.label_dictionary(rows)
        size = 1 + len(numbers) + sum(dictionary.label_counts(labels).values())
        state = checkpointed(gram.gram_with_labels(rows, numbers, CATEGORICAL_FEATURES, labels, models.LABEL))
    return gram.solve(state, size).select("n", "feature", F.round("coefficient", 6).alias("coefficient"))


@register("linear_by_city")
def q_linear_by_city(spark, sf_dir):
    """One regression a city on the numbers, all solved side by side."""
    train, _ = _split(spark, sf_dir)
    state = gram.gram(train, NUMERIC_FEATURES, models.LABEL, ["city_province"])
    return gram.solve(state, 1 + len(NUMERIC_FEATURES)).select("city_province", "n", "feature", F.round("coefficient", 6).alias("coefficient"))


BOOSTED_ROUNDS = 20


def _boosted_stumps(train: DataFrame) -> boosting.Boosted:
    """Stumps over the four counts, whose splits are exact: few distinct values."""
    return boosting.fit(train, models.LABEL, IMPUTE_COLUMNS, rounds=BOOSTED_ROUNDS, depth=1)


@register("boosted_stumps")
def q_boosted_stumps(spark, sf_dir):
    """K13 by histograms: 20 rounds; predictions of each kind of test row."""
    train, test = _split(spark, sf_dir)
    p = _boosted_stumps(train).predict(test)
    return p.where(features.scorable(IMPUTE_COLUMNS)).groupBy(*IMPUTE_COLUMNS).agg(F.count(F.lit(1)).alias("rows"), F.round(F.max("prediction"), 8).alias("prediction"))


@register("boosted_stumps_score")
def q_boosted_stumps_score(spark, sf_dir):
    """The test split's clean rows, unfilled, scored to total and text by the stumps."""
    c = clean_listings_of(spark, sf_dir)
    train, _ = features.train_test_split(impute.model_table(c))
    model = models.PriceModel(_boosted_stumps(train), models.training_medians(c))
    _, unfilled = features.train_test_split(impute.trim_prices(c))
    out = score.score(model, _requests_from(unfilled).drop(PRICE))
    return out.withColumns({"prediction_log": F.round("prediction_log", 8), "predicted_price": F.round("predicted_price", 4)})


def _metrics_rounded(m: DataFrame) -> DataFrame:
    return m.select("n", F.round("rmse", 2).alias("rmse"), F.round("mse", -4).alias("mse"),
                    F.round("mae", 2).alias("mae"), F.round("r2", 8).alias("r2"))


@register("regression_metrics")
def q_regression_metrics(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    requests = _requests_from(test).withColumn("actual_price", F.col(PRICE))
    est = estimate.statistical_estimate(requests, train, carry=["actual_price"])
    return _metrics_rounded(evaluate.regression_metrics(est.withColumnRenamed("mean_price", "predicted_price")))


#: The four price models (K10-K13) with the source job's settings.
REGRESSORS = {"linear_regression": models.linear_regression, "decision_tree": lambda: models.decision_tree(seed=42),
              "random_forest": forest.Learner, "gbt": boosting.Learner}
_KEPT: dict[tuple[str, str, str], str] = {}


def kept_models(spark, sf_dir, names: list[str]) -> dict[str, models.PriceModel]:
    """Models of the training split, fitted once an application and table folder: saved on first
    use (S5) into the shared folder and read back (S6) by every query that asks for them."""
    key = lambda n: (spark.sparkContext.applicationId, sf_dir, n)
    missing = [n for n in names if key(n) not in _KEPT]
    if missing:
        c = clean_listings_of(spark, sf_dir)
        train, _ = features.train_test_split(impute.model_table(c))
        medians = models.training_medians(c)
        for n, fitted in models.fit_all(train, {n: REGRESSORS[n]() for n in missing}).items():
            folder = shared_folder(spark, f"models_{len(_KEPT)}_{n}")
            models.PriceModel(fitted, medians).save(folder)
            _KEPT[key(n)] = folder
    return {n: models.PriceModel.load(_KEPT[key(n)]) for n in names}


@register("model_comparison")
def q_model_comparison(spark, sf_dir):
    _, test = _split(spark, sf_dir)
    fitted = {n: m.pipeline for n, m in kept_models(spark, sf_dir, list(REGRESSORS)).items()}
    return evaluate.compare_models(models.predict_all(fitted, test), {n: f"prediction_{n}" for n in fitted})


def _odd_requests(clean_df: DataFrame) -> DataFrame:
    """Requests as a form may send them: text numbers, blanks, unseen labels, short names, no living rooms."""
    i = F.col("listing_id")
    return clean_df.select(
        i.alias("request_id"),
        F.when(i % 6 == 0, "").when(i % 13 == 0, "wide").otherwise(F.col(f"`{AREA}`").cast("double").cast("string")).alias("area"),
        F.when(i % 5 == 0, " ").when(i % 7 == 0, "abc").otherwise(F.col("bedroom_num").cast("string")).alias("bedroom_num"),
        F.when(i % 4 != 0, F.col("floor_num")).alias("floor_num"), F.col("toilet_num").cast("double").alias("toilet_num"),
        F.when(i % 9 == 0, "nan").when(i % 9 == 1, "None").otherwise(F.col("district")).alias("district"), "city_province",
        F.when(i % 8 == 0, "no such kind").otherwise(F.col("category")).alias("category"), "liability")


@register("scoring_input")
def q_scoring_input(spark, sf_dir):
    """C7, C8 and K7 at scoring time: flags, fills and normalised values of odd requests."""
    c = clean_listings_of(spark, sf_dir)
    stats = scalar_row(impute.sentinel_medians(c))
    return score.flag_with_stored_medians(score.normalize_requests(_odd_requests(c)), {m: stats[f"{m}__median"] for m in IMPUTE_COLUMNS})


def _score_query(spark, sf_dir, name):
    """The test split's clean rows as they were before any fill, scored by a model of the training split."""
    model = kept_models(spark, sf_dir, [name])[name]
    _, unfilled = features.train_test_split(impute.trim_prices(clean_listings_of(spark, sf_dir)))
    return score.score(model, _requests_from(unfilled).drop(PRICE))


@register("gbt_score")
def q_gbt_score(spark, sf_dir):
    return _score_query(spark, sf_dir, "gbt")


@register("decision_tree_score")
def q_decision_tree_score(spark, sf_dir):
    return _score_query(spark, sf_dir, "decision_tree")


@register("random_forest_score")
def q_random_forest_score(spark, sf_dir):
    return _score_query(spark, sf_dir, "random_forest")


@register("linear_score")
def q_linear_score(spark, sf_dir):
    return _score_query(spark, sf_dir, "linear_regression")
