"""Oracle pairs: registered Spark queries against their DuckDB SQL on sf0.001."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ["lineitem", "orders", "customer", "nation", "part"]

# Fast relational queries; the full set runs at sf0.01 via tools/check_oracle.py.
NAMES = ["raw_listings", "clean_listings", "avg_price_by_city_top10", "clean_report",
         "null_counts", "price_summary", "price_boxplot", "price_range_share",
         "most_common_district", "avg_price_by_district", "sorted_options", "impute_medians",
         "model_table", "statistical_estimate", "comparables_top5", "price_text",
         "regression_metrics", "statistical_estimate_requests", "scoring_input", "page_table",
         "table_overview", "district_report_city", "impute_medians_approx", "csv_round_trip",
         "display_text", "count_trees"]


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t)}.parquet')")
    return c


def _rows(pdf):
    cols = sorted(pdf.columns)

    def norm(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if hasattr(v, "item"):
            v = v.item()
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return cols, sorted((tuple(norm(v) for v in r) for r in pdf[cols].itertuples(index=False)),
                        key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf_dir, con, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert _rows(got) == _rows(want)


def test_every_query_has_a_callable_and_sql_keys_are_queries():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert all(callable(f) for f in qs.values())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["city_province", "avg_price_per_m2", "listings"]
    assert 0 < len(rows) <= 10
