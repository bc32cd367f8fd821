"""DuckDB SQL for page tables, scoring input, small trees and two-feature regression.

Trees are searched afresh in SQL: for every feature and every midpoint of
neighbouring values, the split with the largest fall of squared error.
"""

from __future__ import annotations

from parcela.plans.oracle import LABELS_CTE, SQL, _estimate, _text, with_clean, with_model

_IMPUTE = ["bedroom_num", "toilet_num", "floor_num", "livingroom_num"]
_PAGE = ["area (m2)", *_IMPUTE, "street (m)"]


def _median(c: str) -> str:
    return f"""(SELECT quantile_cont(CAST("{c}" AS DOUBLE), 0.5) FROM clean WHERE "{c}" != -1)"""


SQL["impute_medians_approx"] = with_clean(" UNION ALL ".join(f"""
SELECT '{c}' AS column_name, CAST(quantile_disc(CASE WHEN {c} != -1 THEN {c} END, 0.5) AS DOUBLE) AS median FROM clean""" for c in _IMPUTE))

SQL["page_table"] = with_clean("SELECT clean.* REPLACE (" + ", ".join(
    f"""CASE WHEN "{c}" = -1 THEN {_median(c)} ELSE CAST("{c}" AS DOUBLE) END AS "{c}" """ for c in _PAGE)
    + """), "area (m2)" AS area_m2, "street (m)" AS street_width_m FROM clean""")

SQL["statistical_estimate_requests"] = with_clean("""
, asked AS (SELECT clean.* REPLACE (
    CASE WHEN listing_id % 5 = 0 THEN '' WHEN listing_id % 7 = 1 THEN '  ' WHEN listing_id % 7 = 2 THEN 'no such kind' ELSE category END AS category,
    CASE WHEN listing_id % 3 = 0 THEN NULL WHEN listing_id % 11 = 1 THEN 'no such place' WHEN listing_id % 11 = 2 THEN ' ' ELSE district END AS district)
  FROM clean)""" + _estimate("asked", "clean") + """
SELECT request_id, mean_source, mean_price,
       CASE WHEN area > 0 AND mean_price IS NOT NULL THEN mean_price * factor ELSE 0.0 END AS price_per_m2_est,
       CASE WHEN area > 0 AND mean_price IS NOT NULL THEN (mean_price * factor) * area ELSE 0.0 END AS total_est
FROM est""")

SQL["display_text"] = with_clean("""
, t AS (SELECT listing_id, CAST("area (m2)" AS DOUBLE) AS area,
               CAST(round_even(CAST(price_per_m2 AS DOUBLE), 0) AS BIGINT) AS p FROM clean WHERE "area (m2)" IS NOT NULL)
SELECT listing_id, printf('%.1f', area) AS area_text, CAST(round_even(p * area, 0) AS BIGINT) / 1e9::DOUBLE AS total_billions FROM t""")

_TYPES = {"listing_id": "bigint", "price_per_m2": "float", "area (m2)": "float", "category": "string", "direction": "string",
          "liability": "string", "floor_num": "int", "toilet_num": "int", "livingroom_num": "int", "bedroom_num": "int",
          "district": "string", "city_province": "string", "street (m)": "float"}
SQL["table_overview"] = with_clean(" UNION ALL ".join(f"""
SELECT {i} AS position, '{c}' AS column_name, '{t}' AS type, count(*) AS rows, count(*) - count("{c}") AS nulls,
       count(*) = 0 AS is_empty FROM clean""" for i, (c, t) in enumerate(_TYPES.items())))

SQL["preview"] = with_clean('SELECT * FROM clean ORDER BY listing_id, price_per_m2, "area (m2)" LIMIT 20')
SQL["csv_round_trip"] = with_clean("SELECT * FROM clean")
SQL["district_report_city"] = with_clean("""
SELECT city_province, district, count(*) AS listings, round(avg(CAST(price_per_m2 AS DOUBLE)), 4) AS avg_price_per_m2
FROM clean WHERE city_province = 'NATION_7' AND district IS NOT NULL GROUP BY city_province, district""")

_NUMBER = "coalesce(TRY_CAST(nullif(trim({0}), '') AS DOUBLE), {1})"
_ODD = {
    "bedroom_num": _NUMBER.format("CASE WHEN listing_id % 5 = 0 THEN ' ' WHEN listing_id % 7 = 0 THEN 'abc' ELSE CAST(bedroom_num AS VARCHAR) END", "-1.0"),
    "toilet_num": "coalesce(CAST(toilet_num AS DOUBLE), -1.0)",
    "floor_num": "coalesce(CASE WHEN listing_id % 4 <> 0 THEN CAST(floor_num AS DOUBLE) END, -1.0)",
    "livingroom_num": "-1.0::DOUBLE",
}
SQL["scoring_input"] = with_clean("""
, m AS (SELECT """ + ", ".join(f"{_median(c)} AS {c}" for c in _IMPUTE) + """),
text_area AS (SELECT *, CASE WHEN listing_id % 6 = 0 THEN '' WHEN listing_id % 13 = 0 THEN 'wide'
                             ELSE CAST(CAST("area (m2)" AS DOUBLE) AS VARCHAR) END AS area FROM clean),
n AS (SELECT listing_id, area, CASE WHEN area IS NULL THEN NULL WHEN trim(area) = '' THEN 0.0 ELSE TRY_CAST(area AS DOUBLE) END AS a,
             """ + ", ".join(f"{e} AS {c}" for c, e in _ODD.items()) + """,
             CASE WHEN listing_id % 9 IN (0, 1) OR district IS NULL THEN '' ELSE district END AS district, coalesce(city_province, '') AS city_province,
             CASE WHEN listing_id % 8 = 0 THEN 'no such kind' ELSE coalesce(category, '') END AS category, coalesce(liability, '') AS liability
      FROM text_area)
SELECT n.listing_id AS request_id, n.area, n.a AS "area (m2)", -1.0::DOUBLE AS "street (m)", n.category, '' AS direction, n.liability, n.district,
       n.city_province, """ + ", ".join(f"CASE WHEN n.{c} = -1 THEN m.{c} ELSE n.{c} END AS {c}, CASE WHEN n.{c} = -1 THEN 1 ELSE 0 END AS {c}_missing_flag"
                                        for c in _IMPUTE) + " FROM n, m")

SQL["linear_regression_two"] = with_model("""
, k AS (SELECT covar_samp(price_log, "area (m2)") AS y1, covar_samp(price_log, "street (m)") AS y2, covar_samp("area (m2)", "street (m)") AS c,
               var_samp("area (m2)") AS v1, var_samp("street (m)") AS v2, avg(price_log) AS my, avg("area (m2)") AS m1, avg("street (m)") AS m2
        FROM tr WHERE "area (m2)" IS NOT NULL AND "street (m)" IS NOT NULL),
b AS (SELECT (y1 * v2 - y2 * c) / (v1 * v2 - c * c) AS b1, (y2 * v1 - y1 * c) / (v1 * v2 - c * c) AS b2, my, m1, m2 FROM k)
SELECT round(b1, 8) AS slope_area, round(b2, 8) AS slope_street, round(my - b1 * m1 - b2 * m2, 8) AS intercept FROM b""")


def _stump(name: str, rows: str, y: str) -> str:
    """CTEs ending in ``name`` (f, t, ml, mr): the best split of ``rows`` by label ``y``, and both means."""
    long = " UNION ALL ".join(f"SELECT {i} AS f, {c} AS v, {y} AS y FROM {rows}" for i, c in enumerate(_IMPUTE))
    return f"""
{name}_h AS (SELECT f, v, count(*) AS n, sum(y) AS s FROM ({long}) GROUP BY f, v),
{name}_c AS (SELECT f, v, lead(v) OVER (PARTITION BY f ORDER BY v) AS nv, sum(n) OVER (PARTITION BY f ORDER BY v) AS nl,
                    sum(s) OVER (PARTITION BY f ORDER BY v) AS sl, sum(n) OVER (PARTITION BY f) AS nt, sum(s) OVER (PARTITION BY f) AS st FROM {name}_h),
{name} AS (SELECT f, (v + nv) / 2 AS t, sl / nl AS ml, (st - sl) / (nt - nl) AS mr FROM {name}_c WHERE nv IS NOT NULL
           ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) DESC, f, t LIMIT 1)"""


def _goes_left(name: str, row: str) -> str:
    value = "CASE " + f"{name}.f " + " ".join(f"WHEN {i} THEN {row}.{c}" for i, c in enumerate(_IMPUTE)) + " END"
    return f"({value} <= {name}.t)"


_KNOWN = " AND ".join(f"{c} IS NOT NULL" for c in _IMPUTE)
TREES = f""",
k AS (SELECT * FROM tr WHERE {_KNOWN}), q AS (SELECT * FROM te WHERE {_KNOWN}),""" + _stump("s1", "k", "price_log") + f""",
kl AS (SELECT k.* FROM k, s1 WHERE {_goes_left("s1", "k")}), kr AS (SELECT k.* FROM k, s1 WHERE NOT {_goes_left("s1", "k")}),""" + \
    _stump("sl", "kl", "price_log") + "," + _stump("sr", "kr", "price_log") + f""",
kg AS (SELECT k.*, 2 * (price_log - CASE WHEN {_goes_left("s1", "k")} THEN s1.ml ELSE s1.mr END) AS g FROM k, s1),""" + _stump("s2", "kg", "g") + f""",
p AS (SELECT q.*, CASE WHEN {_goes_left("s1", "q")} THEN s1.ml ELSE s1.mr END AS tree_1,
             CASE WHEN {_goes_left("s1", "q")} THEN CASE WHEN {_goes_left("sl", "q")} THEN sl.ml ELSE sl.mr END
                  ELSE CASE WHEN {_goes_left("sr", "q")} THEN sr.ml ELSE sr.mr END END AS tree_2,
             CASE WHEN {_goes_left("s2", "q")} THEN s2.ml ELSE s2.mr END AS step
      FROM q, s1, sl, sr, s2)"""

SQL["count_trees"] = with_model(TREES + f"""
SELECT {', '.join(_IMPUTE)}, count(*) AS rows, round(max(tree_1), 8) AS prediction_tree_1, round(max(tree_2), 8) AS prediction_tree_2,
       round(max(tree_2), 8) AS prediction_forest, round(max(tree_1 + 0.1::DOUBLE * step), 8) AS prediction_boosted
FROM p GROUP BY {', '.join(_IMPUTE)}""")

SQL["saved_model"] = with_model(TREES + f"""
SELECT {', '.join(f'p.{c}' for c in _IMPUTE)}, count(*) AS rows, round(max(tree_2), 8) AS prediction,
       {', '.join(f'max(med.{c}) AS median_{c}' for c in _IMPUTE)}
FROM p, med GROUP BY {', '.join(f'p.{c}' for c in _IMPUTE)}""")

SQL["count_tree_metrics"] = with_model(TREES + """,
e AS (""" + " UNION ALL ".join(f"SELECT '{n}' AS model, price_per_m2 AS y, exp({x}) - 1 AS p FROM p" for n, x in (
    ("tree_1", "tree_1"), ("tree_2", "tree_2"), ("forest", "tree_2"), ("boosted", "tree_1 + 0.1::DOUBLE * step"))) + """)
SELECT model, (SELECT count(*) FROM te) AS n_total, count(*) AS n_scored, round(sqrt(sum((y - p) * (y - p)) / count(*)), 2) AS rmse,
       round(sum((y - p) * (y - p)) / count(*), -4) AS mse, round(avg(abs(y - p)), 2) AS mae,
       round(1.0 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 8) AS r2
FROM e GROUP BY model""")


# --- least squares by normal equations ------------------------------------------------

_FLAGS = [f"{c}_missing_flag" for c in _IMPUTE]
_CATEGORIES = ["category", "direction", "liability", "district", "city_province"]
_NUMBERS = ["area (m2)", "floor_num", "toilet_num", "livingroom_num", "bedroom_num", "street (m)"]


def _eliminated(p: str) -> str:
    """From m (g, i, row): e, the normal equations of ``p`` features after every step; a dependent feature's row is 0."""
    return f"""
e AS (
  SELECT 0 AS k, g, i, row, row[i + 1] AS own FROM m
  UNION ALL
  SELECT a.k + 1, a.g, a.i,
         CASE WHEN b.row[a.k + 1] <= 1e-6 * b.own THEN CASE WHEN a.i = a.k THEN list_transform(a.row, lambda v: 0.0::DOUBLE) ELSE a.row END
              WHEN a.i = a.k THEN list_transform(a.row, lambda v: v / b.row[a.k + 1])
              ELSE list_transform(list_zip(a.row, b.row), lambda v: v[1] - v[2] * a.row[a.k + 1] / b.row[a.k + 1]) END, a.own
  FROM e a JOIN e b ON a.g IS NOT DISTINCT FROM b.g AND b.i = a.k WHERE a.k < {p}
)"""


_RECURSIVE = lambda text: text.replace("WITH ", "WITH RECURSIVE ", 1)
_WHOLE = " AND ".join(f'"{c}" IS NOT NULL' for c in _NUMBERS)

SQL["linear_by_city"] = _RECURSIVE(with_model(f""",
v AS (SELECT row_number() OVER () AS r, * FROM tr WHERE {_WHOLE}),
f AS (SELECT r, city_province AS g, 0 AS i, 1.0::DOUBLE AS x FROM v UNION ALL """ + " UNION ALL ".join(
    f'SELECT r, city_province, {k}, CAST("{c}" AS DOUBLE) FROM v' for k, c in enumerate([*_NUMBERS, "price_log"], 1)) + f"""),
s AS (SELECT a.g, a.i, b.i AS j, sum(a.x * b.x) AS s FROM f a JOIN f b ON a.r = b.r WHERE a.i < {len(_NUMBERS) + 1} GROUP BY ALL),
m AS (SELECT g, i, list(s ORDER BY j) AS row FROM s GROUP BY g, i),""" + _eliminated(str(len(_NUMBERS) + 1)) + f"""
SELECT e.g AS city_province, (SELECT count(*) FROM v WHERE city_province IS NOT DISTINCT FROM e.g) AS n, CAST(i AS INTEGER) AS feature,
       round(row[{len(_NUMBERS) + 2}], 6) AS coefficient
FROM e WHERE k = {len(_NUMBERS) + 1}"""))

_SLOT0 = 1 + len(_FLAGS) + len(_NUMBERS)
SQL["linear_full"] = _RECURSIVE(with_model(LABELS_CTE + f""",
pos AS (SELECT * FROM (VALUES """ + ", ".join(f"('{c}', {i})" for i, c in enumerate(_CATEGORIES)) + f""") t(column_name, o)),
starts AS (SELECT nlab.column_name, {_SLOT0} + coalesce(sum(n) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
           FROM nlab JOIN pos ON nlab.column_name = pos.column_name),
size AS (SELECT CAST({_SLOT0} + sum(n) AS BIGINT) AS p FROM nlab),
v AS (SELECT row_number() OVER () AS r, * FROM tr WHERE {_WHOLE}),
f AS MATERIALIZED (
  SELECT r, 0 AS i, 1.0::DOUBLE AS x FROM v UNION ALL """ + " UNION ALL ".join(
    f'SELECT r, {k}, CAST("{c}" AS DOUBLE) FROM v' for k, c in enumerate([*_FLAGS, *_NUMBERS], 1)) + """
  UNION ALL SELECT r, p, price_log FROM v, size
  UNION ALL SELECT l.r, CAST(starts.start + ranks.idx AS BIGINT), 1.0::DOUBLE FROM (""" + " UNION ALL ".join(
    f"SELECT r, '{c}' AS column_name, {c} AS label FROM v" for c in _CATEGORIES) + """) l
  JOIN ranks ON ranks.column_name = l.column_name AND ranks.label = l.label JOIN starts ON starts.column_name = l.column_name),
s AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS s FROM f a JOIN f b ON a.r = b.r GROUP BY a.i, b.i),
grid AS (SELECT a.i, b.j FROM (SELECT unnest(range(p)) AS i FROM size) a, (SELECT unnest(range(p + 1)) AS j FROM size) b),
m AS (SELECT 0 AS g, grid.i, list(coalesce(s.s, 0.0) ORDER BY grid.j) AS row FROM grid LEFT JOIN s ON s.i = grid.i AND s.j = grid.j GROUP BY grid.i),"""
                                                       + _eliminated("(SELECT p FROM size)") + """
SELECT (SELECT count(*) FROM v) AS n, CAST(i AS INTEGER) AS feature, round(row[p + 1], 6) AS coefficient FROM e, size WHERE k = p"""))


# --- boosted stumps ---------------------------------------------------------------------

_ROUNDS = 20


def _boosted(rounds: int) -> str:
    """CTEs ending in f (a row for each kind of counts, with the sum of all stumps as ``p``)."""
    keys = ", ".join(_IMPUTE)
    out = [f""",
kinds AS MATERIALIZED (SELECT {keys}, count(*) AS n, sum(price_log) AS y FROM tr WHERE {_KNOWN} GROUP BY ALL),
p0 AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS p FROM kinds)"""]
    for k in range(rounds):
        residual = "y" if k == 0 else "2 * (y - n * p)"
        long = " UNION ALL ".join(f"SELECT {i} AS f, {c} AS v, n, {residual} AS g FROM p{k}" for i, c in enumerate(_IMPUTE))
        out.append(f"""h{k} AS (SELECT f, v, sum(n) AS n, sum(g) AS s FROM ({long}) GROUP BY f, v),
w{k} AS (SELECT f, v, lead(v) OVER o AS nv, sum(n) OVER o AS nl, sum(s) OVER o AS sl, sum(n) OVER (PARTITION BY f) AS nt, sum(s) OVER (PARTITION BY f) AS st
         FROM h{k} WINDOW o AS (PARTITION BY f ORDER BY v)),
b{k} AS MATERIALIZED (SELECT f, (v + nv) / 2 AS t, sl / nl AS ml, (st - sl) / (nt - nl) AS mr FROM w{k} WHERE nv IS NOT NULL
         ORDER BY round(sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) - st * st / nt, 9) DESC, f, t LIMIT 1),
p{k + 1} AS MATERIALIZED (SELECT p{k}.* REPLACE (p + {'1.0' if k == 0 else '0.1'}::DOUBLE * CASE WHEN {_goes_left(f'b{k}', f'p{k}')} THEN ml ELSE mr END AS p) FROM p{k}, b{k})""")
    # Kinds of counts that no training row has are sent through the same stumps.
    test = " + ".join(f"{'1.0' if k == 0 else '0.1'}::DOUBLE * CASE WHEN {_goes_left(f'b{k}', 'q')} THEN b{k}.ml ELSE b{k}.mr END" for k in range(rounds))
    out.append(f"""f AS MATERIALIZED (SELECT q.*, {test} AS p FROM (SELECT {keys}, count(*) AS rows FROM te WHERE {_KNOWN} GROUP BY ALL) q, {', '.join(f'b{k}' for k in range(rounds))})""")
    return ",\n".join(out)


SQL["boosted_stumps"] = with_model(_boosted(_ROUNDS) + f"""
SELECT {', '.join(_IMPUTE)}, rows, round(p, 8) AS prediction FROM f""")

SQL["boosted_stumps_score"] = with_model(_boosted(_ROUNDS) + f""",
x AS (SELECT te.listing_id AS request_id, f.p, te."area (m2)" AS area FROM te LEFT JOIN f ON {' AND '.join(f'te.{c} = f.{c}' for c in _IMPUTE)}),
z AS (SELECT request_id, p, exp(p) - 1 AS price, CAST(round_even(exp(p) - 1, 0) AS BIGINT) AS per_m2, area FROM x),
t AS (SELECT *, CAST(round_even(per_m2 * area, 0) AS BIGINT) AS total_price FROM z)
SELECT request_id, round(p, 8) AS prediction_log, round(price, 4) AS predicted_price, per_m2 AS price_per_m2_int, total_price,
       CASE WHEN total_price IS NOT NULL THEN {_text('total_price')} END AS total_text FROM t""")
