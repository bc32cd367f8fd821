"""DuckDB SQL oracle for every registered query.

Each statement is self-contained ANSI-ish SQL over the driver's tables
(``lineitem orders customer nation part`` views).  The shared CTEs below
re-state the fixture derivation and the cleaning rules in SQL so the Spark
result is checked against an independent engine.
"""

from __future__ import annotations

RAW_CTE = r"""
raw_base AS (
  SELECT l_orderkey * 10 + l_linenumber AS _id,
         CAST(floor(l_extendedprice / 100) AS BIGINT) AS _u,
         CAST(l_quantity AS BIGINT) AS _q,
         l_partkey, l_suppkey, l_returnflag, o_orderpriority, c_custkey, n_name, p_name, p_type
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey
),
raw AS (
  SELECT (_id * 100000 + l_partkey) * 10000 + l_suppkey AS listing_id,
         p_name AS title,
         'https://example.invalid/' || CAST(_id AS VARCHAR) AS link,
         CASE WHEN _id % 20 = 0 THEN NULL
              WHEN _id % 20 = 1 THEN 'Thương lượng'
              WHEN _id % 20 = 2 THEN '1,5 tỷ/m2'
              WHEN _id % 20 = 3 THEN '~' || CAST(_u AS VARCHAR) || ' nghìn/m2'
              WHEN _id % 20 = 4 THEN '12,345,' || CAST(100 + _u % 900 AS VARCHAR)
              ELSE '~' || CAST(1 + _u % 130 AS VARCHAR) || ',' || CAST(_u % 10 AS VARCHAR) || ' triệu/m2'
         END AS price,
         CASE WHEN _id % 23 = 0 THEN NULL
              WHEN _id % 29 = 0 THEN CAST(20 + 3 * _q AS VARCHAR) || ',5 m2'
              ELSE CAST(20 + 3 * _q AS VARCHAR) || ' m2' END AS area,
         CASE WHEN _id % 11 = 0 THEN NULL ELSE p_type END AS category,
         CASE WHEN _id % 3 = 0 THEN NULL
              WHEN l_returnflag = 'A' THEN 'Đông'
              WHEN l_returnflag = 'N' THEN 'Nam'
              ELSE 'Tây Bắc' END AS direction,
         CASE WHEN _id % 5 = 0 THEN NULL ELSE o_orderpriority END AS liability,
         CASE WHEN _id % 31 = 0 THEN NULL
              WHEN _id % 37 = 0 THEN n_name
              WHEN _id % 2 = 0 THEN 'Street ' || CAST(l_suppkey AS VARCHAR) || ', ' || n_name || ' D'
                   || CAST(c_custkey % 5 AS VARCHAR) || ', ' || n_name || '  Lưu tin '
              ELSE 'Street ' || CAST(l_suppkey AS VARCHAR) || ', ' || n_name || ' D'
                   || CAST(c_custkey % 5 AS VARCHAR) || ', ' || n_name END AS location,
         CASE WHEN _id % 4 = 0 THEN NULL
              WHEN _id % 41 = 0 THEN 'abc'
              WHEN _id % 7 = 0 THEN CAST(_id % 9 AS VARCHAR) || 'm - ' || CAST(_id % 9 + 4 AS VARCHAR) || 'm'
              ELSE CAST(3 + _id % 17 AS VARCHAR) || 'm' END AS street,
         CASE WHEN _id % 6 = 0 THEN NULL ELSE CAST(1 + _id % 5 AS VARCHAR) || ' tầng' END AS floor_num,
         CASE WHEN _id % 7 = 0 THEN NULL ELSE CAST(1 + _id % 4 AS VARCHAR) END AS toilet_num,
         CASE WHEN _id % 8 = 0 THEN NULL ELSE CAST(1 + _id % 3 AS VARCHAR) END AS livingroom_num,
         CASE WHEN _id % 9 = 0 THEN NULL ELSE CAST(1 + _id % 6 AS VARCHAR) || ' phòng' END AS bedroom_num
  FROM raw_base
)"""

_INT = r"TRY_CAST(regexp_extract({x}, '^\s*([+-]?[0-9]+)(\.[0-9]*)?\s*$', 1) AS INTEGER)"

CLEAN_CTE = RAW_CTE + r""",
clean_base AS (
  SELECT listing_id,
         regexp_replace(regexp_replace(price, '~', '', 'g'), '\s*/m2$', '') AS _p,
         area, category, direction, liability,
         regexp_replace(coalesce(location, 'Không xác định'), '\s*Lưu tin\s*$', '') AS _loc,
         replace(street, 'm', '') AS _s,
         floor_num, toilet_num, livingroom_num, bedroom_num
  FROM raw
  WHERE price IS NOT NULL AND area IS NOT NULL
),
clean_all AS (
  SELECT listing_id,
         CAST(CASE WHEN contains(_p, 'triệu')
                   THEN TRY_CAST(replace(regexp_replace(_p, '[^0-9,]', '', 'g'), ',', '.') AS DOUBLE) * 1000000.0
                   WHEN contains(_p, 'nghìn')
                   THEN TRY_CAST(replace(regexp_replace(_p, '[^0-9,]', '', 'g'), ',', '.') AS DOUBLE) * 1000.0
                   ELSE TRY_CAST(replace(_p, ',', '') AS DOUBLE) END AS FLOAT) AS price_per_m2,
         TRY_CAST(regexp_replace(area, '\s*m2$', '') AS FLOAT) AS "area (m2)",
         coalesce(category, 'Không xác định') AS category,
         coalesce(direction, 'Không xác định') AS direction,
         coalesce(liability, 'Không xác định') AS liability,
         """ + _INT.format(x=r"regexp_replace(coalesce(floor_num, '-1'), '\s*tầng$', '')") + r""" AS floor_num,
         """ + _INT.format(x="coalesce(toilet_num, '-1')") + r""" AS toilet_num,
         """ + _INT.format(x="coalesce(livingroom_num, '-1')") + r""" AS livingroom_num,
         """ + _INT.format(x=r"regexp_replace(coalesce(bedroom_num, '-1'), '\s*phòng$', '')") + r""" AS bedroom_num,
         trim(string_split(_loc, ',')[-2]) AS district,
         trim(string_split(_loc, ',')[-1]) AS city_province,
         CAST(coalesce(
           CASE WHEN _s IS NULL THEN -1.0
                WHEN string_split(_s, '-')[2] IS NOT NULL
                THEN (CAST(TRY_CAST(string_split(_s, '-')[1] AS FLOAT) AS DOUBLE)
                      + CAST(TRY_CAST(string_split(_s, '-')[2] AS FLOAT) AS DOUBLE)) / 2
                ELSE CAST(TRY_CAST(string_split(_s, '-')[1] AS FLOAT) AS DOUBLE) END,
           -1.0) AS FLOAT) AS "street (m)"
  FROM clean_base
),
clean AS (SELECT * FROM clean_all WHERE price_per_m2 IS NOT NULL)"""


def with_clean(body: str) -> str:
    return "WITH " + CLEAN_CTE + "\n" + body


def with_raw(body: str) -> str:
    return "WITH " + RAW_CTE + "\n" + body


SQL: dict[str, str] = {}

SQL["raw_listings"] = with_raw("SELECT * FROM raw")

SQL["clean_listings"] = with_clean("SELECT * FROM clean")

SQL["avg_price_by_city_top10"] = with_clean("""
SELECT city_province, avg(CAST(price_per_m2 AS DOUBLE)) AS avg_price_per_m2,
       count(*) AS listings
FROM clean
WHERE city_province IS NOT NULL
GROUP BY city_province
ORDER BY avg_price_per_m2 DESC, city_province
LIMIT 10""")

# --- profiling -------------------------------------------------------------

_RAW_COLS = ["title", "link", "price", "area", "category", "direction", "liability",
             "location", "street", "floor_num", "toilet_num", "livingroom_num", "bedroom_num"]
_DROP_COLS = _RAW_COLS[2:]
_CLEAN_COLS = ["price_per_m2", "area (m2)", "category", "direction", "liability", "floor_num",
               "toilet_num", "livingroom_num", "bedroom_num", "district", "city_province",
               "street (m)"]


def _report_part(stage: str, table: str, cols: list[str]) -> list[str]:
    return [f"""SELECT '{stage}' AS stage, '{c}' AS column_name, CAST(count(*) AS BIGINT) AS rows,
       CAST(count(*) - count("{c}") AS BIGINT) AS nulls FROM {table}""" for c in cols]


SQL["clean_report"] = with_clean(
    ", dropped AS (SELECT * FROM raw WHERE price IS NOT NULL AND area IS NOT NULL)\n"
    + "\nUNION ALL\n".join(_report_part("raw", "raw", _RAW_COLS)
                           + _report_part("after_drop", "dropped", _DROP_COLS)
                           + _report_part("clean", "clean", _CLEAN_COLS)))

SQL["null_counts"] = with_clean("SELECT " + ", ".join(
    f'CAST(count(*) - count("{c}") AS BIGINT) AS "{c}"' for c in ["listing_id"] + _CLEAN_COLS)
    + " FROM clean")

SQL["price_summary"] = with_clean("""
, t AS (SELECT CAST(price_per_m2 AS DOUBLE) AS x FROM clean WHERE price_per_m2 BETWEEN 2e6 AND 1e8)
SELECT count(x) AS count, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS stddev,
       round(min(x), 4) AS min, round(quantile_cont(x, 0.25), 4) AS p25,
       round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.75), 4) AS p75,
       round(max(x), 4) AS max
FROM t""")

SQL["price_boxplot"] = with_clean("""
, v AS (SELECT CAST(price_per_m2 AS DOUBLE) AS x FROM clean WHERE price_per_m2 IS NOT NULL),
s AS (SELECT 'before_trim' AS stage, x FROM v
      UNION ALL SELECT 'after_trim' AS stage, x FROM v WHERE x BETWEEN 2e6 AND 1e8),
q AS (SELECT stage, count(x) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
             quantile_cont(x, 0.75) AS q3 FROM s GROUP BY stage),
f AS (SELECT s.stage, s.x, q.q1 - 1.5 * (q.q3 - q.q1) AS lo, q.q3 + 1.5 * (q.q3 - q.q1) AS hi
      FROM s JOIN q ON s.stage = q.stage),
w AS (SELECT stage, min(CASE WHEN x BETWEEN lo AND hi THEN x END) AS wlo,
             max(CASE WHEN x BETWEEN lo AND hi THEN x END) AS whi,
             CAST(count(*) FILTER (WHERE NOT (x BETWEEN lo AND hi)) AS BIGINT) AS outliers
      FROM f GROUP BY stage)
SELECT q.stage, q.n, w.outliers, round(q.q1, 4) AS q1, round(q.median, 4) AS median,
       round(q.q3, 4) AS q3, round(q.q3 - q.q1, 4) AS iqr, round(w.wlo, 4) AS whisker_low,
       round(w.whi, 4) AS whisker_high
FROM q JOIN w ON q.stage = w.stage""")

# --- market statistics -----------------------------------------------------

SQL["price_overview"] = with_clean("""
SELECT count(price_per_m2) AS listings, max(CAST(price_per_m2 AS DOUBLE)) AS max_price,
       min(CAST(price_per_m2 AS DOUBLE)) AS min_price,
       round(avg(CAST(price_per_m2 AS DOUBLE)), 4) AS avg_price,
       round(quantile_cont(CAST(price_per_m2 AS DOUBLE), 0.5), 4) AS median_price
FROM clean""")

SQL["price_quartiles"] = with_clean("""
SELECT round(quantile_cont(CAST(price_per_m2 AS DOUBLE), 0.25), 4) AS q25,
       round(quantile_cont(CAST(price_per_m2 AS DOUBLE), 0.75), 4) AS q75
FROM clean""")

_RANGE = """
, b AS (SELECT quantile_cont(CAST(price_per_m2 AS DOUBLE), 0.25) AS lo,
               quantile_cont(CAST(price_per_m2 AS DOUBLE), 0.75) AS hi FROM clean),
r AS (SELECT clean.*, CAST(price_per_m2 AS DOUBLE) BETWEEN b.lo AND b.hi AS inside, b.lo, b.hi
      FROM clean, b)"""

SQL["price_range_share"] = with_clean(_RANGE + """
SELECT CAST(count(*) FILTER (WHERE inside) AS BIGINT) AS in_range, CAST(count(*) AS BIGINT) AS total,
       CAST(CASE WHEN count(*) > 0 THEN floor(100 * count(*) FILTER (WHERE inside) / count(*)) ELSE 0 END
            AS BIGINT) AS pct,
       round(min(lo), 4) AS range_low, round(min(hi), 4) AS range_high,
       round(avg(CASE WHEN inside THEN CAST(price_per_m2 AS DOUBLE) END), 4) AS avg_price,
       round(avg(CASE WHEN inside THEN CAST("area (m2)" AS DOUBLE) END), 4) AS avg_area
FROM r""")

SQL["price_range_listings"] = with_clean(_RANGE + """
SELECT listing_id, city_province, district, CAST("area (m2)" AS DOUBLE) AS area_m2,
       CAST(price_per_m2 AS DOUBLE) AS price_per_m2, category
FROM r WHERE inside ORDER BY listing_id LIMIT 10""")

SQL["distinct_places"] = with_clean("""
SELECT count(DISTINCT city_province) AS cities, count(DISTINCT district) AS districts FROM clean""")

for _name, _col in (("most_common_city", "city_province"), ("most_common_district", "district")):
    SQL[_name] = with_clean(f"""
SELECT {_col}, count(*) AS listings FROM clean WHERE {_col} IS NOT NULL
GROUP BY {_col} ORDER BY listings DESC, {_col} LIMIT 1""")

SQL["avg_price_by_district"] = with_clean("""
SELECT city_province, district, count(*) AS listings,
       round(avg(CAST(price_per_m2 AS DOUBLE)), 4) AS avg_price_per_m2
FROM clean WHERE district IS NOT NULL AND city_province IS NOT NULL
GROUP BY city_province, district""")

SQL["districts_in_city"] = with_clean("""
SELECT DISTINCT city_province, district FROM clean
WHERE district IS NOT NULL AND city_province IS NOT NULL""")

SQL["sorted_options"] = with_clean("""
SELECT DISTINCT field, value FROM (
  SELECT 'city_province' AS field, city_province AS value FROM clean
  UNION ALL SELECT 'category', category FROM clean
  UNION ALL SELECT 'direction', direction FROM clean
  UNION ALL SELECT 'liability', liability FROM clean) WHERE value IS NOT NULL""")

# --- imputation and features ------------------------------------------------

_IMPUTE = ["bedroom_num", "toilet_num", "floor_num", "livingroom_num"]
_CATS = ["category", "direction", "liability", "district", "city_province"]

MODEL_CTE = CLEAN_CTE + """,
med AS (SELECT """ + ", ".join(
    f"quantile_cont(CASE WHEN {c} != -1 THEN CAST({c} AS DOUBLE) END, 0.5) AS {c}" for c in _IMPUTE) + """
        FROM clean),
model_all AS (
  SELECT clean.listing_id, CAST(clean.price_per_m2 AS DOUBLE) AS price_per_m2,
         CAST(clean."area (m2)" AS DOUBLE) AS "area (m2)", clean.category, clean.direction, clean.liability,
""" + "".join(f"""         CASE WHEN clean.{c} = -1 THEN med.{c} ELSE CAST(clean.{c} AS DOUBLE) END AS {c},
""" for c in ["floor_num", "toilet_num", "livingroom_num", "bedroom_num"]) + """         clean.district, clean.city_province, CAST(clean."street (m)" AS DOUBLE) AS "street (m)",
""" + ",\n".join(f"         CASE WHEN clean.{c} = -1 THEN 1 ELSE 0 END AS {c}_missing_flag" for c in _IMPUTE) + """
  FROM clean, med),
model AS (SELECT *, ln(1 + price_per_m2) AS price_log FROM model_all
          WHERE price_per_m2 BETWEEN 2e6 AND 1e8),
tr AS (SELECT * FROM model WHERE ((listing_id % 1000003) * 7919) % 100 >= 20),
te AS (SELECT * FROM model WHERE ((listing_id % 1000003) * 7919) % 100 < 20)"""


def with_model(body: str) -> str:
    return "WITH " + MODEL_CTE + "\n" + body


def _long_labels(table: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS label FROM {table}" for c in _CATS)


LABELS_CTE = f""",
tr_counts AS (SELECT column_name, label, count(*) AS cnt FROM ({_long_labels('tr')})
              WHERE label IS NOT NULL GROUP BY ALL),
ranks AS (SELECT column_name, label,
                 row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, label) - 1 AS idx
          FROM tr_counts),
nlab AS (SELECT column_name, count(*) AS n FROM tr_counts GROUP BY ALL),
all_idx AS (SELECT a.column_name, a.label, coalesce(r.idx, nl.n) AS idx, nl.n
            FROM ({_long_labels('model')}) a
            LEFT JOIN ranks r ON a.column_name = r.column_name AND a.label = r.label
            JOIN nlab nl ON a.column_name = nl.column_name)"""

SQL["impute_medians"] = with_clean(" UNION ALL ".join(f"""
SELECT '{c}' AS column_name,
       quantile_cont(CASE WHEN {c} != -1 THEN CAST({c} AS DOUBLE) END, 0.5) AS median,
       count(*) FILTER (WHERE {c} = -1) AS sentinels, count(*) - count({c}) AS nulls
FROM clean""" for c in _IMPUTE))

SQL["model_table"] = with_model("""
SELECT * REPLACE (round(price_log, 9) AS price_log) FROM model""")

SQL["outlier_trim"] = with_clean("""
SELECT count(*) AS rows_before,
       count(*) FILTER (WHERE CAST(price_per_m2 AS DOUBLE) BETWEEN 2e6 AND 1e8) AS rows_after,
       count(*) FILTER (WHERE CAST(price_per_m2 AS DOUBLE) < 2e6) AS removed_low,
       count(*) FILTER (WHERE CAST(price_per_m2 AS DOUBLE) > 1e8) AS removed_high
FROM clean""")

SQL["train_test_split"] = with_model("""
SELECT CASE WHEN ((listing_id % 1000003) * 7919) % 100 < 20 THEN 'test' ELSE 'train' END AS split,
       count(*) AS rows
FROM model GROUP BY ALL""")

SQL["label_index"] = with_model(LABELS_CTE + """
SELECT column_name, label, CAST(idx AS DOUBLE) AS label_index, count(*) AS listings
FROM all_idx GROUP BY ALL""")

SQL["one_hot"] = with_model(LABELS_CTE + """
SELECT column_name, label, CAST(idx AS DOUBLE) AS label_index, CAST(n AS BIGINT) AS vec_size,
       CAST(CASE WHEN idx < n THEN idx ELSE -1 END AS BIGINT) AS hot_pos, count(*) AS listings
FROM all_idx GROUP BY ALL""")

_NUMS = (["bedroom_num_missing_flag", "toilet_num_missing_flag", "floor_num_missing_flag",
          "livingroom_num_missing_flag"]
         + ["area (m2)", "floor_num", "toilet_num", "livingroom_num", "bedroom_num", "street (m)"])

SQL["standardize"] = with_model(LABELS_CTE + """,
v AS (SELECT * FROM tr WHERE "area (m2)" IS NOT NULL AND floor_num IS NOT NULL AND toilet_num IS NOT NULL
      AND livingroom_num IS NOT NULL AND bedroom_num IS NOT NULL AND "street (m)" IS NOT NULL),
nv AS (SELECT count(*) AS n FROM v),
num AS (""" + " UNION ALL ".join(
    f"""SELECT {i} AS feature_index, avg(CAST("{c}" AS DOUBLE)) AS mean,
       stddev_samp(CAST("{c}" AS DOUBLE)) AS std FROM v""" for i, c in enumerate(_NUMS)) + """),
pos AS (SELECT * FROM (VALUES """ + ", ".join(f"('{c}', {i})" for i, c in enumerate(_CATS)) + """) t(column_name, p)),
offsets AS (SELECT nlab.column_name,
                   10 + coalesce(sum(nlab.n) OVER (ORDER BY pos.p ROWS BETWEEN UNBOUNDED PRECEDING
                                                   AND 1 PRECEDING), 0) AS off
            FROM nlab JOIN pos ON nlab.column_name = pos.column_name),
slot AS (SELECT r.column_name, r.idx, count(vl.label) AS cnt
         FROM ranks r LEFT JOIN (""" + _long_labels("v") + """) vl
           ON r.column_name = vl.column_name AND r.label = vl.label
         GROUP BY ALL),
oh AS (SELECT off + idx AS feature_index, cnt / nv.n AS mean,
              sqrt(cnt * (nv.n - cnt) / (nv.n * (nv.n - 1.0))) AS std
       FROM slot JOIN offsets ON slot.column_name = offsets.column_name, nv)
SELECT CAST(feature_index AS INTEGER) AS feature_index, round(mean, 6) AS mean, round(std, 6) AS std
FROM (SELECT * FROM num UNION ALL SELECT * FROM oh)""")

# --- estimates ---------------------------------------------------------------


def _estimate(requests: str, listings: str) -> str:
    return f"""
, req AS (SELECT listing_id AS request_id, category, district, direction, bedroom_num,
                 CAST("area (m2)" AS DOUBLE) AS area,
                 category IS NOT NULL AND category != '' AS cg,
                 district IS NOT NULL AND district != '' AS dg
          FROM {requests}),
m_cd AS (SELECT category, district, avg(CAST(price_per_m2 AS DOUBLE)) AS a FROM {listings} GROUP BY ALL),
m_c AS (SELECT category, avg(CAST(price_per_m2 AS DOUBLE)) AS a FROM {listings} GROUP BY ALL),
m_d AS (SELECT district, avg(CAST(price_per_m2 AS DOUBLE)) AS a FROM {listings} GROUP BY ALL),
m_all AS (SELECT avg(CAST(price_per_m2 AS DOUBLE)) AS a FROM {listings}),
est0 AS (
  SELECT req.*, coalesce(m_cd.a, m_c.a, m_d.a) AS group_avg,
         CASE WHEN cg AND dg THEN 'category_district' WHEN cg THEN 'category'
              WHEN dg THEN 'district' ELSE 'all' END AS lvl,
         m_all.a AS overall
  FROM req
  LEFT JOIN m_cd ON req.cg AND req.dg AND m_cd.category = req.category AND m_cd.district = req.district
  LEFT JOIN m_c ON req.cg AND NOT req.dg AND m_c.category = req.category
  LEFT JOIN m_d ON req.dg AND NOT req.cg AND m_d.district = req.district
  CROSS JOIN m_all),
est AS (
  SELECT request_id, CASE WHEN group_avg IS NOT NULL THEN lvl ELSE 'all' END AS mean_source,
         coalesce(group_avg, overall) AS mean_price, area,
         ((CASE WHEN bedroom_num >= 3 THEN 1.1::DOUBLE
                WHEN bedroom_num <= 1 AND bedroom_num > 0 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END)
          * (CASE WHEN direction IN ('Đông', 'Nam', 'Đông Nam') THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END))
          * (CASE WHEN area < 50 AND area > 0 THEN 1.1::DOUBLE WHEN area > 100 THEN 0.95::DOUBLE
                  ELSE 1.0::DOUBLE END) AS factor
  FROM est0)"""


SQL["statistical_estimate"] = with_clean(_estimate("clean", "clean") + """
SELECT request_id, mean_source, mean_price,
       CASE WHEN area > 0 AND mean_price IS NOT NULL THEN mean_price * factor ELSE 0.0 END
         AS price_per_m2_est,
       CASE WHEN area > 0 AND mean_price IS NOT NULL THEN (mean_price * factor) * area ELSE 0.0 END
         AS total_est
FROM est""")

SQL["comparables_top5"] = with_clean("""
, l AS (SELECT listing_id, city_province, district, CAST("area (m2)" AS DOUBLE) AS area_m2,
               CAST(price_per_m2 AS DOUBLE) AS price_per_m2, bedroom_num, floor_num, category
        FROM clean WHERE "area (m2)" IS NOT NULL AND district IS NOT NULL),
r AS (SELECT DISTINCT listing_id AS request_id, city_province AS rc, district AS rd,
             CAST("area (m2)" AS DOUBLE) AS ra FROM clean),
p AS (SELECT r.*, l.* FROM r JOIN l
        ON l.city_province = r.rc AND l.district = r.rd
       AND l.area_m2 > r.ra * 0.7::DOUBLE AND l.area_m2 < r.ra * 1.3::DOUBLE
       AND l.listing_id != r.request_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id, rc, rd, ra
                                        ORDER BY listing_id, area_m2, price_per_m2) AS rk FROM p)
SELECT request_id, CAST(rk AS INTEGER) AS rank, listing_id, area_m2, price_per_m2, bedroom_num,
       floor_num, category
FROM ranked WHERE rk <= 5""")


def _text(x: str) -> str:
    fmt = "format('{{:,}}', CAST({} AS BIGINT))"
    f = fmt.format
    return f"""CASE WHEN {x} >= 1000000000 THEN
      CASE WHEN floor(({x} % 1000000000) / 1000000) = 0
           THEN {f(f'floor({x} / 1000000000)')} || ' billion VND'
           ELSE {f(f'floor({x} / 1000000000)')} || ' billion ' || {f(f'floor(({x} % 1000000000) / 1000000)')} || ' million VND' END
    WHEN {x} >= 1000000 THEN
      CASE WHEN floor(({x} % 1000000) / 1000) = 0
           THEN {f(f'floor({x} / 1000000)')} || ' million VND'
           ELSE {f(f'floor({x} / 1000000)')} || ' million ' || {f(f'floor(({x} % 1000000) / 1000)')} || ' thousand VND' END
    WHEN {x} >= 1000 THEN {f(f'floor({x} / 1000)')} || ' thousand VND'
    ELSE {f(x)} || ' VND' END"""


SQL["price_text"] = with_clean("""
, t AS (SELECT listing_id, CAST(round_even(CAST(price_per_m2 AS DOUBLE), 0) AS BIGINT) AS price_per_m2_int,
               CAST("area (m2)" AS DOUBLE) AS area FROM clean WHERE "area (m2)" IS NOT NULL),
u AS (SELECT listing_id, price_per_m2_int,
             CAST(round_even(price_per_m2_int * area, 0) AS BIGINT) AS total_price FROM t)
SELECT listing_id, price_per_m2_int, total_price, """ + _text("total_price") + """ AS total_text FROM u""")

# --- models --------------------------------------------------------------------

SQL["linear_regression"] = with_model("""
SELECT round(regr_slope(price_log, "area (m2)"), 8) AS slope,
       round(regr_intercept(price_log, "area (m2)"), 8) AS intercept
FROM tr WHERE "area (m2)" IS NOT NULL""")

SQL["regression_metrics"] = with_model(_estimate("te", "tr") + """,
pr AS (SELECT est.request_id, est.mean_price AS predicted_price, CAST(te.price_per_m2 AS DOUBLE) AS y
       FROM est JOIN te ON est.request_id = te.listing_id)
SELECT count(*) AS n,
       round(sqrt(sum((y - predicted_price) * (y - predicted_price)) / count(*)), 2) AS rmse,
       round(sum((y - predicted_price) * (y - predicted_price)) / count(*), -4) AS mse,
       round(avg(abs(y - predicted_price)), 2) AS mae,
       round(1.0 - sum((y - predicted_price) * (y - predicted_price)) / (var_pop(y) * count(*)), 8) AS r2
FROM pr""")
