"""Queries for quality (B), cleaning (C) and set operations (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r6, round_to
from ..operators import clean as cl
from ..operators import quality as qa
from ..operators import setops as so
from ..sources import fixtures as fx
from ..sources.tables import read_table
from . import query
from .oracle_views import r, with_views

KEYS = "customer_id, product_id"
DIRTY_COLS = ["order_id", "line_number", "order_date", "sku_id", "category", "city", "customer",
              "channel", "location", "order_qty", "price", "discount_percent", "is_promotional"]
# columns of the canonical demand_history view, in order
DEMAND_COLS = ["order_id", "line_number", "order_date", "sku_id", "product_name", "brand", "category",
               "location", "city", "channel", "customer_id", "customer", "order_qty", "total_demand_qty",
               "revenue", "price", "discount_percent", "is_promotional", "promotional_demand_qty",
               "base_demand_qty", "is_late", "forecast_version_name"]
DIRTY_TYPES = {"order_id": "string", "line_number": "int", "order_date": "date", "sku_id": "string",
               "category": "string", "city": "string", "customer": "string", "channel": "string",
               "location": "string", "order_qty": "double", "price": "double",
               "discount_percent": "double", "is_promotional": "boolean"}


def _dirty(sql):
    return with_views(sql, "dirty_history")


# ------------------------------------------------------------------ B

_ESSENTIAL = ["order_id", "sku_id", "order_date", "order_qty", "revenue", "city"]


@query("structure_check", _dirty("""
SELECT count(*) AS total_rows, 13 AS total_columns, ['revenue'] AS missing_essential,
       1.0 / 6 AS missing_ratio, CAST([] AS VARCHAR[]) AS duplicate_columns,
       (1.0 / 6 <= 0.5) AND count(*) > 0 AS validation_passed
FROM dirty_history"""))
def structure_check(spark, sf_dir):
    return qa.structure_check(fx.dirty_history(spark, sf_dir), _ESSENTIAL)


def _profile_sql(src: str, cols: list[str], types: dict[str, str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{types[c]}' AS data_type, count_if({c} IS NULL) AS n_null, "
        f"count(DISTINCT {c}) AS n_unique FROM {src}" for c in cols)
    return (f"WITH p AS ({parts}), "
            f"d AS (SELECT coalesce(sum(n - 1), 0) AS dups FROM (SELECT count(*) AS n FROM {src} GROUP BY ALL)) "
            f"SELECT p.*, (SELECT count(*) FROM {src}) AS total_rows, "
            f"cast((SELECT dups FROM d) AS BIGINT) AS duplicate_rows FROM p")


_DIRTY_GROUP = "(SELECT " + ", ".join(DIRTY_COLS) + " FROM dirty_history)"


@query("table_profile", _dirty(_profile_sql("dirty_history", DIRTY_COLS, DIRTY_TYPES).replace(
    "FROM dirty_history GROUP BY ALL", "FROM dirty_history GROUP BY " + ", ".join(DIRTY_COLS))))
def table_profile(spark, sf_dir):
    return qa.table_profile(fx.dirty_history(spark, sf_dir))


def _spark_type(expr: str) -> str:
    """DuckDB type name -> Spark ``simpleString`` (for the schema oracles)."""
    return (f"CASE {expr} WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' "
            f"WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower({expr}) END")


def _types_sql(view: str, cols) -> str:
    """(column_name, type) of every listed column, read over the whole view."""
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {_spark_type(f'any_value(typeof({c}))')} AS t "
                              f"FROM {view}" for c in cols)


_TYPE_SCHEMA = {"order_qty": "float", "line_number": "int", "order_date": "datetime",
                "sku_id": "string", "price": "int", "city": "float"}
_ACCEPT_SQL = {"float": "('double', 'float', 'int', 'bigint', 'smallint', 'tinyint')",
               "int": "('int', 'bigint', 'smallint', 'tinyint')",
               "datetime": "('timestamp', 'timestamp_ntz', 'date')", "string": "('string')"}


@query("type_check", _dirty(
    "WITH a AS (" + _types_sql("dirty_history", _TYPE_SCHEMA) + "), "
    "e AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS expected" for c, t in _TYPE_SCHEMA.items())
    + ") SELECT e.column_name, e.expected, a.t AS actual, "
    "CASE e.expected " + " ".join(f"WHEN '{k}' THEN a.t IN {v}" for k, v in _ACCEPT_SQL.items())
    + " ELSE a.t = e.expected END OR (a.t LIKE 'decimal%' AND e.expected = 'float') AS ok "
    "FROM e JOIN a USING (column_name)"))
def type_check(spark, sf_dir):
    return qa.type_check(fx.dirty_history(spark, sf_dir), _TYPE_SCHEMA)


_REQ = ["order_id", "sku_id", "order_date", "order_qty", "city", "customer"]


@query("required_nulls", _dirty(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS null_count, "
    f"{r(f'count_if({c} IS NULL) / count(*)')} AS null_rate, count_if({c} IS NULL) / count(*) > 0.1 AS high_null "
    f"FROM dirty_history" for c in _REQ)))
def required_nulls(spark, sf_dir):
    return qa.required_nulls(fx.dirty_history(spark, sf_dir), _REQ)


@query("schema_drift", with_views(
    "WITH a AS (" + _types_sql("demand_history", DEMAND_COLS) + "), "
    "b AS (" + _types_sql("dirty_history", DIRTY_COLS) + "), "
    "j AS (SELECT coalesce(a.column_name, b.column_name) AS column_name, a.t AS old_type, b.t AS new_type "
    "      FROM a FULL OUTER JOIN b ON a.column_name = b.column_name), "
    "k AS (SELECT *, CASE WHEN old_type IS NULL THEN 'added' WHEN new_type IS NULL THEN 'removed' "
    "                     WHEN old_type <> new_type THEN 'changed' END AS change, "
    "             NOT list_contains(" + "[" + ", ".join(f"'{c}'" for c in DIRTY_COLS[:-1]) + "], column_name) "
    "             AND new_type IS NOT NULL AS unexpected FROM j) "
    "SELECT * FROM k WHERE change IS NOT NULL OR unexpected", "demand_history", "dirty_history"))
def schema_drift(spark, sf_dir):
    return qa.schema_drift(fx.demand_history(spark, sf_dir), fx.dirty_history(spark, sf_dir),
                           expected=DIRTY_COLS[:-1])


_FENCE = """f AS (SELECT quantile_cont(order_qty, 0.25) AS q1, quantile_cont(order_qty, 0.75) AS q3 FROM daily_series),
g AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM f)"""


@query("iqr_outliers", with_views(f"WITH {_FENCE} SELECT d.* FROM daily_series d, g "
                                  "WHERE d.order_qty < g.lo OR d.order_qty > g.hi", "daily_series"))
def iqr_outliers(spark, sf_dir):
    return qa.iqr_outliers(fx.daily_series(spark, sf_dir), "order_qty")


@query("iqr_remove", with_views(f"WITH {_FENCE} SELECT d.* FROM daily_series d, g "
                                "WHERE d.order_qty >= g.lo AND d.order_qty <= g.hi", "daily_series"))
def iqr_remove(spark, sf_dir):
    return qa.iqr_remove(fx.daily_series(spark, sf_dir), "order_qty")


_IQR_COLS = ["order_qty", "revenue", "price"]


@query("iqr_summary", with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, (SELECT count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) "
    f"FROM daily_series) AS n_outliers FROM (SELECT quantile_cont({c}, 0.25) AS q1, "
    f"quantile_cont({c}, 0.75) AS q3 FROM daily_series)" for c in _IQR_COLS), "daily_series"))
def iqr_summary(spark, sf_dir):
    return qa.iqr_summary(fx.daily_series(spark, sf_dir), _IQR_COLS)


_VALID = """
SELECT * FROM dirty_history
WHERE order_id IS NOT NULL AND lower(trim(order_id)) NOT IN ('', 'none', 'nan', '0')
  AND sku_id IS NOT NULL AND lower(trim(sku_id)) NOT IN ('', 'none', 'nan', '0')
  AND order_date IS NOT NULL AND order_qty IS NOT NULL AND order_qty <> 0
  AND city IS NOT NULL AND lower(trim(city)) NOT IN ('', 'none', 'nan')"""


@query("valid_transactions", _dirty(_VALID))
def valid_transactions(spark, sf_dir):
    return qa.valid_transactions(fx.dirty_history(spark, sf_dir))


_PARSE_COLS = ["order_date", "sku_id", "city"]


def _parse_rate_sql() -> str:
    from .source_queries import _DIRTY_TEXT, _PARSED

    def one(c):
        rate = f"avg(CASE WHEN {_PARSED.replace('order_date', c)} IS NOT NULL THEN 1.0 ELSE 0.0 END)"
        return (f"SELECT '{c}' AS column_name, {r(rate)} AS parse_rate, CASE WHEN {rate} < 0.5 THEN 'fail' "
                f"WHEN {rate} < 0.8 THEN 'warn' ELSE 'ok' END AS status FROM dx")
    return _dirty(f"WITH {_DIRTY_TEXT}, dx AS (SELECT {', '.join(f'cast({c} AS VARCHAR) AS {c}' for c in _PARSE_COLS)} FROM dt) "
                  + " UNION ALL ".join(one(c) for c in _PARSE_COLS))


@query("date_parse_rate", _parse_rate_sql())
def date_parse_rate(spark, sf_dir):
    from .source_queries import _dirty_text
    return qa.date_parse_rate(_dirty_text(spark, sf_dir), _PARSE_COLS)


@query("duplicate_key_rate", _dirty(f"""
WITH g AS (SELECT count(*) AS c FROM dirty_history GROUP BY order_id, order_date, line_number)
SELECT sum(c - 1) AS duplicate_count, {r('sum(c - 1) / sum(c)')} AS duplicate_rate,
       sum(c - 1) / sum(c) < 0.15 AS passed FROM g"""))
def duplicate_key_rate(spark, sf_dir):
    return qa.duplicate_key_rate(fx.dirty_history(spark, sf_dir), ["order_id", "order_date", "line_number"])


@query("total_drift", _dirty(f"""
WITH v AS ({_VALID}),
t AS (SELECT (SELECT sum(order_qty) FROM dirty_history) AS b, (SELECT sum(order_qty) FROM v) AS a)
SELECT b AS total_before, a AS total_after,
       {r('CASE WHEN b <> 0 THEN abs(b - a) / abs(b) ELSE 0.0 END')} AS delta,
       CASE WHEN b <> 0 THEN abs(b - a) / abs(b) ELSE 0.0 END < 0.05 AS passed FROM t"""))
def total_drift(spark, sf_dir):
    d = fx.dirty_history(spark, sf_dir)
    return qa.total_drift(d, qa.valid_transactions(d), "order_qty")


@query("date_gaps", with_views(f"""
SELECT {KEYS}, min(ds) AS first, max(ds) AS last, date_diff('day', min(ds), max(ds)) + 1 AS span_days,
       date_diff('day', min(ds), max(ds)) + 1 - count(DISTINCT ds) AS days_missing,
       {r("(date_diff('day', min(ds), max(ds)) + 1 - count(DISTINCT ds)) / (date_diff('day', min(ds), max(ds)) + 1)")} AS missing_rate,
       (date_diff('day', min(ds), max(ds)) + 1 - count(DISTINCT ds)) / (date_diff('day', min(ds), max(ds)) + 1) < 0.2 AS passed
FROM daily_series GROUP BY ALL""", "daily_series"))
def date_gaps(spark, sf_dir):
    return qa.date_gaps(fx.daily_series(spark, sf_dir), ["customer_id", "product_id"], "ds")


@query("key_overlap", with_views("""
WITH a AS (SELECT DISTINCT product_id, customer_id FROM daily_series),
b AS (SELECT DISTINCT product_id, city AS customer_id FROM inventory)
SELECT (SELECT count(*) FROM a) AS left_keys, (SELECT count(*) FROM b) AS right_keys,
       (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS common_keys,
       (SELECT min(ds) FROM daily_series) AS left_start, (SELECT max(ds) FROM daily_series) AS left_end,
       (SELECT min(snapshot_date) FROM inventory) AS right_start,
       (SELECT max(snapshot_date) FROM inventory) AS right_end""", "daily_series", "inventory"))
def key_overlap(spark, sf_dir):
    inv = fx.inventory(spark, sf_dir).withColumnRenamed("city", "customer_id")
    return qa.key_overlap(fx.daily_series(spark, sf_dir), inv, ["product_id", "customer_id"],
                          "ds", "snapshot_date")


_REQUESTS = [("P1", "BUILDING", "NATION_1"), ("P12", "AUTOMOBILE", "NATION_3"),
             ("P99999", "FURNITURE", "NOWHERE"), ("P7", "MACHINERY", "NATION_24"),
             ("xp12", "STALL", "ation_2"), ("0", "MACHINERY", "near NATION_7 and nation_1")]


@query("validate_combinations", with_views("""
WITH req AS (SELECT * FROM (VALUES """ + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _REQUESTS) + """)
             t(r_sku, r_channel, r_location)),
skus AS (SELECT DISTINCT sku_id AS s FROM demand_history),
combo AS (SELECT sku_id AS r_sku, channel AS r_channel, location AS r_location, count(*) AS n,
                 min(order_date) AS first_date, max(order_date) AS last_date,
                 """ + r("avg(total_demand_qty)") + """ AS mean_qty
          FROM demand_history GROUP BY 1, 2, 3),
sim AS (SELECT r_sku, string_agg(s, '|' ORDER BY s) AS similar_skus FROM (
          SELECT r_sku, s, row_number() OVER (PARTITION BY r_sku ORDER BY s) AS rn
          FROM (SELECT DISTINCT r_sku FROM req) q JOIN skus
            ON s <> r_sku AND (contains(lower(s), lower(r_sku)) OR contains(lower(r_sku), lower(s))))
        WHERE rn <= 3 GROUP BY r_sku),
m AS (SELECT DISTINCT 'P' || cast(p_partkey AS VARCHAR) AS r_sku FROM part),
locs AS (SELECT DISTINCT location AS l FROM demand_history),
places AS (SELECT r_location, string_agg(l, '|' ORDER BY l) AS similar_locations FROM (
             SELECT r_location, l, row_number() OVER (PARTITION BY r_location ORDER BY l) AS rn
             FROM (SELECT DISTINCT r_location FROM req WHERE r_location NOT IN (SELECT l FROM locs)) q JOIN locs
               ON contains(lower(l), lower(r_location)) OR contains(lower(r_location), lower(l)))
           WHERE rn <= 3 GROUP BY r_location),
res AS (
SELECT req.r_sku, req.r_channel, req.r_location,
       req.r_sku IN (SELECT s FROM skus) AS sku_exists,
       req.r_channel IN (SELECT channel FROM demand_history) AS channel_exists,
       req.r_location IN (SELECT location FROM demand_history) AS location_exists,
       coalesce(combo.n, 0) AS combination_rows, combo.first_date, combo.last_date, combo.mean_qty,
       combo.n IS NOT NULL AS combination_exists, sim.similar_skus, places.similar_locations,
       req.r_sku IN (SELECT r_sku FROM m) AS in_master
FROM req LEFT JOIN combo USING (r_sku, r_channel, r_location) LEFT JOIN sim USING (r_sku) LEFT JOIN places USING (r_location))
SELECT *, CASE WHEN NOT channel_exists THEN (SELECT string_agg(c, '|' ORDER BY c) FROM (SELECT DISTINCT channel AS c FROM demand_history)) END
            AS available_channels,
       concat_ws('|', CASE WHEN NOT sku_exists THEN 'SKU ' || r_sku || ' not found in historical data' END,
                 CASE WHEN NOT location_exists THEN 'Location ' || r_location || ' not found in historical data' END,
                 CASE WHEN NOT channel_exists THEN 'Channel ' || r_channel || ' not found in historical data' END,
                 CASE WHEN NOT combination_exists THEN 'No historical data for exact combination: SKU=' || r_sku || ', Channel=' || r_channel
                                                       || ', Location=' || r_location END,
                 CASE WHEN NOT in_master THEN 'SKU ' || r_sku || ' not found in master catalog' END) AS warnings
FROM res""",
    "demand_history"))
def validate_combinations(spark, sf_dir):
    req = spark.createDataFrame(_REQUESTS, "sku_id string, channel string, location string")
    master = read_table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("sku_id"))
    return qa.validate_combinations(req, fx.demand_history(spark, sf_dir), master)


def _structure_sql() -> str:
    prof = _profile_sql("dirty_history", DIRTY_COLS, DIRTY_TYPES).replace(
        "FROM dirty_history GROUP BY ALL", "FROM dirty_history GROUP BY " + ", ".join(DIRTY_COLS))
    hint = lambda hs: " OR ".join(f"contains(lower(column_name), '{h}')" for h in hs)
    return _dirty(f"""
WITH pr AS ({prof})
SELECT column_name, data_type, n_unique, n_null,
       floor(n_null * 100.0 / total_rows * 100 + 0.5) / 100 AS null_percentage,
       CASE WHEN {hint(qa.DATE_HINTS_STRUCTURE)} THEN 'date'
            WHEN {hint(qa.METRIC_HINTS_STRUCTURE)} THEN 'metric'
            WHEN n_unique / total_rows < 0.5 THEN 'categorical' ELSE 'identifier' END AS category,
       CASE WHEN NOT ({hint(qa.DATE_HINTS_STRUCTURE)}) AND NOT ({hint(qa.METRIC_HINTS_STRUCTURE)})
                 AND n_unique / total_rows < 0.5
            THEN CASE WHEN n_unique / total_rows < 0.05 THEN 'high' ELSE 'medium' END END AS filter_priority,
       duplicate_rows
FROM pr""")


@query("dataset_structure", _structure_sql())
def dataset_structure(spark, sf_dir):
    return qa.dataset_structure(fx.dirty_history(spark, sf_dir))


def _filters_sql() -> str:
    prof = _profile_sql("dirty_history", DIRTY_COLS, DIRTY_TYPES).replace(
        "FROM dirty_history GROUP BY ALL", "FROM dirty_history GROUP BY " + ", ".join(DIRTY_COLS))
    bad = " OR ".join(f"contains(lower(column_name), '{h}')"
                      for h in qa.METRIC_HINTS_FILTER + qa.DATE_HINTS_FILTER)
    return _dirty(f"""
WITH pr AS ({prof})
SELECT column_name, n_unique AS unique_count, data_type FROM pr
WHERE NOT ({bad}) AND n_unique > 1 AND n_unique <= least(1000.0, total_rows * 0.5)""")


@query("detect_filters", _filters_sql())
def detect_filters(spark, sf_dir):
    return qa.detect_filters(fx.dirty_history(spark, sf_dir))


@query("date_profile", _dirty("""
SELECT 'order_date' AS column_name, min(order_date) AS min_date, max(order_date) AS max_date,
       count_if(order_date IS NULL) AS null_count,
       coalesce(date_diff('day', min(order_date), max(order_date)), 0) AS total_days
FROM dirty_history"""))
def date_profile(spark, sf_dir):
    return qa.date_profile(fx.dirty_history(spark, sf_dir))


@query("training_ready", with_views(f"""
SELECT {KEYS}, count(*) AS rows, count(DISTINCT coalesce(order_qty, 0.0)) AS n_unique,
       coalesce(stddev_samp(coalesce(order_qty, 0.0)), 0) > 0 AS has_variance,
       coalesce(stddev_samp(coalesce(order_qty, 0.0)), 0) > 0 AND count(DISTINCT coalesce(order_qty, 0.0)) >= 5 AS ready
FROM daily_series GROUP BY ALL""", "daily_series"))
def training_ready(spark, sf_dir):
    return qa.training_ready(fx.daily_series(spark, sf_dir), ["customer_id", "product_id"], "order_qty")


@query("data_presence", with_views("""
SELECT count(*) AS total_rows, min(order_date) AS start_date, max(order_date) AS end_date,
       count_if(channel = 'BUILDING') AS rows_channel, count_if(location = 'NATION_1') AS rows_location,
       (SELECT string_agg(sku_id, '|' ORDER BY sku_id) FROM
          (SELECT DISTINCT sku_id FROM demand_history ORDER BY sku_id LIMIT 10)) AS first_keys
FROM demand_history""", "demand_history"))
def data_presence(spark, sf_dir):
    return qa.data_presence(fx.demand_history(spark, sf_dir), "sku_id", "order_date",
                            {"channel": "BUILDING", "location": "NATION_1"})


# ------------------------------------------------------------------ C

def _hash_sql(cols):
    return "md5(concat_ws('|', " + ", ".join(f"coalesce(cast({c} AS VARCHAR), '')" for c in cols) + "))"


def _missing(c):
    return f"({c} IS NULL OR lower(trim(cast({c} AS VARCHAR))) IN ('', 'none', 'nan', '0'))"


@query("impute_ids", _dirty(f"""
SELECT * REPLACE (
  CASE WHEN {_missing('order_id')} THEN {_hash_sql(DIRTY_COLS)} ELSE order_id END AS order_id,
  CASE WHEN {_missing('sku_id')} THEN 'unknown_sku_' || substr({_hash_sql(DIRTY_COLS)}, 1, 8) ELSE sku_id END AS sku_id)
FROM dirty_history"""))
def impute_ids(spark, sf_dir):
    return cl.impute_ids(fx.dirty_history(spark, sf_dir))


@query("impute_median_date", _dirty("""
SELECT * REPLACE (coalesce(order_date, (SELECT DATE '1970-01-01' + cast(floor(quantile_cont(
    date_diff('day', DATE '1970-01-01', order_date), 0.5)) AS INTEGER) FROM dirty_history)) AS order_date)
FROM dirty_history"""))
def impute_median_date(spark, sf_dir):
    return cl.impute_median_date(fx.dirty_history(spark, sf_dir))


def _mode_sql(c):
    return (f"(SELECT {c} FROM (SELECT cast({c} AS VARCHAR) AS {c}, count(*) AS n FROM dirty_history "
            f"WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, {c} LIMIT 1)")


@query("impute_mode", _dirty(f"""
SELECT * REPLACE (coalesce(category, {_mode_sql('category')}, 'Unknown') AS category,
                  coalesce(customer, {_mode_sql('customer')}, 'Unknown') AS customer)
FROM dirty_history"""))
def impute_mode(spark, sf_dir):
    return cl.impute_mode(fx.dirty_history(spark, sf_dir), ["category", "customer"])


@query("impute_constant", _dirty("""
SELECT * REPLACE (coalesce(customer, 'anonymous') AS customer,
                  coalesce(try_cast(order_qty AS DOUBLE), 0.0) AS order_qty,
                  coalesce(try_cast(price AS DOUBLE), 0.0) AS price)
FROM dirty_history"""))
def impute_constant(spark, sf_dir):
    return cl.impute_constant(fx.dirty_history(spark, sf_dir), {"customer": "anonymous"},
                              ["order_qty", "price"])


@query("impute_median", _dirty("""
SELECT * REPLACE (coalesce(order_qty, (SELECT quantile_cont(order_qty, 0.5) FROM dirty_history), 0.0) AS order_qty,
                  coalesce(price, (SELECT quantile_cont(price, 0.5) FROM dirty_history), 0.0) AS price)
FROM dirty_history"""))
def impute_median(spark, sf_dir):
    return cl.impute_median(fx.dirty_history(spark, sf_dir), ["order_qty", "price"])


@query("dedupe_rows", _dirty("SELECT DISTINCT * FROM dirty_history"))
def dedupe_rows(spark, sf_dir):
    return cl.dedupe_rows(fx.dirty_history(spark, sf_dir))


@query("label_encode", with_views("""
WITH c AS (SELECT city AS v, dense_rank() OVER (ORDER BY city) - 1 AS code FROM (SELECT DISTINCT city FROM demand_history WHERE city IS NOT NULL)),
t AS (SELECT category AS v, dense_rank() OVER (ORDER BY category) - 1 AS code FROM (SELECT DISTINCT category FROM demand_history WHERE category IS NOT NULL))
SELECT d.*, cast(c.code AS INTEGER) AS city_enc, cast(t.code AS INTEGER) AS category_enc
FROM demand_history d LEFT JOIN c ON d.city = c.v LEFT JOIN t ON d.category = t.v""", "demand_history"))
def label_encode(spark, sf_dir):
    return cl.label_encode(fx.demand_history(spark, sf_dir), ["city", "category"])[0]


def _scale_sql(kind: str) -> str:
    cols = ["order_qty", "revenue"]
    if kind == "MinMax":
        exprs = [f"CASE WHEN max({c}) OVER () - min({c}) OVER () = 0 THEN 0.0 ELSE "
                 f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END" for c in cols]
    else:
        exprs = [f"CASE WHEN stddev_pop({c}) OVER () = 0 THEN 0.0 ELSE "
                 f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () END" for c in cols]
    sel = ", ".join(f"{r(e)} AS {c}_{kind}" for e, c in zip(exprs, cols))
    return with_views(f"SELECT *, {sel} FROM daily_series", "daily_series")


@query("scale_minmax", _scale_sql("MinMax"))
def scale_minmax(spark, sf_dir):
    out = cl.scale_minmax(fx.daily_series(spark, sf_dir), ["order_qty", "revenue"])
    return out.withColumns({c: r6(c) for c in ("order_qty_MinMax", "revenue_MinMax")})


@query("scale_standard", _scale_sql("Standard"))
def scale_standard(spark, sf_dir):
    out = cl.scale_standard(fx.daily_series(spark, sf_dir), ["order_qty", "revenue"])
    return out.withColumns({c: r6(c) for c in ("order_qty_Standard", "revenue_Standard")})


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("one_hot", with_views("""
WITH daily_sku AS (SELECT sku_id, channel, order_date, sum(total_demand_qty) AS qty
                   FROM demand_history GROUP BY ALL),
codes AS (SELECT v, cast(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code
          FROM (SELECT DISTINCT sku_id AS v FROM daily_sku))
SELECT d.* EXCLUDE (channel, sku_id), """ + ", ".join(
    f"cast(channel = '{s}' AS INTEGER) AS channel_{s}" for s in _SEGMENTS[1:]) + """, codes.code AS sku_id
FROM daily_sku d LEFT JOIN codes ON d.sku_id = codes.v""", "demand_history"))
def one_hot(spark, sf_dir):
    d = (fx.demand_history(spark, sf_dir).groupBy("sku_id", "channel", "order_date")
         .agg(F.sum("total_demand_qty").alias("qty")))
    return cl.one_hot(d, ["channel"], codes=["sku_id"], levels={"channel": _SEGMENTS})


@query("date_to_epoch", with_views("""
SELECT * REPLACE (cast(epoch(cast(ds AS TIMESTAMP)) AS BIGINT) AS ds,
                  coalesce(price, -1) AS price, coalesce(discount_percent, -1) AS discount_percent)
FROM daily_series_dense""", "daily_series_dense"))
def date_to_epoch(spark, sf_dir):
    return cl.date_to_epoch(fx.daily_series_dense(spark, sf_dir))


@query("canonical_ids", with_views("""
SELECT lower(trim(left_id)) AS left_text,
       regexp_replace(regexp_replace(lower(trim(left_id)), '[^0-9a-z]', '', 'g'), '^0+', '') AS left_canon
FROM ids_left""", "ids_left"))
def canonical_ids(spark, sf_dir):
    x = fx.ids_left(spark, sf_dir).select(F.col("left_id").alias("left_text"),
                                          F.col("left_id").alias("left_canon"))
    return cl.canonical_ids(x, text_cols=["left_text"], id_cols=["left_canon"])


@query("safe_float", _dirty("""
SELECT order_id, line_number,
       CASE WHEN try_cast(order_id AS DOUBLE) IS NULL OR isnan(try_cast(order_id AS DOUBLE))
                 OR isinf(try_cast(order_id AS DOUBLE)) THEN 0.0 ELSE try_cast(order_id AS DOUBLE) END AS order_id_num,
       CASE WHEN price IS NULL OR isnan(price) OR isinf(price) THEN 0.0 ELSE price END AS price_num
FROM dirty_history"""))
def safe_float(spark, sf_dir):
    from ..functions.columns import safe_float as sf
    d = fx.dirty_history(spark, sf_dir)
    return d.select("order_id", "line_number", sf("order_id").alias("order_id_num"),
                    sf("price").alias("price_num"))


@query("format_dates", with_views("""
SELECT * REPLACE (strftime(ds, '%Y-%m-%d') AS ds) FROM daily_series""", "daily_series"))
def format_dates(spark, sf_dir):
    return cl.format_dates(fx.daily_series(spark, sf_dir), as_json=False)


@query("calendar_features", with_views("""
SELECT *, year(ds) AS order_year, month(ds) AS order_month, day(ds) AS order_day,
       isodow(ds) - 1 AS order_day_of_week, quarter(ds) AS quarter,
       cast(day(ds) = 1 AS INTEGER) AS is_month_start, cast(ds = last_day(ds) AS INTEGER) AS is_month_end,
       cast(isodow(ds) - 1 >= 5 AS INTEGER) AS is_weekend
FROM daily_series""", "daily_series"))
def calendar_features(spark, sf_dir):
    return cl.calendar_features(fx.daily_series(spark, sf_dir), "ds")


@query("cyclical_features", with_views("SELECT *, " + ", ".join(
    f"{r(f'sin({num} * 6.283185307179586 / {den})', 9)} AS {n}_sin, "
    f"{r(f'cos({num} * 6.283185307179586 / {den})', 9)} AS {n}_cos"
    for n, num, den in (("month", "month(ds)", "12.0"), ("dow", "(isodow(ds) - 1)", "7.0"),
                        ("day", "day(ds)", "31.0"))) + " FROM daily_series", "daily_series"))
def cyclical_features(spark, sf_dir):
    return cl.cyclical_features(fx.daily_series(spark, sf_dir), "ds")


def _contains_case(col: str) -> str:
    parts = []
    for brand, frags in cl.BRAND_CONTAINS:
        cond = " OR ".join(f"contains(upper({col}), '{f}')" for f in frags)
        parts.append(f"WHEN {cond} THEN '{brand}'")
    return "CASE " + " ".join(parts) + " ELSE 'Other' END"


#: SKUs whose names carry a brand: every known prefix and fragment in turn, a fifth of them none.
_MARKS = [*cl.BRAND_PREFIX, *(f for _, fragments in cl.BRAND_CONTAINS for f in fragments), "zz", "q-", ""]


@query("brand_from_sku", with_views(f"""
WITH s AS (SELECT DISTINCT sku_id, CAST(substr(sku_id, 2) AS BIGINT) AS i FROM demand_history),
m AS (SELECT sku_id, [{", ".join(f"'{m}'" for m in _MARKS)}][1 + i % {len(_MARKS)}] AS mark, i FROM s),
n AS (SELECT sku_id AS id, CASE WHEN i % 2 = 0 THEN mark || sku_id ELSE sku_id || lower(mark) END AS sku_id FROM m)
SELECT id, sku_id, coalesce(CASE substr(sku_id, 1, 3) """ + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in cl.BRAND_PREFIX.items()) + f""" END, 'Other') AS brand,
       {_contains_case('sku_id')} AS brand_contains
FROM n""", "demand_history"))
def brand_from_sku(spark, sf_dir):
    i = F.substring("sku_id", 2, 20).cast("long")
    mark = F.element_at(F.array(*[F.lit(m) for m in _MARKS]), (F.lit(1) + i % len(_MARKS)).cast("int"))
    d = (fx.demand_history(spark, sf_dir).select("sku_id").distinct()
         .select(F.col("sku_id").alias("id"), F.when(i % 2 == 0, F.concat(mark, "sku_id")).otherwise(F.concat("sku_id", F.lower(mark))).alias("sku_id")))
    a = cl.brand_from_sku(d, "sku_id", "prefix")
    b = cl.brand_from_sku(d, "sku_id", "contains").select("id", F.col("brand").alias("brand_contains"))
    return a.join(b, "id")


@query("row_keys", with_views("""
SELECT *, concat_ws('_', sku_id, location, channel, strftime(order_date, '%Y%m%d')) AS forecast_id,
       concat_ws('_', sku_id, location, channel) AS series_id
FROM demand_history""", "demand_history"))
def row_keys(spark, sf_dir):
    return cl.row_keys(fx.demand_history(spark, sf_dir))


# ------------------------------------------------------------------ K

@query("union_rows", with_views("""
SELECT * FROM (SELECT order_id, sku_id, order_date, order_qty, revenue FROM demand_history)
UNION ALL BY NAME
SELECT * FROM (SELECT order_id, sku_id, order_date, order_qty, city FROM dirty_history)""",
    "demand_history", "dirty_history"))
def union_rows(spark, sf_dir):
    a = fx.demand_history(spark, sf_dir).select("order_id", "sku_id", "order_date", "order_qty",
                                                "revenue")
    b = fx.dirty_history(spark, sf_dir).select("order_id", "sku_id", "order_date", "order_qty", "city")
    return so.union_rows(a, b)


@query("intersect_keys", with_views("""
SELECT product_id, customer_id FROM daily_series
INTERSECT SELECT product_id, city AS customer_id FROM inventory""", "daily_series", "inventory"))
def intersect_keys(spark, sf_dir):
    inv = fx.inventory(spark, sf_dir).withColumnRenamed("city", "customer_id")
    return so.intersect_keys(fx.daily_series(spark, sf_dir), inv, ["product_id", "customer_id"])


@query("except_keys", with_views("""
SELECT cast(unnest(generate_series((SELECT min(order_date) FROM demand_history),
                                   (SELECT max(order_date) FROM demand_history), INTERVAL 1 DAY)) AS DATE) AS order_date
EXCEPT SELECT order_date FROM demand_history""", "demand_history"))
def except_keys(spark, sf_dir):
    d = fx.demand_history(spark, sf_dir)
    lo = d.agg(F.min("order_date")).scalar()
    hi = d.agg(F.max("order_date")).scalar()
    cal = d.agg(F.count(F.lit(1)).alias("_n")).select(F.explode(F.sequence(lo, hi)).alias("order_date"))
    return so.except_keys(cal, d, ["order_date"])
