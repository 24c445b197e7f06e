"""Queries for the join operators (D01-D16) and the supply position."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import features as fe
from ..operators import joins as jn
from ..sources import fixtures as fx
from ..sources.tables import read_table
from . import query
from .oracle_views import r, with_views

KEYS = "customer_id, product_id"


def _canon(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower(trim({x})), '[^0-9a-z]', '', 'g'), '^0+', '')"


_XW = f"""
a AS (SELECT DISTINCT left_id AS orders_product_id_raw, {_canon('left_id')} AS canon_orders_pid
      FROM ids_left WHERE left_id IS NOT NULL),
b AS (SELECT DISTINCT right_id AS inv_product_id_raw, {_canon('right_id')} AS canon_inv_pid
      FROM ids_right WHERE right_id IS NOT NULL),
ex AS (SELECT a.*, b.*, 'exact_canonical' AS method, 1.0 AS score
       FROM a JOIN b ON a.canon_orders_pid = b.canon_inv_pid)"""


@query("crosswalk_exact", with_views(f"WITH {_XW} SELECT * FROM ex", "ids_left", "ids_right"))
def crosswalk_exact(spark, sf_dir):
    return jn.crosswalk_exact(fx.ids_left(spark, sf_dir), fx.ids_right(spark, sf_dir))


@query("crosswalk_unmatched", with_views(
    f"WITH {_XW} SELECT * FROM a WHERE canon_orders_pid NOT IN (SELECT canon_orders_pid FROM ex)",
    "ids_left", "ids_right"))
def crosswalk_unmatched(spark, sf_dir):
    left = fx.ids_left(spark, sf_dir)
    exact = jn.crosswalk_exact(left, fx.ids_right(spark, sf_dir))
    return jn.crosswalk_unmatched(left, exact)


#: Longest common substring of x and y as length * 10000 + (9999 - place in x): the longest, of equals the first.
_BLOCK = """list_max([len([n for n in range(1, length(x) - i + 2) if contains(y, substr(x, i, n))]) * 10000 + (9999 - i)
                   for i in range(1, length(x) + 1)])"""
_FUZZY = f"""{_XW},
rest AS (SELECT * FROM a WHERE canon_orders_pid NOT IN (SELECT canon_orders_pid FROM ex)),
part AS (
  SELECT p, q, p AS x, q AS y, {_BLOCK} AS m
  FROM (SELECT DISTINCT canon_orders_pid AS p, canon_orders_pid AS x FROM rest WHERE canon_orders_pid <> '') l
  JOIN (SELECT DISTINCT canon_inv_pid AS q, canon_inv_pid AS y FROM b WHERE canon_inv_pid <> '') r
    ON 100 * 2 * least(length(p), length(q)) >= 92 * (length(p) + length(q))
  UNION ALL
  SELECT p, q, x, y, {_BLOCK} AS m
  FROM (SELECT p, q, CASE side WHEN 0 THEN substr(x, 1, i - 1) ELSE substr(x, i + n) END AS x,
               CASE side WHEN 0 THEN substr(y, 1, j - 1) ELSE substr(y, j + n) END AS y
        FROM (SELECT p, q, x, y, i, n, strpos(y, substr(x, i, n)) AS j, unnest([0, 1]) AS side
              FROM (SELECT p, q, x, y, 9999 - m % 10000 AS i, m // 10000 AS n FROM part WHERE m >= 10000) u) v) w
  WHERE length(x) > 0 AND length(y) > 0
),
scored AS (SELECT p, q, CAST(2 * sum(m // 10000) AS DOUBLE) / (length(p) + length(q)) AS score FROM part GROUP BY p, q),
top AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY score DESC, q) AS n FROM scored WHERE score >= 0.92),
fz AS (
  SELECT rest.orders_product_id_raw, top.p AS canon_orders_pid, inv_product_id_raw, top.q AS canon_inv_pid, 'fuzzy_92' AS method, score
  FROM rest JOIN top ON rest.canon_orders_pid = top.p AND top.n = 1
  JOIN (SELECT canon_inv_pid, min(inv_product_id_raw) AS inv_product_id_raw FROM b GROUP BY 1) c ON c.canon_inv_pid = top.q
)"""
_BEST = f"""{_FUZZY},
best AS (
  SELECT orders_product_id_raw, inv_product_id_raw, canon_orders_pid, canon_inv_pid, method, score FROM (
    SELECT *, row_number() OVER (PARTITION BY canon_orders_pid ORDER BY score DESC, orders_product_id_raw, inv_product_id_raw) AS n
    FROM (SELECT orders_product_id_raw, canon_orders_pid, inv_product_id_raw, canon_inv_pid, method, CAST(score AS DOUBLE) AS score FROM ex
          UNION ALL SELECT orders_product_id_raw, canon_orders_pid, inv_product_id_raw, canon_inv_pid, method, score FROM fz) u) v
  WHERE n = 1
)"""


@query("crosswalk_fuzzy", with_views(f"WITH RECURSIVE {_FUZZY} SELECT * FROM fz", "ids_left", "ids_right"))
def crosswalk_fuzzy(spark, sf_dir):
    left, right = fx.ids_left(spark, sf_dir), fx.ids_right(spark, sf_dir)
    rest = jn.crosswalk_unmatched(left, jn.crosswalk_exact(left, right))
    return jn.crosswalk_fuzzy(rest, right)


@query("crosswalk_best", with_views(f"WITH RECURSIVE {_BEST} SELECT * FROM best", "ids_left", "ids_right"))
def crosswalk_best(spark, sf_dir):
    return jn.build_crosswalk(fx.ids_left(spark, sf_dir), fx.ids_right(spark, sf_dir))


@query("apply_crosswalk", with_views(f"""
WITH RECURSIVE {_BEST}
SELECT left_id, coalesce(canon_inv_pid, {_canon('left_id')}) AS product_id
FROM ids_left LEFT JOIN best ON best.canon_orders_pid = {_canon('left_id')}""", "ids_left", "ids_right"))
def apply_crosswalk(spark, sf_dir):
    cw = jn.build_crosswalk(fx.ids_left(spark, sf_dir), fx.ids_right(spark, sf_dir))
    left = fx.ids_left(spark, sf_dir).withColumn("product_id", F.col("left_id"))
    return jn.apply_crosswalk(left, cw, "product_id")


@query("apply_city_crosswalk", """
WITH cw AS (SELECT ' ' || n_name AS orders_city, 'Store ' || n_regionkey || '-' || n_name AS inv_city FROM nation WHERE n_nationkey % 3 <> 0)
SELECT c_custkey, coalesce(lower(trim(inv_city)), lower(trim(n_name))) AS city
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN cw ON lower(trim(orders_city)) = lower(trim(n_name))""")
def apply_city_crosswalk(spark, sf_dir):
    nation = read_table(spark, sf_dir, "nation")
    cw = nation.where("n_nationkey % 3 <> 0").select(
        F.concat(F.lit(" "), "n_name").alias("orders_city"), F.concat(F.lit("Store "), "n_regionkey", F.lit("-"), "n_name").alias("inv_city"))
    cities = (read_table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
              .select("c_custkey", F.concat("n_name", F.lit(" ")).alias("city")))
    return jn.apply_city_crosswalk(cities, cw)


# ---- as-of joins: daily series (product, nation) to monthly inventory (product, nation)

def _inv(spark, sf_dir):
    return fx.inventory(spark, sf_dir)


def _asof_sql(keys_on: str, right: str = "inventory", payload: str = "warehouse_inventory_qty") -> str:
    return f"""
SELECT s.*, CASE WHEN s.ds - r.snapshot_date <= 90 THEN r.snapshot_date END AS snapshot_date,
       CASE WHEN s.ds - r.snapshot_date <= 90 THEN r.{payload} END AS {payload}
FROM daily_series s ASOF LEFT JOIN {right} r ON {keys_on} AND s.ds >= r.snapshot_date"""


def _some_null_keys(df, day, key):
    """The rows with the key missing on the 13th day (left) or in February (right)."""
    return df.withColumn(key, F.when(day, F.lit(None)).otherwise(F.col(key)))


_NULL_KEYS = """
ln AS (SELECT * REPLACE (CASE WHEN day(ds) = 13 THEN NULL ELSE product_id END AS product_id) FROM daily_series),
rn AS (SELECT * REPLACE (CASE WHEN month(snapshot_date) = 2 THEN NULL ELSE product_id END AS product_id) FROM inventory)"""


@query("asof_join", with_views(f"WITH {_NULL_KEYS}" + _asof_sql(
    "s.product_id = r.product_id AND s.customer_id = r.city", "rn").replace("FROM daily_series", "FROM ln"),
    "daily_series", "inventory"))
def asof_join(spark, sf_dir):
    left = _some_null_keys(fx.daily_series(spark, sf_dir), F.dayofmonth("ds") == 13, "product_id")
    right = _some_null_keys(_inv(spark, sf_dir), F.month("snapshot_date") == 2, "product_id")
    return jn.asof_join(left, right,
                        ["product_id", "customer_id"], ["product_id", "city"], "ds", "snapshot_date", 90,
                        left_unique=True)


_CANDS = [(["product_id", "customer_id"], ["product_id", "city"]), (["product_id"], ["product_id"])]
_INV_P = ("inv_p AS (SELECT product_id, snapshot_date, sum(warehouse_inventory_qty) AS warehouse_inventory_qty "
          "FROM inventory GROUP BY 1, 2)")


@query("asof_cascade", with_views(f"""
WITH {_INV_P},
j1 AS ({_asof_sql("s.product_id = r.product_id AND s.customer_id = r.city")}),
j2 AS ({_asof_sql("s.product_id = r.product_id", "inv_p")}),
r1 AS (SELECT avg(CASE WHEN warehouse_inventory_qty IS NOT NULL THEN 1.0 ELSE 0.0 END) AS v FROM j1),
r2 AS (SELECT avg(CASE WHEN warehouse_inventory_qty IS NOT NULL THEN 1.0 ELSE 0.0 END) AS v FROM j2)
SELECT * FROM j1 WHERE (SELECT v FROM r1) >= (SELECT v FROM r2)
UNION ALL
SELECT * FROM j2 WHERE (SELECT v FROM r2) > (SELECT v FROM r1)""", "daily_series", "inventory"))
def asof_cascade(spark, sf_dir):
    return jn.asof_cascade(fx.daily_series(spark, sf_dir), _inv(spark, sf_dir), _CANDS,
                           payload=["warehouse_inventory_qty"])


@query("asof_coalesce", with_views(f"""
WITH {_INV_P},
j1 AS ({_asof_sql("s.product_id = r.product_id AND s.customer_id = r.city")}),
j2 AS ({_asof_sql("s.product_id = r.product_id", "inv_p")})
SELECT j1.* EXCLUDE (snapshot_date, warehouse_inventory_qty),
       coalesce(j1.warehouse_inventory_qty, j2.warehouse_inventory_qty) AS warehouse_inventory_qty
FROM j1 JOIN j2 USING ({KEYS}, ds)""", "daily_series", "inventory"))
def asof_coalesce(spark, sf_dir):
    return jn.asof_coalesce(fx.daily_series(spark, sf_dir), _inv(spark, sf_dir), _CANDS,
                            payload=["warehouse_inventory_qty"])


def _inv_dates(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    return inv.select("*", F.date_add("snapshot_date", 3650).alias("updated_at"),
                      F.date_sub("snapshot_date", 30).alias("effective_date"))


@query("overlap_guard", with_views(f"""
WITH inv AS (SELECT *, snapshot_date + 3650 AS updated_at, snapshot_date - 30 AS effective_date FROM inventory),
lo AS (SELECT min(ds) AS lo, max(ds) AS hi FROM daily_series),
c AS (
  SELECT 'snapshot_date' AS column_name, avg(CASE WHEN coalesce(snapshot_date BETWEEN lo AND hi, false) THEN 1.0 ELSE 0.0 END) AS within,
         count(snapshot_date) AS non_null, 0.1 AS bonus FROM inv, lo
  UNION ALL
  SELECT 'updated_at', avg(CASE WHEN coalesce(updated_at BETWEEN lo AND hi, false) THEN 1.0 ELSE 0.0 END),
         count(updated_at), 0.0 FROM inv, lo
  UNION ALL
  SELECT 'effective_date', avg(CASE WHEN coalesce(effective_date BETWEEN lo AND hi, false) THEN 1.0 ELSE 0.0 END),
         count(effective_date), 0.1 FROM inv, lo),
s AS (SELECT column_name, within, non_null, within + bonus AS score FROM c WHERE non_null > 0),
best AS (SELECT column_name, within FROM s ORDER BY score DESC, column_name LIMIT 1)
SELECT s.column_name, s.within, s.non_null, s.score,
       s.column_name = (SELECT column_name FROM best) AND (SELECT within FROM best) > 0 AS is_chosen
FROM s""", "daily_series", "inventory"))
def overlap_guard(spark, sf_dir):
    return jn.overlap_guard(_inv_dates(spark, sf_dir), fx.daily_series(spark, sf_dir))


@query("static_median_join", with_views("""
WITH m AS (SELECT product_id, city, quantile_cont(warehouse_inventory_qty, 0.5) AS warehouse_inventory_qty_static
           FROM inventory GROUP BY 1, 2)
SELECT s.*, m.warehouse_inventory_qty_static FROM daily_series s
LEFT JOIN m ON s.product_id = m.product_id AND s.customer_id = m.city""", "daily_series", "inventory"))
def static_median_join(spark, sf_dir):
    return jn.static_median_join(fx.daily_series(spark, sf_dir), _inv(spark, sf_dir),
                                 ["product_id", "customer_id"], ["product_id", "city"],
                                 ["warehouse_inventory_qty"])


_PROMO_DAYS = """
pd AS (SELECT lower(trim(product_id)) AS pk,
              cast(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS day,
              coalesce(cast(discount AS DOUBLE), 0.0) AS disc
       FROM promo_calendar WHERE start_date IS NOT NULL AND end_date IS NOT NULL),
pm AS (SELECT pk, day, max(disc) AS disc FROM pd GROUP BY 1, 2)"""


@query("promo_range_join", with_views(f"""
WITH {_PROMO_DAYS}
SELECT s.*, coalesce(pm.disc, 0.0) AS disc_pct, cast(coalesce(pm.disc, 0.0) > 0 AS INTEGER) AS is_promo_day
FROM daily_series s LEFT JOIN pm ON lower(trim(s.product_id)) = pm.pk AND s.ds = pm.day""",
    "daily_series", "promo_calendar"))
def promo_range_join(spark, sf_dir):
    return jn.promo_join(fx.daily_series(spark, sf_dir), fx.promo_calendar(spark, sf_dir))


@query("active_promotions", with_views("""
WITH d AS (SELECT lower(trim(product_id)) AS pk, promo_id, start_date, end_date, discount,
                  cast(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS day
           FROM promo_calendar)
SELECT s.*, d.promo_id, d.start_date, d.end_date, d.discount FROM daily_series s
JOIN d ON lower(trim(s.product_id)) = d.pk AND s.ds = d.day""", "daily_series", "promo_calendar"))
def active_promotions(spark, sf_dir):
    return jn.active_promotions(fx.daily_series(spark, sf_dir), fx.promo_calendar(spark, sf_dir))


_GRID = f"""
mx AS (SELECT max(ds) AS m FROM daily_series),
c AS (SELECT DISTINCT {KEYS} FROM daily_series WHERE ds > (SELECT m FROM mx) - 28),
g AS (SELECT c.*, cast(unnest(generate_series((SELECT m FROM mx) + 1, (SELECT m FROM mx) + 14, INTERVAL 1 DAY)) AS DATE) AS ds
      FROM c)"""


def _grid(spark, sf_dir):
    d = fx.daily_series(spark, sf_dir)
    last = d.agg(F.max("ds")).scalar()
    return jn.future_grid(fe.recent_combos(d, 28), F.date_add(last, 1), F.date_add(last, 14))


@query("future_grid", with_views(f"WITH {_GRID} SELECT * FROM g", "daily_series"))
def future_grid(spark, sf_dir):
    return _grid(spark, sf_dir)


@query("latest_attributes", with_views(f"""
WITH {_GRID},
l AS (SELECT {KEYS}, arg_max(price, ds) AS price, arg_max(discount_percent, ds) AS discount_percent,
             arg_max(n_lines, ds) AS n_lines FROM daily_series GROUP BY ALL)
SELECT g.*, coalesce(l.price, 0) AS price, coalesce(l.discount_percent, 0) AS discount_percent,
       coalesce(l.n_lines, 0) AS n_lines
FROM g LEFT JOIN l USING ({KEYS})""", "daily_series"))
def latest_attributes(spark, sf_dir):
    return jn.latest_attributes(_grid(spark, sf_dir), fx.daily_series(spark, sf_dir),
                                ["customer_id", "product_id"], ["price", "discount_percent", "n_lines"])


@query("sku_lookup", with_views("""
WITH m AS (SELECT 'P' || cast(p_partkey AS VARCHAR) AS sku_id, p_name AS product_name, p_brand AS brand,
                  p_type AS category, p_retailprice AS retail_price FROM part),
f AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY product_name) AS rn FROM m)
      WHERE rn = 1)
SELECT s.sku_id, f.product_name, f.brand, f.category, f.retail_price
FROM (SELECT DISTINCT sku_id FROM demand_history) s LEFT JOIN f USING (sku_id)""", "demand_history"))
def sku_lookup(spark, sf_dir):
    from ..sources.tables import read_table
    master = read_table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("sku_id"),
        F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"), F.col("p_retailprice").alias("retail_price"))
    skus = fx.demand_history(spark, sf_dir).select("sku_id").distinct()
    return jn.sku_lookup(skus, master, "sku_id", ["product_name"])


_CUSTOMERS = ["Customer#000000001", " CUSTOMER#000000002", "customer#000000003 ",
              "Customer#000000010", "Customer#000000100", "Customer#000001000"]
_CITIES = ["asia", "EUROPE", "America "]


@query("in_list_filter", with_views(
    "SELECT * FROM demand_history WHERE lower(trim(customer)) IN ("
    + ", ".join(f"'{v.strip().lower()}'" for v in _CUSTOMERS) + ") AND lower(trim(city)) IN ("
    + ", ".join(f"'{v.strip().lower()}'" for v in _CITIES) + ")", "demand_history"))
def in_list_filter(spark, sf_dir):
    return jn.in_list_filter(fx.demand_history(spark, sf_dir),
                             {"customer": _CUSTOMERS, "city": _CITIES})


@query("supply_position", with_views(f"""
WITH j AS ({_asof_sql("s.product_id = r.product_id AND s.customer_id = r.city")}),
x AS (SELECT {KEYS}, ds, order_qty,
             coalesce(CASE WHEN day(ds) % 2 = 0 THEN order_qty * 3 END, 0.0) + coalesce(warehouse_inventory_qty, 0.0) AS on_hand_qty,
             coalesce(CASE WHEN count(order_qty) OVER f >= 3 THEN avg(order_qty) OVER f END, 0.0) AS roll14
      FROM j WINDOW f AS (PARTITION BY {KEYS} ORDER BY ds ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))
SELECT {KEYS}, ds, order_qty, on_hand_qty, {r('roll14')} AS qty_roll14,
       {r('least(greatest(on_hand_qty / (roll14 + 1e-6), 0.0), 365.0)')} AS days_of_supply,
       cast(on_hand_qty <= 0 AS INTEGER) AS stockout_flag
FROM x""", "daily_series", "inventory"))
def supply_position(spark, sf_dir):
    j = jn.asof_join(fx.daily_series(spark, sf_dir), _inv(spark, sf_dir),
                     ["product_id", "customer_id"], ["product_id", "city"], "ds", "snapshot_date", 90,
                     left_unique=True)
    roll = fe.past_mean_col()
    # a second inventory column, known on even days
    j = j.withColumn("customer_inventory_qty", F.when(F.dayofmonth("ds") % 2 == 0, F.col("order_qty") * 3))
    x = fe.on_hand(j).select("customer_id", "product_id", "ds", "order_qty", "on_hand_qty", roll.alias("_roll"))
    cols = fe.supply_columns(F.col("on_hand_qty"), F.col("_roll"))
    return x.select("customer_id", "product_id", "ds", "order_qty", "on_hand_qty",
                    r6("_roll").alias("qty_roll14"), cols["days_of_supply"].alias("days_of_supply"),
                    cols["stockout_flag"].alias("stockout_flag"))
