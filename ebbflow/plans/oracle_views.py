"""DuckDB SQL for the canonical views, used only by the correctness oracle.

The oracle is written independently of the Spark code (plain SQL over the
pre-registered driver tables) so that a query and its oracle can disagree.
``with_views(body, names)`` prefixes a query with the CTEs it needs.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "demand_history": ((), """
  SELECT cast(l.l_orderkey AS VARCHAR) AS order_id, l.l_linenumber AS line_number,
         cast(o.o_orderdate AS DATE) AS order_date,
         'P' || cast(l.l_partkey AS VARCHAR) AS sku_id,
         p.p_name AS product_name, p.p_brand AS brand, p.p_type AS category,
         n.n_name AS location, r.r_name AS city, c.c_mktsegment AS channel,
         cast(c.c_custkey AS VARCHAR) AS customer_id, c.c_name AS customer,
         l.l_quantity AS order_qty, l.l_quantity AS total_demand_qty,
         cast(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18,4)) AS revenue,
         l.l_extendedprice / l.l_quantity AS price,
         l.l_discount * 100 AS discount_percent,
         l.l_discount >= 0.08 AS is_promotional,
         CASE WHEN l.l_discount >= 0.08 THEN l.l_quantity ELSE 0.0 END AS promotional_demand_qty,
         CASE WHEN l.l_discount >= 0.08 THEN 0.0 ELSE l.l_quantity END AS base_demand_qty,
         cast(l.l_shipdate AS DATE) > cast(o.o_orderdate AS DATE) + 90 AS is_late,
         o.o_orderpriority AS forecast_version_name
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey"""),
    "daily_series": (("demand_history",), """
  SELECT location AS customer_id, brand AS product_id, order_date AS ds,
         sum(order_qty) AS order_qty, cast(sum(revenue) AS DOUBLE) AS revenue,
         sum(base_demand_qty) AS base_demand_qty,
         sum(promotional_demand_qty) AS promotional_demand_qty,
         bool_or(is_promotional) AS is_promotional,
         floor(avg(price) * 1e6 + 0.5) / 1e6 AS price,
         floor(avg(discount_percent) * 1e6 + 0.5) / 1e6 AS discount_percent,
         count(*) AS n_lines
  FROM demand_history GROUP BY 1, 2, 3"""),
    "daily_series_dense": (("daily_series",), """
  SELECT s.customer_id, s.product_id, g.ds,
         coalesce(d.order_qty, 0.0) AS order_qty, coalesce(d.revenue, 0.0) AS revenue,
         coalesce(d.base_demand_qty, 0.0) AS base_demand_qty,
         coalesce(d.promotional_demand_qty, 0.0) AS promotional_demand_qty,
         coalesce(d.is_promotional, false) AS is_promotional,
         d.price, d.discount_percent
  FROM (SELECT customer_id, product_id, cast(unnest(generate_series(min(ds), (SELECT max(ds) FROM daily_series),
               INTERVAL 1 DAY)) AS DATE) AS ds FROM daily_series GROUP BY 1, 2) g
  JOIN (SELECT DISTINCT customer_id, product_id FROM daily_series) s
    ON s.customer_id = g.customer_id AND s.product_id = g.product_id
  LEFT JOIN daily_series d
    ON d.customer_id = g.customer_id AND d.product_id = g.product_id AND d.ds = g.ds"""),
    "inventory": ((), """
  SELECT p.p_brand AS product_id, n.n_name AS city,
         cast(date_trunc('month', cast(l.l_shipdate AS DATE)) AS DATE) AS snapshot_date,
         sum(l.l_quantity) AS warehouse_inventory_qty
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  GROUP BY 1, 2, 3"""),
    "promo_calendar": ((), """
  SELECT p_partkey AS promo_id, p_brand AS product_id,
         DATE '1995-01-01' + cast((p_partkey * 11) % 2400 AS INTEGER) AS start_date,
         DATE '1995-01-01' + cast((p_partkey * 11) % 2400 AS INTEGER)
           + CASE WHEN p_partkey % 20 = 0 THEN -5 ELSE cast(p_size % 14 AS INTEGER) END AS end_date,
         cast(p_size AS DOUBLE) AS discount
  FROM part"""),
    "adjustments": ((), """
  SELECT event_id AS adjustment_id, 'P' || cast(user_id AS VARCHAR) AS sku_id,
         cast(ts AS DATE) AS target_date, value AS current_value,
         CASE WHEN event_id % 7 = 0 THEN value * 2 END AS new_forecast_value,
         CASE event_id % 3 WHEN 0 THEN 'absolute' WHEN 1 THEN 'percentage' ELSE 'multiplier' END
           AS adjustment_type,
         cast(json_extract_string(props, '$.k') AS DOUBLE) AS adjustment_value,
         event_type AS reason_category, ts AS created_at
  FROM events"""),
    "ids_right": ((), "SELECT DISTINCT p_name AS right_id FROM part"),
    "ids_left": ((), """
  SELECT CASE length(p_name) % 4
           WHEN 0 THEN upper(p_name)
           WHEN 1 THEN '  ' || p_name || '.'
           WHEN 2 THEN '00' || replace(p_name, ' ', '-')
           ELSE p_name || 's' END AS left_id
  FROM (SELECT DISTINCT p_name FROM part)"""),
    "dirty_history": (("demand_history",), """
  WITH m AS (SELECT *, (cast(order_id AS BIGINT) * 7 + line_number) % 50 AS _m FROM demand_history),
  d AS (
  SELECT CASE _m WHEN 0 THEN NULL WHEN 1 THEN 'none' WHEN 2 THEN 'nan' WHEN 3 THEN '0'
              ELSE order_id END AS order_id,
         line_number,
         CASE WHEN _m = 4 THEN NULL ELSE order_date END AS order_date,
         CASE _m WHEN 5 THEN '' WHEN 6 THEN ' NaN ' WHEN 7 THEN NULL ELSE sku_id END AS sku_id,
         CASE WHEN _m = 8 THEN NULL ELSE category END AS category,
         CASE WHEN _m = 9 THEN 'None' ELSE city END AS city,
         CASE WHEN _m = 10 THEN NULL ELSE customer END AS customer,
         channel, location,
         CASE WHEN _m = 11 THEN NULL ELSE order_qty END AS order_qty,
         CASE WHEN _m = 12 THEN NULL ELSE price END AS price,
         discount_percent, is_promotional, _m
  FROM m)
  SELECT * EXCLUDE (_m) FROM d
  UNION ALL
  SELECT * EXCLUDE (_m) FROM d WHERE _m = 13"""),
}


def _backtest_sql(by: str) -> str:
    return f"""
  SELECT {by}, order_date, actual, forecast FROM (
    SELECT *, sum(n_rows) OVER (PARTITION BY {by}) AS grp_rows,
           row_number() OVER (PARTITION BY {by} ORDER BY order_date) - 1 AS idx,
           avg(actual) OVER (PARTITION BY {by} ORDER BY order_date
                             ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS forecast
    FROM (SELECT {by}, order_date, sum(total_demand_qty) AS actual, count(*) AS n_rows
          FROM demand_history GROUP BY ALL))
  WHERE grp_rows >= 5 AND idx >= 3 AND actual IS NOT NULL AND forecast > 0"""


VIEWS["backtest"] = (("demand_history",), _backtest_sql("forecast_version_name"))
VIEWS["sku_backtest"] = (("demand_history",), _backtest_sql("sku_id"))


def r(x: str, digits: int = 6) -> str:
    """SQL twin of ``functions.columns.round_to``."""
    return f"(floor(({x}) * 1e{digits} + 0.5) / 1e{digits})"


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs for ``names`` (and their dependencies)."""
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]}\n)" for n in _order(names))
    stripped = body.lstrip()
    if stripped[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{stripped[15:]}"
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"
