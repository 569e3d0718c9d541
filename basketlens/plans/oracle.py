"""DuckDB SQL twins of the canonical tables (the correctness oracle).

``with_canon(body)`` prefixes a query body with CTEs that derive the same
canonical tables as ``basketlens.sources.adapter`` from the driver's views
(``orders``, ``lineitem``, ``part``, ``customer``, ``nation``).  Inside a body
use ``c_orders``, ``c_basket`` (lines joined with orders), ``c_items``
(order_products with eval_set), ``c_prior``/``c_train``/``c_test``,
``c_products``, ``c_aisles``, ``c_departments``, ``c_values``, ``c_users``.
"""

from __future__ import annotations

CANON_CTES = """
c_orders0 AS (
  SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderdate,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS order_number
  FROM orders),
c_orders1 AS (
  SELECT *, max(order_number) OVER (PARTITION BY user_id) AS n_orders,
         lag(o_orderdate) OVER (PARTITION BY user_id ORDER BY order_number) AS prev_date
  FROM c_orders0),
c_orders AS (
  SELECT order_id, user_id,
         CASE WHEN n_orders > 1 AND order_number = n_orders
              THEN CASE WHEN user_id % 3 = 0 THEN 'test' ELSE 'train' END
              ELSE 'prior' END AS eval_set,
         CAST(order_number AS INTEGER) AS order_number,
         CAST(dayofweek(o_orderdate) AS INTEGER) AS order_dow,
         CAST(order_id % 24 AS INTEGER) AS order_hour_of_day,
         CAST(date_diff('day', CAST(prev_date AS DATE), CAST(o_orderdate AS DATE)) AS DOUBLE)
           AS days_since_prior_order
  FROM c_orders1),
c_lines0 AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, l_linenumber,
         row_number() OVER (PARTITION BY l_orderkey, l_partkey
                            ORDER BY l_linenumber, l_suppkey, l_extendedprice, l_shipdate) AS keep
  FROM lineitem),
c_lines AS (
  SELECT order_id, product_id,
         CAST(row_number() OVER (PARTITION BY order_id ORDER BY l_linenumber, product_id) AS INTEGER)
           AS add_to_cart_order
  FROM c_lines0 WHERE keep = 1),
c_basket0 AS (
  SELECT l.order_id, l.product_id, l.add_to_cart_order, o.eval_set, o.user_id, o.order_number,
         o.order_dow, o.order_hour_of_day, o.days_since_prior_order,
         min(o.order_number) OVER (PARTITION BY o.user_id, l.product_id) AS first_on
  FROM c_lines l JOIN c_orders o ON l.order_id = o.order_id),
c_basket AS (
  SELECT order_id, product_id, add_to_cart_order,
         CAST(CASE WHEN order_number > first_on THEN 1 ELSE 0 END AS INTEGER) AS reordered,
         eval_set, user_id, order_number, order_dow, order_hour_of_day, days_since_prior_order
  FROM c_basket0),
c_items AS (SELECT order_id, product_id, add_to_cart_order, reordered, eval_set FROM c_basket),
c_prior AS (SELECT order_id, product_id, add_to_cart_order, reordered FROM c_basket WHERE eval_set = 'prior'),
c_train AS (SELECT order_id, product_id, add_to_cart_order, reordered FROM c_basket WHERE eval_set = 'train'),
c_test AS (SELECT order_id, product_id, add_to_cart_order, reordered FROM c_basket WHERE eval_set = 'test'),
c_departments AS (
  SELECT CAST(dense_rank() OVER (ORDER BY department) AS INTEGER) AS department_id, department
  FROM (SELECT DISTINCT p_type AS department FROM part)),
c_products AS (
  SELECT p.p_partkey AS product_id, p.p_name AS product_name,
         CAST(substr(p.p_brand, 7) AS INTEGER) AS aisle_id, d.department_id
  FROM part p LEFT JOIN c_departments d ON p.p_type = d.department),
c_aisles AS (
  SELECT DISTINCT CAST(substr(p_brand, 7) AS INTEGER) AS aisle_id, p_brand AS aisle FROM part),
c_values AS (SELECT p_partkey AS product_id, p_retailprice AS value FROM part),
c_users AS (
  SELECT c.c_custkey AS user_id, n.n_name AS country, c.c_mktsegment AS segment
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)
"""


def with_canon(body: str, extra_ctes: str = "") -> str:
    """Full DuckDB statement: canonical CTEs (+ ``extra_ctes``) then ``body``."""
    ctes = CANON_CTES.strip()
    if extra_ctes.strip():
        ctes = ctes + ",\n" + extra_ctes.strip().rstrip(",")
    return f"WITH {ctes}\n{body.strip()}"
