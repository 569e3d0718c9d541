"""EDA KPIs: A9-A22, W5, W6, W9 (queries + DuckDB twins)."""

from basketlens.operators import kpi
from basketlens.plans.registry import query

ALL_ITEMS = "ai AS (SELECT * FROM c_prior UNION ALL SELECT * FROM c_train)"
PSTATS = ALL_ITEMS + """,
ps AS (
  SELECT a.product_id, count(*) AS total_orders, count(a.reordered) AS total_products,
         CAST(sum(a.reordered) AS BIGINT) AS reordered_count, avg(a.reordered) AS reorder_rate
  FROM ai a GROUP BY a.product_id),
pstats AS (
  SELECT ps.*, p.product_name, p.aisle_id, p.department_id
  FROM ps LEFT JOIN c_products p ON ps.product_id = p.product_id)"""


def _items(c):
    return kpi.all_items(c.items("prior"), c.items("train"))


@query("eda_kpis", "A9", ctes=ALL_ITEMS + """,
bs AS (SELECT order_id, count(*) AS n FROM ai GROUP BY order_id),
opu AS (SELECT user_id, count(*) AS n FROM c_orders GROUP BY user_id)""", sql="""
SELECT (SELECT count(*) FROM c_orders) AS total_orders,
       (SELECT count(DISTINCT user_id) FROM c_orders) AS total_users,
       (SELECT count(*) FROM ai) AS total_items,
       (SELECT avg(reordered) FROM ai) AS item_reorder_rate,
       (SELECT avg(n) FROM bs) AS avg_basket_size,
       (SELECT quantile_cont(n, 0.5) FROM bs) AS median_basket_size,
       (SELECT avg(n) FROM opu) AS avg_orders_per_user,
       (SELECT max(n) FROM opu) AS max_orders_per_user""")
def _eda_kpis(c):
    return kpi.eda_kpis(c.orders, _items(c))


@query("prior_kpis", "A10", ctes="""
bs AS (SELECT order_id, count(*) AS n FROM c_prior GROUP BY order_id),
opu AS (SELECT user_id, count(*) AS n FROM c_orders WHERE eval_set = 'prior' GROUP BY user_id)""", sql="""
SELECT (SELECT avg(n) FROM bs) AS avg_basket_size,
       (SELECT avg(reordered) FROM c_prior) AS item_reorder_rate,
       (SELECT avg(n) FROM opu) AS avg_orders_per_user,
       (SELECT max(n) FROM opu) AS max_orders_per_user,
       (SELECT min(n) FROM opu) AS min_orders_per_user""")
def _prior_kpis(c):
    return kpi.prior_kpis(c.orders, c.items("prior"))


@query("basket_size_stats", "A12", ctes=ALL_ITEMS + """,
bs AS (SELECT order_id, count(*) AS n FROM ai GROUP BY order_id)""", sql="""
SELECT min(n) AS min_basket, max(n) AS max_basket, quantile_cont(n, 0.25) AS q25,
       quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.75) AS q75 FROM bs""")
def _basket_size_stats(c):
    return kpi.basket_size_stats(_items(c))


@query("top_products", "A13,J8", ctes=ALL_ITEMS, sql="""
SELECT t.product_id, t.purchases, p.product_name
FROM (SELECT product_id, count(*) AS purchases FROM ai GROUP BY product_id
      ORDER BY purchases DESC, product_id LIMIT 10) t
LEFT JOIN c_products p ON t.product_id = p.product_id""")
def _top_products(c):
    return kpi.top_products(_items(c), c.products, 10)


@query("department_popularity", "A14,J2", ctes=ALL_ITEMS, sql="""
SELECT t.department_id, t.purchases, d.department
FROM (SELECT p.department_id, count(*) AS purchases
      FROM ai JOIN c_products p ON ai.product_id = p.product_id
      GROUP BY p.department_id ORDER BY purchases DESC, p.department_id LIMIT 5) t
LEFT JOIN c_departments d ON t.department_id = d.department_id""")
def _department_popularity(c):
    return kpi.department_popularity(_items(c), c.products, c.departments, 5)


@query("orders_by_dow", "A15,P12", sql="""
SELECT order_dow, count(*) AS orders,
       ['Sunday','Monday','Tuesday','Wednesday','Thursday','Friday','Saturday'][order_dow + 1] AS day_name
FROM c_orders GROUP BY order_dow""")
def _orders_by_dow(c):
    return kpi.orders_by_dow(c.orders)


@query("orders_by_hour", "A16", sql="""
SELECT order_hour_of_day, count(*) AS orders FROM c_orders GROUP BY order_hour_of_day""")
def _orders_by_hour(c):
    return kpi.orders_by_hour(c.orders)


@query("customer_orders", "A17", sql="""
SELECT user_id, count(*) AS total_orders, max(order_number) AS max_order_number,
       avg(days_since_prior_order) AS avg_days_between_orders
FROM c_orders GROUP BY user_id""")
def _customer_orders(c):
    return kpi.customer_orders(c.orders)


@query("customer_tiers", "A17,P16,W9", sql="""
SELECT customer_type, count(*) AS customers, count(*) * 100.0 / sum(count(*)) OVER () AS pct
FROM (SELECT CASE WHEN n <= 5 THEN 'Light Users' WHEN n <= 10 THEN 'Medium Users'
                  ELSE 'Heavy Users' END AS customer_type
      FROM (SELECT user_id, count(*) AS n FROM c_orders GROUP BY user_id))
GROUP BY customer_type""")
def _customer_tiers(c):
    return kpi.customer_tiers(c.orders)


@query("gap_stats", "A18,P11", ctes="""
g AS (SELECT days_since_prior_order AS x FROM c_orders WHERE days_since_prior_order IS NOT NULL),
gm AS (SELECT x, count(*) AS n FROM g GROUP BY x)""", sql="""
SELECT (SELECT avg(x) FROM g) AS mean_gap,
       (SELECT quantile_cont(x, 0.5) FROM g) AS median_gap,
       (SELECT x FROM gm ORDER BY n DESC, x LIMIT 1) AS mode_gap""")
def _gap_stats(c):
    return kpi.gap_stats(c.orders)


@query("customer_reorder_stats", "A19,P25,T5", ctes=ALL_ITEMS + """,
r AS (SELECT o.user_id, round_even(avg(ai.reordered), 3) AS rate
      FROM ai JOIN c_orders o ON ai.order_id = o.order_id GROUP BY o.user_id)""", sql="""
SELECT count(*) AS customers, avg(rate) AS avg_reorder_rate,
       count(*) FILTER (WHERE rate > 0.8) AS customers_high,
       count(*) FILTER (WHERE rate < 0.3) AS customers_low FROM r""")
def _customer_reorder_stats(c):
    return kpi.customer_reorder_stats(c.orders, _items(c))


@query("customer_reorder_table", "A19", ctes=ALL_ITEMS, sql="""
SELECT o.user_id, count(ai.reordered) AS total_products, CAST(sum(ai.reordered) AS BIGINT) AS reordered_products,
       round_even(avg(ai.reordered), 3) AS reorder_rate
FROM ai JOIN c_orders o ON ai.order_id = o.order_id GROUP BY o.user_id""")
def _customer_reorder_table(c):
    return kpi.customer_reorder_table(c.orders, _items(c))


@query("product_stats", "A20", ctes=PSTATS, sql="SELECT * FROM pstats")
def _product_stats(c):
    return kpi.product_stats(_items(c), c.products)


@query("department_stats", "A21", ctes=PSTATS, sql="""
SELECT s.*, d.department FROM (
  SELECT department_id, CAST(sum(total_orders) AS BIGINT) AS total_dept_orders,
         avg(total_orders) AS avg_orders_per_product, avg(reorder_rate) AS avg_reorder_rate,
         count(product_id) AS product_count
  FROM pstats GROUP BY department_id) s
LEFT JOIN c_departments d ON s.department_id = d.department_id""")
def _department_stats(c):
    return kpi.department_stats(kpi.product_stats(_items(c), c.products), c.departments)


@query("aisle_stats", "A22", ctes=PSTATS, sql="""
SELECT s.*, a.aisle FROM (
  SELECT aisle_id, CAST(sum(total_orders) AS BIGINT) AS total_aisle_orders,
         avg(total_orders) AS avg_orders_per_product, avg(reorder_rate) AS avg_reorder_rate,
         count(product_id) AS product_count
  FROM pstats GROUP BY aisle_id) s
LEFT JOIN c_aisles a ON s.aisle_id = a.aisle_id""")
def _aisle_stats(c):
    return kpi.aisle_stats(kpi.product_stats(_items(c), c.products), c.aisles)


@query("top_products_by_orders", "W5", ctes=PSTATS, sql="""
SELECT * FROM pstats ORDER BY total_orders DESC, product_id LIMIT 10""")
def _top_by_orders(c):
    return kpi.top_by_orders(kpi.product_stats(_items(c), c.products), 10)


@query("top_reorder_rate_products", "W6", ctes=PSTATS, sql="""
SELECT * FROM pstats WHERE total_orders >= 10 ORDER BY reorder_rate DESC, product_id LIMIT 10""")
def _top_reorder_rate(c):
    return kpi.top_reorder_rate(kpi.product_stats(_items(c), c.products), 10, 10)
