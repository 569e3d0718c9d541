"""Scans, cleaning, enrichment, dedup and set operations:
S12, S13, P1-P8, P12-P14, P19, J3, W1, U1, U2."""

from pyspark.sql import functions as F

from basketlens.functions.scalar import key_hash_sql
from basketlens.operators import clean, kpi
from basketlens.plans.registry import query
from basketlens.sources import readers


@query("first_orders", "S12", sql="SELECT * FROM c_orders ORDER BY order_id LIMIT 100")
def _first_orders(c):
    return readers.first_n(c.orders, 100, "order_id")


@query("sample_orders", "S13,T15", sql=f"""
SELECT * FROM c_orders ORDER BY {key_hash_sql('order_id', 42)}, order_id LIMIT 100""")
def _sample_orders(c):
    return readers.sample_n(c.orders, 100, 42, "order_id")


@query("orders_enriched", "P1-P5,P12-P14,P19,T14", sql="""
SELECT order_id, user_id, eval_set, order_number,
       CAST(order_dow AS TINYINT) AS order_dow, CAST(order_hour_of_day AS TINYINT) AS order_hour_of_day,
       coalesce(days_since_prior_order, 0.0) AS days_since_prior_order,
       CAST(CASE WHEN order_dow IN (0, 6) THEN 1 ELSE 0 END AS TINYINT) AS is_weekend,
       CASE WHEN order_hour_of_day >= 0 AND order_hour_of_day <= 6 THEN 'night'
            WHEN order_hour_of_day <= 12 THEN 'morning' WHEN order_hour_of_day <= 18 THEN 'afternoon'
            WHEN order_hour_of_day <= 24 THEN 'evening' END AS hour_bucket,
       CASE WHEN coalesce(days_since_prior_order, 0.0) BETWEEN -1 AND 0 THEN 'first_order'
            WHEN coalesce(days_since_prior_order, 0.0) <= 7 THEN 'week'
            WHEN coalesce(days_since_prior_order, 0.0) <= 14 THEN 'two_weeks'
            WHEN coalesce(days_since_prior_order, 0.0) <= 30 THEN 'month'
            WHEN coalesce(days_since_prior_order, 0.0) > 30 THEN 'long_time' END AS days_bucket,
       ['Sunday','Monday','Tuesday','Wednesday','Thursday','Friday','Saturday'][order_dow + 1] AS day_name,
       order_hour_of_day BETWEEN 10 AND 16 AS is_peak_hour,
       order_dow IN (0, 1, 6) AS is_peak_day,
       CASE WHEN order_number > 0 AND order_number <= 5 THEN '1-5'
            WHEN order_number > 5 AND order_number <= 10 THEN '6-10'
            WHEN order_number > 10 AND order_number <= 20 THEN '11-20'
            WHEN order_number > 20 AND order_number <= 100 THEN '20+' END AS order_group,
       CAST(DATE '2023-01-01' + CAST(order_id % 365 AS INTEGER) AS DATE) AS order_date
FROM c_orders""")
def _orders_enriched(c):
    return clean.orders_calendar(clean.clean_orders(c.orders))


TITLE = "array_to_string(list_transform(string_split(trim({c}), ' '), " \
        "lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"


@query("products_enriched", "J3,P6,P7,P8,T6", sql=f"""
SELECT p.department_id, p.aisle_id, p.product_id,
       coalesce(trim(p.product_name), 'Unknown Product') AS product_name,
       {TITLE.format(c='a.aisle')} AS aisle, {TITLE.format(c='d.department')} AS department,
       {TITLE.format(c='d.department')} || ' > ' || {TITLE.format(c='a.aisle')} AS product_hierarchy
FROM c_products p LEFT JOIN c_aisles a ON p.aisle_id = a.aisle_id
LEFT JOIN c_departments d ON p.department_id = d.department_id""")
def _products_enriched(c):
    return clean.enrich_products(c.products, c.aisles, c.departments)


@query("dedup_lines", "W1,Q10", sql="""
SELECT order_id, product_id, add_to_cart_order, l_suppkey FROM (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, l_linenumber AS add_to_cart_order, l_suppkey,
         row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey) AS rn
  FROM lineitem) WHERE rn = 1""")
def _dedup_lines(c):
    raw = c.raw("lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
                                   F.col("l_linenumber").alias("add_to_cart_order"), "l_suppkey")
    return clean.dedup_items(raw, tie_cols=("l_suppkey",))


@query("all_items", "U1", sql="SELECT * FROM c_prior UNION ALL SELECT * FROM c_train")
def _all_items(c):
    return kpi.all_items(c.items("prior"), c.items("train"))


@query("distinct_product_ids", "U2", sql="""
SELECT product_id FROM c_prior UNION SELECT product_id FROM c_train""")
def _distinct_products(c):
    return c.items("prior").select("product_id").union(c.items("train").select("product_id")).distinct()
