"""Declared analytics and sequence features: D1-D6, J13, W10-W13."""

from pyspark.sql import functions as F

from basketlens.operators import basket as BK
from basketlens.operators import itemsets as IT
from basketlens.operators.staging import staged
from basketlens.plans.oracle import with_canon
from basketlens.plans.registry import query

RFM = """
per AS (SELECT o_custkey AS user_id, max(o_orderdate) AS last, count(*) AS frequency,
               sum(o_totalprice) AS monetary FROM orders GROUP BY o_custkey),
per2 AS (SELECT user_id, frequency, monetary,
                CAST(date_diff('day', CAST(last AS DATE), CAST((SELECT max(o_orderdate) FROM orders) AS DATE)) AS INTEGER)
                  AS recency FROM per),
sc AS (SELECT *, CAST(ntile(5) OVER (ORDER BY recency DESC, user_id DESC) AS INTEGER) AS r_score,
              CAST(ntile(5) OVER (ORDER BY frequency, user_id) AS INTEGER) AS f_score,
              CAST(ntile(5) OVER (ORDER BY monetary, user_id) AS INTEGER) AS m_score FROM per2),
rfm AS (SELECT *, CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
                       WHEN r_score <= 1 AND (f_score >= 4 OR m_score >= 4) THEN 'Can''t Lose Them'
                       WHEN f_score >= 3 THEN 'Loyal Customers'
                       WHEN r_score >= 3 THEN 'Potential Loyalists' ELSE 'At Risk' END AS segment FROM sc)"""


@query("rfm_scores", "D1", ctes=RFM, sql="SELECT * FROM rfm")
def _rfm(c):
    return BK.rfm(c.raw("orders"))


@query("rfm_segments", "D1", ctes=RFM, sql="""
SELECT segment, count(*) AS users, sum(monetary) AS revenue,
       count(*) * 100.0 / sum(count(*)) OVER () AS user_pct,
       sum(monetary) * 100.0 / sum(sum(monetary)) OVER () AS revenue_pct
FROM rfm GROUP BY segment""")
def _rfm_segments(c):
    return BK.rfm_segments(BK.rfm(c.raw("orders")))


PAIRS = """
tx AS (SELECT DISTINCT b.order_id, p.product_name AS item FROM c_basket b
       JOIN c_products p ON b.product_id = p.product_id),
n AS (SELECT count(DISTINCT order_id) AS n FROM tx),
sup AS (SELECT item, count(*) / (SELECT n FROM n) AS support FROM tx GROUP BY item),
pr AS (SELECT a.item AS antecedent, b.item AS consequent, count(*) AS orders
       FROM tx a JOIN tx b ON a.order_id = b.order_id AND a.item <> b.item GROUP BY 1, 2)"""


@query("market_basket_rules", "D2,J12", ctes=PAIRS, sql="""
SELECT pr.antecedent, pr.consequent, pr.orders, pr.orders / (SELECT n FROM n) AS support,
       (pr.orders / (SELECT n FROM n)) / sa.support AS confidence,
       ((pr.orders / (SELECT n FROM n)) / sa.support) / sb.support AS lift
FROM pr JOIN sup sa ON pr.antecedent = sa.item JOIN sup sb ON pr.consequent = sb.item
WHERE sa.support >= 0.005 AND sb.support >= 0.005 AND pr.orders / (SELECT n FROM n) >= 0.005
  AND (pr.orders / (SELECT n FROM n)) / sa.support >= 0.05""")
def _rules(c):
    return BK.pair_rules(_name_tx(c), "item", 0.005, 0.05)


def _name_tx(c):
    """Lines of all orders with their product names."""
    return c.basket.select("order_id", "product_id").join(c.products.select("product_id", F.col("product_name").alias("item")), "product_id")


#: Every subset of an order's frequent items, extended item by item in ascending order.
SETS = """
tx AS (SELECT DISTINCT b.order_id, p.product_name AS item FROM c_basket b
       JOIN c_products p ON b.product_id = p.product_id WHERE p.product_name IS NOT NULL),
n AS (SELECT count(DISTINCT order_id) AS n FROM tx),
fx AS (SELECT * FROM tx WHERE item IN (SELECT item FROM tx GROUP BY item HAVING count(*) >= 0.005 * (SELECT n FROM n))),
sub AS (
  SELECT order_id, [item] AS items FROM fx
  UNION ALL SELECT s.order_id, list_append(s.items, f.item) FROM sub s JOIN fx f ON f.order_id = s.order_id AND f.item > s.items[-1]),
fs AS (SELECT items, count(*) AS freq, count(*) / (SELECT n FROM n) AS support FROM sub GROUP BY items
       HAVING count(*) >= 0.005 * (SELECT n FROM n))"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _sets(c):
    return c._memo("itemsets", lambda: staged(IT.frequent_itemsets(_name_tx(c), "item", 0.005), "itemsets"))


@query("frequent_itemsets", "D2", raw_sql=True, sql=_recursive(with_canon("""
SELECT array_to_string(items, ' + ') AS items, len(items)::INTEGER AS size, freq, support FROM fs""", SETS)))
def _itemsets(c):
    return _sets(c).select(F.concat_ws(" + ", "items").alias("items"), F.size("items").alias("size"), "freq", "support")


@query("association_rules", "D2", raw_sql=True, sql=_recursive(with_canon("""
SELECT array_to_string(a.items, ' + ') AS antecedent, r.c AS consequent, r.freq AS orders, r.support,
  r.freq / a.freq AS confidence, (r.freq / a.freq) / b.support AS lift
FROM (SELECT items, freq, support, unnest(items) AS c FROM fs WHERE len(items) > 1) r
JOIN fs a ON a.items = list_filter(r.items, lambda x: x <> r.c) JOIN fs b ON b.items = [r.c]
WHERE r.freq / a.freq >= 0.05""", SETS)))
def _assoc(c):
    return IT.association_rules(_sets(c), 0.05).select(
        F.concat_ws(" + ", "antecedent").alias("antecedent"), F.concat_ws(" + ", "consequent").alias("consequent"),
        "orders", "support", "confidence", "lift")


@query("department_copurchase", "D3", ctes="""
ud AS (SELECT DISTINCT b.user_id, d.department FROM c_basket b JOIN c_products p ON b.product_id = p.product_id
       JOIN c_departments d ON p.department_id = d.department_id),
na AS (SELECT department, count(*) AS n FROM ud GROUP BY department)""", sql="""
SELECT a.department AS category_a, b.department AS category_b, count(*) AS buyers_both, na.n AS buyers_a,
       count(*) / na.n AS share
FROM ud a JOIN ud b ON a.user_id = b.user_id AND a.department <> b.department
JOIN na ON a.department = na.department GROUP BY a.department, b.department, na.n""")
def _copurchase(c):
    ud = (c.basket.join(c.products, "product_id")
          .join(c.departments, "department_id").select("user_id", "department"))
    return BK.category_copurchase(ud, "department")


@query("revenue_by_country", "D4", sql="""
SELECT u.country, count(*) AS orders, sum(o.o_totalprice) AS revenue
FROM orders o LEFT JOIN c_users u ON o.o_custkey = u.user_id GROUP BY u.country""")
def _country(c):
    return BK.spend_by_country(c.raw("orders"), c.users)


@query("top_spenders", "D4", sql="""
SELECT t.*, u.country, u.segment FROM (
  SELECT o_custkey AS user_id, sum(o_totalprice) AS total_spend, count(*) AS orders FROM orders
  GROUP BY o_custkey ORDER BY total_spend DESC, user_id LIMIT 10) t LEFT JOIN c_users u ON t.user_id = u.user_id""")
def _top_spenders(c):
    return BK.top_spenders(c.raw("orders"), c.users, 10)


@query("spend_metrics", "D5", ctes="""
pu AS (SELECT o_custkey AS user_id, sum(o_totalprice) AS spend FROM orders GROUP BY o_custkey)""", sql="""
SELECT u.segment, count(*) AS users, sum(pu.spend) AS revenue, avg(pu.spend) AS avg_spend,
       (SELECT avg(o_totalprice) FROM orders) AS aov, (SELECT avg(spend) FROM pu) AS avg_customer_value
FROM pu LEFT JOIN c_users u ON pu.user_id = u.user_id GROUP BY u.segment""")
def _spend(c):
    return BK.spend_metrics(c.raw("orders"), c.users)


@query("user_time_counts", "D6", sql="""
SELECT user_id, count(*) FILTER (WHERE order_dow IN (0, 6)) AS user_weekend_orders,
       count(*) FILTER (WHERE order_hour_of_day > 6 AND order_hour_of_day <= 12) AS user_morning_orders
FROM c_orders GROUP BY user_id""")
def _user_time(c):
    return BK.user_time_counts(c.orders)


@query("product_time_counts", "D6", sql="""
SELECT product_id, count(*) FILTER (WHERE order_dow IN (0, 6)) AS product_weekend_orders,
       count(*) FILTER (WHERE order_hour_of_day > 6 AND order_hour_of_day <= 12) AS product_morning_orders,
       avg(days_since_prior_order) AS product_avg_days_since_prior
FROM c_basket GROUP BY product_id""")
def _product_time(c):
    return BK.product_time_counts(c.basket)


@query("negative_candidates", "J13", ctes="""
pop AS (SELECT p.product_id, p.department_id, count(b.product_id) AS n FROM c_products p
        LEFT JOIN c_basket b ON b.product_id = p.product_id AND b.eval_set = 'prior' GROUP BY p.product_id, p.department_id),
ud AS (SELECT DISTINCT b.user_id, p.department_id FROM c_basket b JOIN c_products p ON b.product_id = p.product_id),
nb AS (SELECT ud.user_id, pop.product_id, ud.department_id, CAST(row_number() OVER (PARTITION BY ud.user_id
              ORDER BY pop.n DESC, pop.product_id) AS INTEGER) AS rank
       FROM ud JOIN pop ON ud.department_id = pop.department_id
       WHERE NOT EXISTS (SELECT 1 FROM c_basket h WHERE h.user_id = ud.user_id AND h.product_id = pop.product_id))""",
       sql="SELECT * FROM nb WHERE rank <= 20")
def _negatives(c):
    return BK.negative_candidates(c.basket, c.products, 20)


@query("order_sequence_features", "W10,W13", ctes="""
bs AS (SELECT order_id, count(*) AS n FROM c_basket GROUP BY order_id),
o AS (SELECT o.order_id, o.user_id, o.order_number, o.days_since_prior_order, coalesce(bs.n, 0) AS basket_size
      FROM c_orders o LEFT JOIN bs ON o.order_id = bs.order_id)""", sql="""
SELECT order_id, user_id, order_number, days_since_prior_order, basket_size,
       sum(coalesce(days_since_prior_order, 0.0)) OVER w AS days_since_first_order,
       lag(days_since_prior_order) OVER w AS prev_gap, lag(basket_size) OVER w AS prev_basket_size
FROM o WINDOW w AS (PARTITION BY user_id ORDER BY order_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def _sequence(c):
    return BK.order_sequence_features(c.orders, c.basket)


@query("user_recency", "W12", sql="""
SELECT user_id, count(*) AS orders, coalesce(sum(days_since_prior_order), 0.0) AS tenure_days,
       arg_max(days_since_prior_order, order_number) AS recency_days,
       CASE WHEN coalesce(sum(days_since_prior_order), 0.0) > 0
            THEN (count(*) - 1) * 30.0 / coalesce(sum(days_since_prior_order), 0.0) END AS order_frequency
FROM c_orders GROUP BY user_id""")
def _recency(c):
    return BK.user_recency(c.orders)


@query("product_streaks", "W11", ctes="""
pb AS (SELECT user_id, product_id, order_number FROM c_basket WHERE eval_set = 'prior'),
isl AS (SELECT user_id, product_id, order_number - row_number() OVER (PARTITION BY user_id, product_id
               ORDER BY order_number) AS island, order_number FROM pb),
il AS (SELECT user_id, product_id, island, count(*) AS len, max(order_number) AS e FROM isl GROUP BY ALL),
pp AS (SELECT user_id, product_id, max(e) AS last, arg_max(len, e) AS last_len FROM il GROUP BY ALL),
ten AS (SELECT user_id, order_number, sum(coalesce(days_since_prior_order, 0.0)) OVER (PARTITION BY user_id
               ORDER BY order_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t
        FROM c_orders WHERE eval_set = 'prior'),
lst AS (SELECT user_id, max(order_number) AS mx, max(t) AS tmax FROM ten GROUP BY user_id)""", sql="""
SELECT pp.user_id, pp.product_id,
       CAST(CASE WHEN pp.last = lst.mx THEN pp.last_len ELSE 0 END AS BIGINT) AS streak_length,
       lst.tmax - ten.t AS last_order_days_ago
FROM pp JOIN lst ON pp.user_id = lst.user_id
JOIN ten ON pp.user_id = ten.user_id AND pp.last = ten.order_number""")
def _streaks(c):
    return BK.product_streaks(c.basket, c.orders)
