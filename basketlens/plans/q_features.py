"""Feature tables and training sets: A1-A8e, P20-P23, J4-J7, J9, J11, Q14."""

from basketlens.functions import fixed as FX
from basketlens.operators import clean
from basketlens.operators import features as FT
from basketlens.plans.registry import query


def mode_cte(name: str, source: str, key: str, col: str, alias: str) -> str:
    """First mode per key (max count, then smallest value): T1 in SQL."""
    return f"""{name} AS (SELECT {key}, v AS {alias} FROM (
  SELECT {key}, {col} AS v, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {col}) AS rn
  FROM {source} WHERE {col} IS NOT NULL GROUP BY {key}, {col}) WHERE rn = 1)"""


TITLE = "array_to_string(list_transform(string_split(trim({c}), ' '), " \
        "lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"

BASE = """
pb AS (SELECT * FROM c_basket WHERE eval_set = 'prior'),
po AS (SELECT * FROM c_orders WHERE eval_set = 'prior'),
oc AS (SELECT order_id, user_id, eval_set, order_number, CAST(order_dow AS TINYINT) AS order_dow,
              CAST(order_hour_of_day AS TINYINT) AS order_hour_of_day,
              coalesce(days_since_prior_order, 0.0) AS days_since_prior_order FROM c_orders),
poc AS (SELECT * FROM oc WHERE eval_set = 'prior')"""

SRC_USER = BASE + ",\n" + mode_cte("fdow", "poc", "user_id", "order_dow", "favorite_dow") + ",\n" + \
    mode_cte("fhour", "poc", "user_id", "order_hour_of_day", "favorite_hour") + """,
a1 AS (SELECT s.*, d.favorite_dow, h.favorite_hour FROM (
  SELECT user_id, count(order_number) AS total_orders, max(order_number) AS max_order_number,
         avg(days_since_prior_order) AS avg_days_between_orders,
         stddev_samp(days_since_prior_order) AS std_days_between_orders,
         max(days_since_prior_order) AS max_days_between_orders
  FROM poc GROUP BY user_id) s
  LEFT JOIN fdow d ON s.user_id = d.user_id LEFT JOIN fhour h ON s.user_id = h.user_id),
a2 AS (SELECT user_id, count(DISTINCT product_id) AS unique_products,
              avg(add_to_cart_order) AS avg_basket_position, stddev_samp(add_to_cart_order) AS std_basket_position,
              avg(reordered) AS reorder_ratio, CAST(sum(reordered) AS BIGINT) AS total_reorders
       FROM pb GROUP BY user_id),
a3 AS (SELECT x.user_id, count(DISTINCT p.department_id) AS unique_departments,
              count(DISTINCT p.aisle_id) AS unique_aisles
       FROM (SELECT DISTINCT user_id, product_id FROM pb) x JOIN c_products p ON x.product_id = p.product_id
       GROUP BY x.user_id),
a4 AS (SELECT a1.user_id, a1.total_orders, a1.max_order_number, a1.avg_days_between_orders,
              coalesce(a1.std_days_between_orders, 0.0) AS std_days_between_orders, a1.max_days_between_orders,
              a1.favorite_dow, a1.favorite_hour,
              coalesce(a2.unique_products, 0) AS unique_products,
              coalesce(a2.avg_basket_position, 0.0) AS avg_basket_position,
              coalesce(a2.std_basket_position, 0.0) AS std_basket_position,
              coalesce(a2.reorder_ratio, 0.0) AS reorder_ratio, coalesce(a2.total_reorders, 0) AS total_reorders,
              coalesce(a3.unique_departments, 0) AS unique_departments,
              coalesce(a3.unique_aisles, 0) AS unique_aisles
       FROM a1 LEFT JOIN a2 ON a1.user_id = a2.user_id LEFT JOIN a3 ON a1.user_id = a3.user_id),
usrc AS (SELECT *, (total_reorders + (unique_products - total_reorders)) / total_orders AS avg_basket_size,
                reorder_ratio * total_orders AS customer_loyalty FROM a4)"""


@query("user_order_stats", "A1,T1,T2,T3", ctes=SRC_USER, sql="SELECT * FROM a1")
def _a1(c):
    return FT.user_order_stats(clean.clean_orders(c.orders))


@query("user_basket_stats", "A2,J1", ctes=SRC_USER, sql="SELECT * FROM a2")
def _a2(c):
    return FT.user_basket_stats(c.basket)


@query("user_diversity", "A3,J2", ctes=SRC_USER, sql="SELECT * FROM a3")
def _a3(c):
    return FT.user_diversity(c.basket, c.products)


@query("user_features_src", "A1-A4,J4,P22,T12", ctes=SRC_USER, sql="SELECT * FROM usrc")
def _usrc(c):
    return FT.user_features_src(clean.clean_orders(c.orders), c.basket, c.products)


SRC_PRODUCT = BASE + ",\n" + mode_cte("pdow", "pb", "product_id", "order_dow", "popular_dow") + ",\n" + \
    mode_cte("phour", "pb", "product_id", "order_hour_of_day", "popular_hour") + f""",
pe AS (SELECT p.product_id, coalesce(trim(p.product_name), 'Unknown Product') AS product_name, p.aisle_id,
              p.department_id, {TITLE.format(c='a.aisle')} AS aisle, {TITLE.format(c='d.department')} AS department
       FROM c_products p LEFT JOIN c_aisles a ON p.aisle_id = a.aisle_id
       LEFT JOIN c_departments d ON p.department_id = d.department_id),
a5s AS (SELECT product_id, count(DISTINCT user_id) AS unique_users, count(order_id) AS total_orders,
               avg(add_to_cart_order) AS avg_cart_position, stddev_samp(add_to_cart_order) AS std_cart_position,
               avg(reordered) AS reorder_probability, CAST(sum(reordered) AS BIGINT) AS total_reorders,
               count(reordered) AS total_purchases FROM pb GROUP BY product_id),
a5 AS (SELECT pe.*, coalesce(s.unique_users, 0) AS unique_users, coalesce(s.total_orders, 0) AS total_orders,
              coalesce(s.avg_cart_position, 0.0) AS avg_cart_position,
              coalesce(s.std_cart_position, 0.0) AS std_cart_position,
              coalesce(s.reorder_probability, 0.0) AS reorder_probability,
              coalesce(s.total_reorders, 0) AS total_reorders, coalesce(s.total_purchases, 0) AS total_purchases,
              coalesce(d.popular_dow, 0) AS popular_dow, coalesce(h.popular_hour, 0) AS popular_hour
       FROM pe LEFT JOIN a5s s ON pe.product_id = s.product_id
       LEFT JOIN pdow d ON pe.product_id = d.product_id LEFT JOIN phour h ON pe.product_id = h.product_id),
a6 AS (SELECT *, unique_users * reorder_probability AS popularity_score FROM a5),
psrc AS (SELECT a6.*, dp.department_popularity, ap.aisle_popularity FROM a6
  LEFT JOIN (SELECT department_id, avg(unique_users) AS department_popularity FROM a6 GROUP BY 1) dp
    ON a6.department_id = dp.department_id
  LEFT JOIN (SELECT aisle_id, avg(unique_users) AS aisle_popularity FROM a6 GROUP BY 1) ap
    ON a6.aisle_id = ap.aisle_id)"""


@query("product_features_src", "A5,A6,A7,J5,J9,T11", ctes=SRC_PRODUCT, sql="SELECT * FROM psrc")
def _psrc(c):
    return FT.product_features_src(c.basket, clean.enrich_products(c.products, c.aisles, c.departments))


@query("final_dataset_src", "A8e,J7,P22", ctes=SRC_USER + "," + SRC_PRODUCT.replace(BASE + ",", "", 1), sql="""
SELECT ui.user_id, ui.product_id, ui.order_id, ui.add_to_cart_order, ui.reordered,
       u.total_orders, u.max_order_number, u.avg_days_between_orders, u.std_days_between_orders,
       u.max_days_between_orders, u.favorite_dow, u.favorite_hour, u.unique_products, u.avg_basket_position,
       u.std_basket_position, u.reorder_ratio, u.total_reorders, u.unique_departments, u.unique_aisles,
       u.avg_basket_size, u.customer_loyalty,
       coalesce(p.popularity_score, 0.0) AS popularity_score,
       coalesce(p.reorder_probability, 0.0) AS reorder_probability,
       coalesce(p.avg_cart_position, 0.0) AS avg_cart_position,
       coalesce(p.department_popularity, 0.0) AS department_popularity,
       coalesce(p.aisle_popularity, 0.0) AS aisle_popularity,
       o.order_dow, o.order_hour_of_day, coalesce(o.days_since_prior_order, 0.0) AS days_since_prior_order
FROM (SELECT user_id, product_id, order_id, add_to_cart_order, reordered FROM c_basket WHERE eval_set = 'train') ui
LEFT JOIN usrc u ON ui.user_id = u.user_id
LEFT JOIN psrc p ON ui.product_id = p.product_id
LEFT JOIN c_orders o ON ui.order_id = o.order_id""")
def _final_src(c):
    uf = FT.user_features_src(clean.clean_orders(c.orders), c.basket, c.products)
    pf = FT.product_features_src(c.basket, clean.enrich_products(c.products, c.aisles, c.departments))
    return FT.final_dataset_src(c.basket, c.orders, uf, pf)


NB = BASE + ",\n" + mode_cte("uhour", "po", "user_id", "order_hour_of_day", "user_preferred_hour") + ",\n" + \
    mode_cte("udow", "po", "user_id", "order_dow", "user_preferred_dow") + ",\n" + \
    mode_cte("prhour", "pb", "product_id", "order_hour_of_day", "product_preferred_hour") + ",\n" + \
    mode_cte("prdow", "pb", "product_id", "order_dow", "product_preferred_dow") + """,
a8 AS (SELECT b.user_id, b.user_total_orders,
              coalesce(b.user_avg_days_between_orders, 0.0) AS user_avg_days_between_orders,
              coalesce(b.user_min_days_between_orders, 0.0) AS user_min_days_between_orders,
              coalesce(b.user_max_days_between_orders, 0.0) AS user_max_days_between_orders,
              coalesce(b.user_std_days_between_orders, 0.0) AS user_std_days_between_orders,
              coalesce(h.user_preferred_hour, 0) AS user_preferred_hour,
              coalesce(d.user_preferred_dow, 0) AS user_preferred_dow,
              coalesce(s.user_total_products, 0) AS user_total_products,
              coalesce(s.user_avg_basket_size, 0.0) AS user_avg_basket_size,
              coalesce(i.user_unique_products, 0) AS user_unique_products,
              coalesce(i.user_reorder_rate, 0.0) AS user_reorder_rate
  FROM (SELECT user_id, count(*) AS user_total_orders, avg(days_since_prior_order) AS user_avg_days_between_orders,
               min(days_since_prior_order) AS user_min_days_between_orders,
               max(days_since_prior_order) AS user_max_days_between_orders,
               stddev_samp(days_since_prior_order) AS user_std_days_between_orders
        FROM po GROUP BY user_id) b
  LEFT JOIN uhour h ON b.user_id = h.user_id LEFT JOIN udow d ON b.user_id = d.user_id
  LEFT JOIN (SELECT user_id, CAST(sum(n) AS BIGINT) AS user_total_products, avg(n) AS user_avg_basket_size
             FROM (SELECT user_id, order_id, count(*) AS n FROM pb GROUP BY ALL) GROUP BY user_id) s
    ON b.user_id = s.user_id
  LEFT JOIN (SELECT user_id, count(DISTINCT product_id) AS user_unique_products, avg(reordered) AS user_reorder_rate
             FROM pb GROUP BY user_id) i ON b.user_id = i.user_id),
a8b AS (SELECT p.product_id, p.aisle_id, p.department_id,
               coalesce(s.product_total_orders, 0) AS product_total_orders,
               coalesce(s.product_reorder_rate, 0.0) AS product_reorder_rate,
               coalesce(s.product_reorder_count, 0) AS product_reorder_count,
               coalesce(s.product_total_purchases, 0) AS product_total_purchases,
               coalesce(s.product_avg_cart_position, 0.0) AS product_avg_cart_position,
               coalesce(s.product_unique_users, 0) AS product_unique_users,
               coalesce(h.product_preferred_hour, 0) AS product_preferred_hour,
               coalesce(d.product_preferred_dow, 0) AS product_preferred_dow
  FROM c_products p
  LEFT JOIN (SELECT product_id, count(*) AS product_total_orders, avg(reordered) AS product_reorder_rate,
                    CAST(sum(reordered) AS BIGINT) AS product_reorder_count, count(reordered) AS product_total_purchases,
                    avg(add_to_cart_order) AS product_avg_cart_position,
                    count(DISTINCT user_id) AS product_unique_users FROM pb GROUP BY product_id) s
    ON p.product_id = s.product_id
  LEFT JOIN prhour h ON p.product_id = h.product_id LEFT JOIN prdow d ON p.product_id = d.product_id),
a8c AS (SELECT h.*, u.user_max_order_number, u.user_total_orders,
               u.user_max_order_number - h.up_last_order_number
                 AS up_days_since_last_purchase,
               h.up_orders_count / u.user_total_orders AS up_order_rate,
               coalesce(h.up_reorder_count / h.up_orders_count, 0.0) AS up_reorder_rate
  FROM (SELECT user_id, product_id, count(order_id) AS up_orders_count,
               CAST(sum(reordered) AS BIGINT) AS up_reorder_count, avg(add_to_cart_order) AS up_avg_cart_position,
               max(order_number) AS up_last_order_number FROM pb GROUP BY user_id, product_id) h
  JOIN (SELECT user_id, max(order_number) AS user_max_order_number, count(*) AS user_total_orders
        FROM po GROUP BY user_id) u ON h.user_id = u.user_id)"""

TRAIN_FEATURES = """
       u.user_total_orders AS user_total_orders_x, u.user_avg_days_between_orders, u.user_min_days_between_orders,
       u.user_max_days_between_orders, u.user_std_days_between_orders, u.user_preferred_hour,
       u.user_preferred_dow, u.user_total_products, u.user_avg_basket_size, u.user_unique_products,
       u.user_reorder_rate,
       p.aisle_id, p.department_id, p.product_total_orders, p.product_reorder_rate, p.product_reorder_count,
       p.product_total_purchases, p.product_avg_cart_position, p.product_unique_users, p.product_preferred_hour,
       p.product_preferred_dow,
       coalesce(x.up_orders_count, 0) AS up_orders_count, coalesce(x.up_reorder_count, 0) AS up_reorder_count,
       coalesce(x.up_avg_cart_position, 0.0) AS up_avg_cart_position,
       coalesce(x.up_last_order_number, 0) AS up_last_order_number,
       coalesce(x.user_max_order_number, 0) AS user_max_order_number,
       coalesce(x.up_days_since_last_purchase, 999) AS up_days_since_last_purchase,
       coalesce(x.user_total_orders, 0) AS user_total_orders_y,
       coalesce(x.up_order_rate, 0.0) AS up_order_rate, coalesce(x.up_reorder_rate, 0.0) AS up_reorder_rate"""


@query("user_features", "A8,T1,T3,T12", ctes=NB, sql="SELECT * FROM a8")
def _a8(c):
    return FT.user_features(c.orders, c.basket)


@query("product_features", "A8b,J5", ctes=NB, sql="SELECT * FROM a8b")
def _a8b(c):
    return FT.product_features(c.basket, c.products)


@query("user_product_features", "A8c", ctes=NB, sql="SELECT * FROM a8c")
def _a8c(c):
    return FT.user_product_features(c.orders, c.basket)


TRAINING_SQL = f"""
SELECT t.user_id, t.product_id, t.reordered, {TRAIN_FEATURES}
FROM (SELECT user_id, product_id, reordered FROM c_basket WHERE eval_set = 'train') t
LEFT JOIN a8 u ON t.user_id = u.user_id LEFT JOIN a8b p ON t.product_id = p.product_id
LEFT JOIN a8c x ON t.user_id = x.user_id AND t.product_id = x.product_id"""


@query("training_set", "A8d,J4,J6,P21,P23", ctes=NB, sql=TRAINING_SQL)
def _a8d(c):
    return FT.training_set(c.orders, c.basket, c.products)


CANDIDATES_SQL = f"""
SELECT x.user_id, x.product_id,
       CASE WHEN t.product_id IS NULL THEN 0 ELSE 1 END AS reordered, {TRAIN_FEATURES}
FROM a8c x
LEFT JOIN (SELECT user_id, product_id FROM c_basket WHERE eval_set = 'train') t
  ON x.user_id = t.user_id AND x.product_id = t.product_id
LEFT JOIN a8 u ON x.user_id = u.user_id LEFT JOIN a8b p ON x.product_id = p.product_id
WHERE x.user_id IN (SELECT user_id FROM c_basket WHERE eval_set = 'train')"""


@query("candidate_training_set", "A8d,J11", ctes=NB, sql=CANDIDATES_SQL)
def _cands(c):
    return FT.candidate_training_set(c.orders, c.basket, c.products)


@query("dataset_cardinality", "Q14", ctes=NB + ", ts AS (" + TRAINING_SQL + ")", sql="""
SELECT count(DISTINCT user_id) AS users, count(DISTINCT product_id) AS products, count(*) AS rows,
       avg(reordered) AS positive_rate FROM ts""")
def _q14(c):
    return FT.dataset_cardinality(FT.training_set(c.orders, c.basket, c.products))


@query("feature_histogram_by_label", "A31", ctes=NB + ", cand AS (" + CANDIDATES_SQL + """),
v AS (SELECT reordered, CAST(up_order_rate AS DOUBLE) AS x FROM cand WHERE up_order_rate IS NOT NULL),
r AS (SELECT reordered, count(*) AS n,
             CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
             CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM v GROUP BY reordered),
cnt AS (SELECT v.reordered, CAST(least(floor((x - lo) * 50.0 / (hi - lo)), 49) AS INTEGER) AS bin, count(*) AS k
        FROM v JOIN r ON v.reordered = r.reordered GROUP BY 1, 2),
grid AS (SELECT reordered, CAST(b AS INTEGER) AS bin, lo, hi, n FROM r, range(0, 50) t(b))""", sql="""
SELECT g.reordered, g.bin, g.lo + g.bin * ((g.hi - g.lo) / 50.0) AS bin_start,
       g.lo + (g.bin + 1) * ((g.hi - g.lo) / 50.0) AS bin_end, coalesce(cnt.k, 0) AS count,
       coalesce(cnt.k, 0) / (g.n * ((g.lo + (g.bin + 1) * ((g.hi - g.lo) / 50.0))
                                   - (g.lo + g.bin * ((g.hi - g.lo) / 50.0)))) AS density
FROM grid g LEFT JOIN cnt ON g.reordered = cnt.reordered AND g.bin = cnt.bin""")
def _feature_hist(c):
    from basketlens.operators.behaviour import histogram
    return histogram(FT.candidate_training_set(c.orders, c.basket, c.products), "up_order_rate", FX.LABEL_HIST_BINS, by=["reordered"])


NAME_CTES = """
n_ids AS (SELECT CAST(row_number() OVER (ORDER BY p_name) AS BIGINT) AS name_id, p_name
          FROM (SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL)),
n_products AS (SELECT i.name_id AS product_id, i.p_name AS product_name,
                      min(CAST(substr(p.p_brand, 7) AS INTEGER)) AS aisle_id, min(d.department_id) AS department_id
               FROM part p JOIN n_ids i ON p.p_name = i.p_name
               LEFT JOIN c_departments d ON p.p_type = d.department GROUP BY i.name_id, i.p_name),
n_basket0 AS (SELECT b.order_id, i.name_id AS product_id, min(b.add_to_cart_order) AS add_to_cart_order,
                     min(b.eval_set) AS eval_set, min(b.user_id) AS user_id, min(b.order_number) AS order_number,
                     min(b.order_dow) AS order_dow, min(b.order_hour_of_day) AS order_hour_of_day,
                     min(b.days_since_prior_order) AS days_since_prior_order
              FROM c_basket b JOIN part p ON b.product_id = p.p_partkey JOIN n_ids i ON p.p_name = i.p_name
              GROUP BY b.order_id, i.name_id),
n_basket AS (SELECT order_id, product_id, add_to_cart_order,
                    CAST(CASE WHEN order_number > min(order_number) OVER (PARTITION BY user_id, product_id)
                              THEN 1 ELSE 0 END AS INTEGER) AS reordered,
                    eval_set, user_id, order_number, order_dow, order_hour_of_day, days_since_prior_order
             FROM n_basket0)"""
NAME_NB = NAME_CTES + "," + NB.replace("c_basket", "n_basket").replace("c_products", "n_products")
NAME_CANDIDATES_SQL = CANDIDATES_SQL.replace("c_basket", "n_basket")


@query("name_level_products", "M-key (SURVEY 7.1)", ctes=NAME_CTES, sql="SELECT * FROM n_products")
def _name_products(c):
    return c.name_products


@query("name_level_basket_summary", "M-key (SURVEY 7.1)", ctes=NAME_CTES, sql="""
SELECT eval_set, count(*) AS lines, CAST(sum(reordered) AS BIGINT) AS reorders,
       count(DISTINCT product_id) AS names FROM n_basket GROUP BY eval_set""")
def _name_basket_summary(c):
    from pyspark.sql import functions as F
    return c.name_basket.groupBy("eval_set").agg(F.count(F.lit(1)).alias("lines"),
                                                 F.sum("reordered").cast("long").alias("reorders"),
                                                 F.countDistinct("product_id").alias("names"))


@query("name_level_candidate_set", "A8d,J11 (name key)", ctes=NAME_NB, sql=NAME_CANDIDATES_SQL)
def _name_cands(c):
    return FT.candidate_training_set(c.orders, c.name_basket, c.name_products)
