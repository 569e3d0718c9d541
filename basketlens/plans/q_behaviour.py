"""Dashboard aggregates: A11, A23-A34, A37, G1, G2, P9, W3, W8."""

from pyspark.sql import functions as F

from basketlens.functions import fixed as FX
from basketlens.operators import behaviour as B
from basketlens.operators import kpi
from basketlens.plans.registry import query

USER_METRICS = """
um AS (SELECT user_id, count(*) AS total_orders, max(order_number) AS max_order_num,
              avg(days_since_prior_order) AS avg_days_between FROM c_orders GROUP BY user_id)"""


@query("overview_kpis", "A11,T4", ctes="""
bs AS (SELECT order_id, count(*) AS n FROM c_prior GROUP BY order_id),
pu AS (SELECT user_id, count(*) AS n, max(CASE WHEN order_number > 5 THEN 1 ELSE 0 END) AS ret
       FROM c_orders GROUP BY user_id),
det AS (SELECT i.product_id, d.department FROM c_prior i
        LEFT JOIN c_products p ON i.product_id = p.product_id
        LEFT JOIN c_departments d ON p.department_id = d.department_id)""", sql="""
SELECT (SELECT count(*) FROM c_orders) AS total_orders,
       (SELECT count(DISTINCT user_id) FROM c_orders) AS active_users,
       (SELECT avg(CASE WHEN order_number > 1 THEN 1 ELSE 0 END) * 100 FROM c_orders) AS repeat_order_pct,
       (SELECT avg(days_since_prior_order) FROM c_orders) AS avg_days_between_orders,
       (SELECT avg(CASE WHEN order_dow IN (0, 6) THEN 1 ELSE 0 END) * 100 FROM c_orders) AS weekend_orders_pct,
       (SELECT avg(CASE WHEN order_hour_of_day BETWEEN 10 AND 16 THEN 1 ELSE 0 END) * 100 FROM c_orders)
         AS peak_hours_pct,
       (SELECT count(*) FROM c_prior) AS total_products_sold,
       (SELECT avg(n) FROM bs) AS avg_basket_size,
       (SELECT avg(n) FROM pu) AS orders_per_user,
       (SELECT avg(ret) * 100 FROM pu) AS user_retention_rate,
       (SELECT count(DISTINCT product_id) FROM det) AS unique_products,
       (SELECT count(DISTINCT department) FROM det) AS departments_count""")
def _overview(c):
    return B.overview_kpis(c.orders, c.items("prior"), c.products, c.departments)


SEGMENT_FILTERS = [("All Users", "TRUE"), ("New Users (1-5 orders)", "order_number <= 5"),
                   ("Regular Users (6-20 orders)", "order_number BETWEEN 6 AND 20"),
                   ("Heavy Users (20+ orders)", "order_number >= 20")]


@query("segment_sizes", "P9", sql=" UNION ALL ".join(
    f"SELECT '{n}' AS segment, count(*) AS orders, count(DISTINCT user_id) AS users FROM c_orders WHERE {w}"
    for n, w in SEGMENT_FILTERS))
def _segment_sizes(c):
    return B.segment_sizes(c.orders)


@query("time_headline", "A26,P9", sql=" UNION ALL ".join(
    f"""SELECT '{n}' AS segment, avg(order_number) AS avg_order_number, count(DISTINCT user_id) AS active_users,
       (SELECT order_hour_of_day FROM c_orders WHERE {w} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS peak_hour,
       (SELECT order_dow FROM c_orders WHERE {w} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS peak_dow
FROM c_orders WHERE {w}""" for n, w in SEGMENT_FILTERS))
def _time_headline(c):
    return B.time_headline(c.orders)


@query("dow_stats", "A24", sql="""
SELECT order_dow, count(*) AS total_orders, count(DISTINCT user_id) AS unique_users,
       avg(order_number) AS avg_order_number,
       count(*) / count(DISTINCT user_id) AS orders_per_user,
       ['Sunday','Monday','Tuesday','Wednesday','Thursday','Friday','Saturday'][order_dow + 1] AS day_name
FROM c_orders GROUP BY order_dow""")
def _dow_stats(c):
    return B.dow_stats(c.orders)


@query("peak_counts", "A25,P13", sql="""
SELECT 'Peak Hours (10-16)' AS category, count(*) FILTER (WHERE order_hour_of_day BETWEEN 10 AND 16) AS orders FROM c_orders
UNION ALL SELECT 'Off-Peak Hours', count(*) FILTER (WHERE NOT order_hour_of_day BETWEEN 10 AND 16) FROM c_orders
UNION ALL SELECT 'Peak Days (Sun,Mon,Sat)', count(*) FILTER (WHERE order_dow IN (0, 1, 6)) FROM c_orders
UNION ALL SELECT 'Off-Peak Days', count(*) FILTER (WHERE order_dow NOT IN (0, 1, 6)) FROM c_orders""")
def _peak_counts(c):
    return B.peak_counts(c.orders)


@query("order_number_distribution", "A27", sql="""
SELECT order_number, count(*) AS orders FROM c_orders GROUP BY order_number""")
def _order_number_distribution(c):
    return B.order_number_distribution(c.orders)


@query("journey_stages", "A28,P17", sql="""
SELECT CASE WHEN m = 1 THEN 'One-time Buyer' WHEN m <= 5 THEN 'New Customer'
            WHEN m <= 15 THEN 'Regular Customer' ELSE 'Loyal Customer' END AS stage, count(*) AS users
FROM (SELECT user_id, max(order_number) AS m FROM c_orders GROUP BY user_id) GROUP BY stage""")
def _journey(c):
    return B.journey_stages(c.orders)


@query("retention_curve", "W3", sql="""
SELECT max_order_number, users,
       100.0 - sum(users) OVER (ORDER BY max_order_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
               * 100.0 / sum(users) OVER () AS retention_pct
FROM (SELECT max_order_number, count(*) AS users
      FROM (SELECT user_id, max(order_number) AS max_order_number FROM c_orders GROUP BY user_id)
      GROUP BY max_order_number)""")
def _retention(c):
    return B.retention_curve(c.orders)


@query("lifecycle_metrics", "A29,A30", ctes=USER_METRICS, sql="""
SELECT avg(total_orders) AS avg_orders, avg(max_order_num) AS avg_lifetime,
       avg(avg_days_between) AS avg_frequency,
       avg(CASE WHEN total_orders >= 10 THEN 1 ELSE 0 END) * 100 AS loyalty_rate,
       count(*) FILTER (WHERE total_orders >= 10) AS loyal_customers FROM um""")
def _lifecycle(c):
    return B.lifecycle_metrics(c.orders)


def _hist_sql(source: str, col: str, bins: int) -> str:
    return f"""
v AS (SELECT CAST({col} AS DOUBLE) AS x FROM {source} WHERE {col} IS NOT NULL),
r AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
             CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM v),
cnt AS (SELECT CAST(least(floor((x - lo) * {float(bins)} / (hi - lo)), {bins - 1}) AS INTEGER) AS bin,
               count(*) AS n FROM v, r GROUP BY bin),
grid AS (SELECT CAST(b AS INTEGER) AS bin, lo, hi FROM r, range(0, {bins}) t(b))""", f"""
SELECT g.bin, g.lo + g.bin * ((g.hi - g.lo) / {float(bins)}) AS bin_start,
       g.lo + (g.bin + 1) * ((g.hi - g.lo) / {float(bins)}) AS bin_end, coalesce(cnt.n, 0) AS count
FROM grid g LEFT JOIN cnt ON g.bin = cnt.bin"""


_c, _s = _hist_sql("c_orders", "days_since_prior_order", FX.GAP_BINS)


@query("gap_histogram", "A31,P11", ctes=_c, sql=_s)
def _gap_hist(c):
    return B.histogram(c.orders, "days_since_prior_order", FX.GAP_BINS)


_c, _s = _hist_sql("(SELECT order_id, count(*) AS n FROM c_basket WHERE eval_set IN ('prior', 'train') GROUP BY order_id)", "n", 30)


@query("basket_size_histogram", "A31", ctes=_c, sql=_s)
def _basket_hist(c):
    return B.histogram(kpi.basket_sizes(kpi.all_items(c.items("prior"), c.items("train"))), "basket_size", FX.BASKET_BINS)


_c, _s = _hist_sql("(SELECT user_id, count(*) AS n FROM c_orders GROUP BY user_id)", "n", FX.DIST_BINS)


@query("orders_per_user_histogram", "A31", ctes=_c, sql=_s)
def _opu_hist(c):
    return B.histogram(B.user_metrics(c.orders), "total_orders", FX.DIST_BINS)


@query("gap_box_by_order_group", "A32,P14", ctes="""
g AS (SELECT days_since_prior_order AS x,
             CASE WHEN order_number > 0 AND order_number <= 5 THEN '1-5'
                  WHEN order_number > 5 AND order_number <= 10 THEN '6-10'
                  WHEN order_number > 10 AND order_number <= 20 THEN '11-20'
                  WHEN order_number > 20 AND order_number <= 100 THEN '20+' END AS order_group
      FROM c_orders WHERE days_since_prior_order IS NOT NULL)""", sql="""
SELECT order_group, min(x) AS min, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
       quantile_cont(x, 0.75) AS q3, max(x) AS max
FROM g WHERE order_group IS NOT NULL GROUP BY order_group""")
def _gap_box(c):
    return B.gap_box_by_order_group(c.orders)


@query("frequency_bins", "A34,P15,T9", sql="""
SELECT CASE WHEN m >= 1 AND m < 5 THEN '1-4' WHEN m >= 5 AND m < 10 THEN '5-9'
            WHEN m >= 10 AND m < 20 THEN '10-19' WHEN m >= 20 AND m < 50 THEN '20-49'
            WHEN m >= 50 AND m < 100 THEN '50+' END AS frequency_bin, count(*) AS users
FROM (SELECT user_id, max(order_number) AS m FROM c_orders GROUP BY user_id) GROUP BY frequency_bin""")
def _frequency_bins(c):
    return B.frequency_bins(c.orders)


@query("user_profiles", "A23", ctes="""
dm AS (SELECT user_id, order_dow AS v, count(*) AS n FROM c_orders GROUP BY ALL),
hm AS (SELECT user_id, order_hour_of_day AS v, count(*) AS n FROM c_orders GROUP BY ALL),
dmode AS (SELECT user_id, v AS preferred_dow FROM
          (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, v) AS rn FROM dm) WHERE rn = 1),
hmode AS (SELECT user_id, v AS preferred_hour FROM
          (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, v) AS rn FROM hm) WHERE rn = 1)""",
       sql="""
SELECT b.*, d.preferred_dow, h.preferred_hour FROM (
  SELECT user_id, count(*) AS total_orders, max(order_number) AS max_order_number,
         avg(days_since_prior_order) AS avg_days_between,
         count(*) FILTER (WHERE order_number > 1) / count(*) AS reorder_ratio
  FROM c_orders GROUP BY user_id) b
LEFT JOIN dmode d ON b.user_id = d.user_id LEFT JOIN hmode h ON b.user_id = h.user_id""")
def _profiles(c):
    return B.user_profiles(c.orders)


@query("user_order_count", "A37", sql="SELECT count(*) AS orders FROM c_orders WHERE user_id = 1")
def _user_order_count(c):
    return B.user_order_count(c.orders, 1)


@query("dow_hour_heatmap", "G1", sql="SELECT order_dow, " + ", ".join(
    f'count(*) FILTER (WHERE order_hour_of_day = {h}) AS "{h}"' for h in range(24))
    + " FROM c_orders GROUP BY order_dow")
def _heatmap(c):
    return B.dow_hour_heatmap(c.orders)


RF_SCORES = USER_METRICS + """,
uf AS (SELECT *, coalesce(avg_days_between, 30.0) AS avg_days_filled FROM um),
e AS (SELECT quantile_cont(avg_days_filled, [0.0, 0.25, 0.5, 0.75, 1.0]) AS re,
             quantile_cont(total_orders, [0.0, 0.25, 0.5, 0.75, 1.0]) AS fe FROM uf),
sc AS (SELECT user_id, total_orders, avg_days_filled,
  CASE WHEN avg_days_filled >= re[1] AND avg_days_filled <= re[2] THEN 'High'
       WHEN avg_days_filled <= re[3] THEN 'Medium-High' WHEN avg_days_filled <= re[4] THEN 'Medium-Low'
       WHEN avg_days_filled <= re[5] THEN 'Low' END AS recency_score,
  CASE WHEN total_orders >= fe[1] AND total_orders <= fe[2] THEN 'Low'
       WHEN total_orders <= fe[3] THEN 'Medium-Low' WHEN total_orders <= fe[4] THEN 'Medium-High'
       WHEN total_orders <= fe[5] THEN 'High' END AS frequency_score
  FROM uf, e)"""


@query("recency_frequency_scores", "W8,T8", ctes=RF_SCORES, sql="SELECT * FROM sc")
def _rf_scores(c):
    return B.recency_frequency_scores(c.orders)


@query("frequency_recency_crosstab", "G2", ctes=RF_SCORES, sql="""
SELECT CASE WHEN grouping(frequency_score) = 1 THEN 'Total' ELSE frequency_score END AS frequency_score,
       CASE WHEN grouping(recency_score) = 1 THEN 'Total' ELSE recency_score END AS recency_score,
       count(*) AS users
FROM sc GROUP BY CUBE (frequency_score, recency_score)""")
def _crosstab(c):
    return B.frequency_recency_crosstab(c.orders)


@query("eval_split_counts", "P10", sql="""
SELECT CASE WHEN eval_set = 'prior' THEN 'train' WHEN eval_set IN ('train', 'test') THEN 'test' END AS side,
       count(*) AS orders, count(DISTINCT user_id) AS users FROM c_orders GROUP BY 1""")
def _eval_split(c):
    return B.eval_split_counts(c.orders)


@query("hour_modes", "A33", sql="""
SELECT order_hour_of_day, n FROM (SELECT order_hour_of_day, count(*) AS n FROM c_orders GROUP BY 1)
WHERE n = (SELECT max(n) FROM (SELECT count(*) AS n FROM c_orders GROUP BY order_hour_of_day))""")
def _hour_modes(c):
    from basketlens.operators.stats import all_modes
    return all_modes(c.orders, "order_hour_of_day")


@query("recency_bands", "P26", ctes="""
l AS (SELECT o_custkey AS user_id,
             date_diff('day', CAST(max(o_orderdate) AS DATE), CAST((SELECT max(o_orderdate) FROM orders) AS DATE)) AS d
      FROM orders GROUP BY o_custkey)""", sql="""
SELECT CASE WHEN d <= 90 THEN '0-90' WHEN d <= 180 THEN '91-180' WHEN d <= 365 THEN '181-365' ELSE '>365' END
         AS band, count(*) AS users FROM l GROUP BY 1""")
def _recency_bands(c):
    return B.recency_bands(c.raw("orders"))


_c, _s = _hist_sql("""(SELECT o.user_id, round_even(avg(i.reordered), 3) AS rate FROM
  (SELECT * FROM c_prior UNION ALL SELECT * FROM c_train) i JOIN c_orders o ON i.order_id = o.order_id
  GROUP BY o.user_id)""", "rate", FX.DIST_BINS)


@query("reorder_rate_histogram", "A31,A19", ctes=_c, sql=_s)
def _rate_hist(c):
    items = kpi.all_items(c.items("prior"), c.items("train"))
    rates = (items.join(c.orders.select("order_id", "user_id"), "order_id").groupBy("user_id")
             .agg(F.bround(F.avg("reordered"), 3).alias("rate")))
    return B.histogram(rates, "rate", FX.DIST_BINS)


_c, _s = _hist_sql("(SELECT user_id, avg(days_since_prior_order) AS g FROM c_orders GROUP BY user_id)", "g", FX.DIST_BINS)


@query("avg_gap_histogram", "A31,A29", ctes=_c, sql=_s)
def _avg_gap_hist(c):
    return B.histogram(B.user_metrics(c.orders), "avg_days_between", FX.DIST_BINS)
