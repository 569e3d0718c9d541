"""Data-quality jobs: Q1, Q2/Q5, Q6-Q13, Q15-Q17, J10, U3."""

from functools import reduce

from pyspark.sql import DataFrame

from basketlens.operators import quality as Q
from basketlens.plans.registry import query

# canonical table -> (CTE name, [(column, spark type)])
TABLES = {
    "orders": ("c_orders", [("order_id", "bigint"), ("user_id", "bigint"), ("eval_set", "string"),
                            ("order_number", "int"), ("order_dow", "int"), ("order_hour_of_day", "int"),
                            ("days_since_prior_order", "double")]),
    "order_products": ("c_items", [("order_id", "bigint"), ("product_id", "bigint"),
                                   ("add_to_cart_order", "int"), ("reordered", "int"), ("eval_set", "string")]),
    "products": ("c_products", [("product_id", "bigint"), ("product_name", "string"), ("aisle_id", "int"),
                                ("department_id", "int")]),
    "aisles": ("c_aisles", [("aisle_id", "int"), ("aisle", "string")]),
    "departments": ("c_departments", [("department_id", "int"), ("department", "string")]),
}


def _frames(c) -> dict[str, DataFrame]:
    return {"orders": c.orders, "order_products": c.order_products, "products": c.products,
            "aisles": c.aisles, "departments": c.departments}


def _union(parts):
    return reduce(DataFrame.unionByName, parts)


def _dup_sql(cte):
    return f"(SELECT count(*) FROM {cte}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {cte}))"


_summary_sql = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS \"table\", count(*) AS rows, {len(cols)} AS cols, "
    f"CAST({' + '.join(f'count(*) FILTER (WHERE {n} IS NULL)' for n, _ in cols)} AS BIGINT) AS total_nulls, "
    f"({' + '.join(f'count(*) FILTER (WHERE {n} IS NULL)' for n, _ in cols)}) * 100.0 / (count(*) * {len(cols)}) AS null_pct, "
    f"CAST({_dup_sql(cte)} AS BIGINT) AS duplicate_rows FROM {cte}"
    for t, (cte, cols) in TABLES.items())


@query("table_summary", "Q1,Q5", sql=_summary_sql)
def _table_summary(c):
    return _union([Q.table_summary(n, df) for n, df in _frames(c).items()])


_profile_sql = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS \"table\", '{n}' AS \"column\", '{ty}' AS dtype, "
    f"count(*) FILTER (WHERE {n} IS NULL) AS nulls, "
    f"count(*) FILTER (WHERE {n} IS NULL) * 100.0 / count(*) AS null_pct FROM {cte}"
    for t, (cte, cols) in TABLES.items() for n, ty in cols)


@query("column_profile", "Q2,Q5", sql=_profile_sql)
def _column_profile(c):
    return _union([Q.column_profile(n, df) for n, df in _frames(c).items()])


@query("null_audit", "Q13", sql=f"SELECT * FROM ({_profile_sql}) WHERE nulls > 0")
def _null_audit(c):
    return _union([Q.null_audit(n, df) for n, df in _frames(c).items()])


@query("duplicate_report", "Q6", sql="\nUNION ALL\n".join(
    f"SELECT '{t}' AS \"table\", CAST({_dup_sql(cte)} AS BIGINT) AS duplicate_rows, "
    f"({_dup_sql(cte)}) * 100.0 / (SELECT count(*) FROM {cte}) AS duplicate_pct"
    for t, (cte, _) in TABLES.items()))
def _duplicate_report(c):
    return _union([Q.duplicate_report(n, df) for n, df in _frames(c).items()])


ID_COLS = [("orders", "c_orders", ["order_id", "user_id"]),
           ("order_products", "c_items", ["order_id", "product_id"]),
           ("products", "c_products", ["product_id", "aisle_id", "department_id"])]


@query("id_ranges", "Q7", sql="\nUNION ALL\n".join(
    f"SELECT '{t}' AS \"table\", '{col}' AS \"column\", CAST(min({col}) AS BIGINT) AS min, "
    f"CAST(max({col}) AS BIGINT) AS max, count(DISTINCT {col}) AS nunique, count(*) AS rows FROM {cte}"
    for t, cte, cols in ID_COLS for col in cols))
def _id_ranges(c):
    f = _frames(c)
    return _union([Q.id_ranges(t, f[t], cols) for t, _, cols in ID_COLS])


FK = [("prior.order_id in orders", "c_prior", "order_id", "c_orders", "order_id"),
      ("train.order_id in orders", "c_train", "order_id", "c_orders", "order_id"),
      ("items.product_id in products", "c_items", "product_id", "c_products", "product_id"),
      ("products.aisle_id in aisles", "c_products", "aisle_id", "c_aisles", "aisle_id"),
      ("products.department_id in departments", "c_products", "department_id", "c_departments", "department_id"),
      ("orders.user_id in users", "c_orders", "user_id", "c_users", "user_id")]


@query("fk_checks", "Q8,Q9,J10,U3", sql="\nUNION ALL\n".join(
    f"SELECT '{n}' AS \"check\", count(*) AS missing, count(*) = 0 AS all_present FROM "
    f"(SELECT DISTINCT {k} FROM {ch} WHERE {k} IS NOT NULL EXCEPT SELECT {pk} FROM {par})"
    for n, ch, k, par, pk in FK))
def _fk_checks(c):
    tables = {"c_prior": c.items("prior"), "c_train": c.items("train"), "c_items": c.order_products,
              "c_orders": c.orders, "c_products": c.products, "c_aisles": c.aisles,
              "c_departments": c.departments, "c_users": c.users}
    return Q.fk_checks([(n, tables[ch], k, tables[par], pk) for n, ch, k, par, pk in FK])


@query("duplicate_line_pairs", "Q10", sql="""
SELECT CAST(count(*) - count(DISTINCT (l_orderkey, l_partkey)) AS BIGINT) AS duplicate_pairs FROM lineitem""")
def _dup_pairs(c):
    return Q.duplicate_pairs(c.raw("lineitem"), "l_orderkey", "l_partkey")


@query("missing_product_names", "Q11", sql="""
SELECT count(*) FILTER (WHERE product_name IS NULL) AS missing_product_name FROM c_products""")
def _missing_names(c):
    return Q.missing_count(c.products, "product_name")


DESCRIBE_COLS = ["order_number", "order_dow", "order_hour_of_day", "days_since_prior_order"]


@query("describe_orders", "Q12,T13", sql="\nUNION ALL\n".join(
    f"SELECT '{col}' AS \"column\", count({col}) AS count, avg({col}) AS mean, stddev_samp({col}) AS std, "
    f"CAST(min({col}) AS DOUBLE) AS min, CAST(max({col}) AS DOUBLE) AS max, "
    f"quantile_cont({col}, 0.25) AS p25, quantile_cont({col}, 0.5) AS p50, quantile_cont({col}, 0.75) AS p75 "
    f"FROM c_orders" for col in DESCRIBE_COLS))
def _describe(c):
    return Q.describe(c.orders, DESCRIBE_COLS)


_INT_ORDER_COLS = ["order_id", "user_id", "order_number", "order_dow", "order_hour_of_day"]


@query("narrow_types", "Q15,P1", sql="SELECT *, CASE WHEN min >= -128 AND max <= 127 THEN 'tinyint' "
       "WHEN min >= -32768 AND max <= 32767 THEN 'smallint' "
       "WHEN min >= -2147483648 AND max <= 2147483647 THEN 'int' ELSE 'bigint' END AS narrow_type FROM ("
       + "\nUNION ALL\n".join(f"SELECT '{col}' AS \"column\", CAST(min({col}) AS BIGINT) AS min, "
                              f"CAST(max({col}) AS BIGINT) AS max FROM c_orders" for col in _INT_ORDER_COLS) + ")")
def _narrow(c):
    return Q.narrow_types(c.orders)


@query("low_cardinality", "Q16", sql="""
SELECT *, nunique / rows AS ratio, nunique / rows < 0.5 AS low_cardinality FROM (
  SELECT 'product_name' AS "column", count(DISTINCT product_name) AS nunique, count(*) AS rows FROM c_products)""")
def _low_card(c):
    return Q.low_cardinality(c.products)


OUTLIER_COLS = ["order_number", "days_since_prior_order"]


@query("outlier_counts", "Q17", sql="\nUNION ALL\n".join(
    f"""SELECT '{col}' AS "column",
       count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS iqr_outliers,
       count(*) FILTER (WHERE abs(x - mu) > 3.0 * sd) AS z_outliers
FROM (SELECT {col} AS x FROM c_orders),
     (SELECT quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.75) AS q3,
             avg({col}) AS mu, stddev_samp({col}) AS sd FROM c_orders)""" for col in OUTLIER_COLS))
def _outliers(c):
    return Q.outlier_counts(c.orders, OUTLIER_COLS)


def _sample_sql(name, cte, cols, key):
    return (f"SELECT '{name}' AS \"table\", CAST(to_json(struct_pack({', '.join(f'{c} := {c}' for c in cols)})) AS VARCHAR) AS row_json "
            f"FROM (SELECT * FROM {cte} ORDER BY {key} LIMIT 5) WHERE (SELECT count(*) FROM {cte}) <= 1000")


@query("catalog_samples", "Q2,Q3", sql=" UNION ALL ".join([
    _sample_sql("aisles", "c_aisles", ["aisle_id", "aisle"], "aisle_id"),
    _sample_sql("departments", "c_departments", ["department_id", "department"], "department_id"),
    _sample_sql("orders", "c_orders", [n for n, _ in TABLES["orders"][1]], "order_id")]))
def _catalog_samples(c):
    return Q.catalog_samples({"aisles": c.aisles, "departments": c.departments, "orders": c.orders})
