"""Sources and sinks as checked rows (S1-S11, S14-S16, Q4, W2): each writes a table, reads it back and gives its
fingerprint; the SQL twin takes the fingerprint of the table itself."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.operators import clean
from basketlens.operators import features as FT
from basketlens.operators import kpi
from basketlens.plans import jobs, q_features
from basketlens.plans.registry import query
from basketlens.session import ensure_checkpoint_dir
from basketlens.sources import readers, sinks
from basketlens.sources.fingerprint import fingerprint, fingerprint_sql

ORDERS = {"order_id": "int", "user_id": "int", "eval_set": "text", "order_number": "int", "order_dow": "int",
          "order_hour_of_day": "int", "days_since_prior_order": "double"}
ITEMS = {"order_id": "int", "product_id": "int", "add_to_cart_order": "int", "reordered": "int"}
PRODUCTS = {"product_id": "int", "product_name": "text", "aisle_id": "int", "department_id": "int"}
AISLES = {"aisle_id": "int", "aisle": "text"}
BY_DOW = {"order_dow": "int", "orders": "int"}
#: Whole-number columns of the feature table: equal in any engine.
FEATURES = {c: "int" for c in ("user_id", "product_id", "reordered", "user_total_orders_x", "user_total_products", "user_unique_products",
                               "product_total_orders", "product_unique_users", "up_orders_count", "up_last_order_number")}


def _root(c) -> str:
    return f"{ensure_checkpoint_dir(c.spark).rstrip('/')}/roundtrips/{uuid.uuid4().hex}"


def _row(op: str, table: str, df: DataFrame, cols: dict) -> DataFrame:
    return fingerprint(df, list(cols)).select(F.lit(op).alias("op"), F.lit(table).alias("table"), "rows", "h1", "h2", "h3", "h4")


def _row_sql(op: str, name: str, table: str, cols: dict) -> str:
    return f"SELECT '{op}' AS op, '{name}' AS \"table\", * FROM ({fingerprint_sql(table, cols)})"


def _all(rows: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


_FORMATS = [("S5 parquet", "orders", "c_orders", ORDERS), ("S6 csv, S1 read", "orders", "c_orders", ORDERS),
            ("S4 detected csv", "aisles", "c_aisles", AISLES), ("S4 detected parquet", "products", "c_products", PRODUCTS),
            ("S7 partitioned", "orders", "c_orders", ORDERS), ("S8 absent partition column", "products", "c_products", PRODUCTS),
            ("S2 read all", "aisles", "c_aisles", AISLES), ("S2 read all", "order_products__train", "c_train", ITEMS),
            ("W2 clustered", "order_products__prior", "c_prior", ITEMS)]


@query("sink_round_trips", "S1,S2,S4,S5,S6,S7,S8,W2", sql="\nUNION ALL\n".join(_row_sql(op, n, t, cols) for op, n, t, cols in _FORMATS))
def _sink_round_trips(c):
    root, spark = _root(c), c.spark
    sinks.write_parquet(c.orders, f"{root}/orders.parquet")
    sinks.write_csv(c.orders, f"{root}/raw/orders.csv")
    sinks.write_csv(c.aisles, f"{root}/raw/aisles.csv")
    sinks.write_csv(c.items("train"), f"{root}/raw/order_products__train.csv")
    sinks.write_parquet(c.products, f"{root}/products")
    sinks.write_partitioned(c.orders, f"{root}/by_set", ["eval_set", "absent"])
    sinks.write_partitioned(c.products, f"{root}/by_nothing", ["absent"])
    sinks.write_parquet(clean.cluster_items(c.items("prior")), f"{root}/clustered")
    both = readers.read_all(spark, f"{root}/raw", ["aisles", "order_products__train"])
    read = [readers.load(spark, f"{root}/orders.parquet"), readers.read_csv(spark, f"{root}/raw/orders.csv", readers.CONTRACTS["orders"]),
            readers.load(spark, f"{root}/raw/aisles.csv", schema=readers.CONTRACTS["aisles"]), readers.load(spark, f"{root}/products"),
            spark.read.parquet(f"{root}/by_set"), spark.read.parquet(f"{root}/by_nothing"),
            both["aisles"], both["order_products__train"], spark.read.parquet(f"{root}/clustered")]
    return _all([_row(op, n, df, cols) for (op, n, _, cols), df in zip(_FORMATS, read)])


_EXPORTS = [("S14 parquet", "training_set", "ts", FEATURES), ("S14 csv", "training_set", "ts", FEATURES),
            ("S15 csv", "predictions", "(SELECT user_id, product_id, CAST(up_orders_count >= 2 AS INTEGER) AS predicted_reordered FROM ts)",
             {"user_id": "int", "product_id": "int", "predicted_reordered": "int"}),
            ("S16 csv", "orders_by_day", "(SELECT order_dow, count(*) AS orders FROM c_orders GROUP BY 1)", BY_DOW)]


@query("export_round_trips", "S14,S15,S16", ctes=q_features.NB + ", ts AS (" + q_features.TRAINING_SQL + ")",
       sql="\nUNION ALL\n".join(_row_sql(op, n, t, cols) for op, n, t, cols in _EXPORTS))
def _export_round_trips(c):
    """The feature and prediction export jobs, and the KPI export's orders by day."""
    root, spark = _root(c), c.spark
    features = FT.training_set(c.orders, c.basket, c.products)
    jobs.export_features({"training_set": features}, root)
    back = spark.read.parquet(f"{root}/training_set.parquet")
    text = readers.read_csv(spark, f"{root}/training_set.csv", back.schema)
    pred = back.select("user_id", "product_id", (F.col("up_orders_count") >= 2).cast("int").alias("predicted_reordered"))
    jobs.export_predictions(pred, f"{root}/predictions.csv")
    sinks.export_kpis({"orders_by_day": kpi.orders_by_dow(c.orders)}, f"{root}/kpi")
    days = readers.read_csv(spark, f"{root}/kpi/orders_by_day").select(F.col("order_dow").cast("long"), F.col("orders").cast("long"))
    read = [back, text, readers.read_csv(spark, f"{root}/predictions.csv", pred.schema), days]
    return _all([_row(op, n, df, cols) for (op, n, _, cols), df in zip(_EXPORTS, read)])


@query("staging_round_trip", "S9,S10,S11", sql="\nUNION ALL\n".join(
    _row_sql(op, n, t, cols) for op, n, t, cols in [
        ("S9 staging, S10 read", "orders", "c_orders", ORDERS), ("S9 staging, S10 read", "aisles", "c_aisles", AISLES),
        ("S11 snapshot", "orders", "c_orders", ORDERS), ("S11 manifest", "orders", "c_orders", ORDERS)])
    + "\nUNION ALL SELECT 'S10 absent', 'products', 0, '0', '0', '0', '0'")
def _staging_round_trip(c):
    """Staged tables, one of the three asked for is absent; a snapshot by its files and by its manifest."""
    root, spark = _root(c), c.spark
    sinks.write_staging({"orders": c.orders, "aisles": c.aisles}, f"{root}/staging")
    back = readers.read_staging(spark, f"{root}/staging", ["orders", "aisles", "products"])
    rows = [_row("S9 staging, S10 read", n, back[n], cols) for n, cols in (("orders", ORDERS), ("aisles", AISLES))]
    absent = [n for n in ("orders", "aisles", "products") if n not in back]
    path = sinks.snapshot(spark, f"{root}/staging/orders.parquet", f"{root}/snapshots", "v1")
    manifest = sinks.snapshots(spark, f"{root}/snapshots")["v1"]
    rows.append(_row("S11 snapshot", "orders", spark.read.parquet(path), ORDERS))
    said = [("S11 manifest", "orders", manifest["rows"], *(manifest[h] for h in ("h1", "h2", "h3", "h4")))]
    said += [("S10 absent", n, 0, "0", "0", "0", "0") for n in absent]
    rows.append(spark.createDataFrame(said, "op string, `table` string, rows long, h1 string, h2 string, h3 string, h4 string"))
    return _all(rows)


@query("catalog_json", "Q4,Q2", sql="""
SELECT 'orders' AS "table", "column", rows, nulls FROM (
  SELECT NULL::VARCHAR AS "column", count(*) AS rows, count(*) - count(days_since_prior_order) AS nulls FROM c_orders
  UNION ALL SELECT 'days_since_prior_order', NULL, count(*) - count(days_since_prior_order) FROM c_orders
  UNION ALL SELECT 'order_id', NULL, count(*) - count(order_id) FROM c_orders)
UNION ALL SELECT 'aisles', NULL, count(*), 0 FROM c_aisles
UNION ALL SELECT '__all__', NULL, (SELECT count(*) FROM c_orders) + (SELECT count(*) FROM c_aisles), NULL""")
def _catalog_json(c):
    """The catalog as it is read back from its JSON file: table rows, two of the columns, and the total."""
    path = f"{_root(c)}/catalog"
    sinks.write_json(jobs.data_catalog({"orders": c.orders, "aisles": c.aisles}), path)
    back = readers.load(c.spark, path, "json")
    keep = F.col("column").isNull() | ((F.col("table") == "orders") & F.col("column").isin("order_id", "days_since_prior_order"))
    return back.where(keep).select("table", "column", F.col("rows").cast("long"), F.col("nulls").cast("long"))


def _broken_orders(c, path: str) -> None:
    """A CSV of all orders in which some lines are broken by a rule on their id."""
    o = c.orders.select(*readers.CONTRACTS["orders"].names)
    text = [F.coalesce(F.col(x).cast("string"), F.lit("")) for x in o.columns]
    k = F.col("order_id") % 100
    line = (F.when(k == 1, F.concat_ws(",", *text, F.lit("surplus")))
            .when(k == 2, F.concat_ws(",", *text[:4]))
            .when(k == 3, F.concat_ws(",", text[0], F.lit("u-"), *text[2:]))
            .when(k == 4, F.concat_ws(",", text[0], F.lit(""), *text[2:]))
            .when(k == 5, F.concat_ws(",", *text[:2], F.lit("later"), *text[3:]))
            .when(k == 6, F.concat_ws(",", *text[:4], F.lit("7"), *text[5:]))
            .otherwise(F.concat_ws(",", *text)))
    # one column whose name is the header and whose values are whole lines: a separator that no line holds keeps them as they are
    o.select(line.alias(",".join(o.columns))).write.option("header", True).option("sep", "\u0001").csv(path)


@query("quarantined_orders", "S3,S1", ctes="k AS (SELECT *, order_id % 100 AS k FROM c_orders)", sql="""
SELECT 'kept' AS reason, count(*) AS lines, count(DISTINCT order_id) AS orders FROM k WHERE k = 0 OR k > 6
UNION ALL SELECT 'malformed', count(*), NULL FROM k WHERE k IN (1, 2, 3) HAVING count(*) > 0
UNION ALL SELECT 'null_key', count(*), NULL FROM k WHERE k = 4 HAVING count(*) > 0
UNION ALL SELECT 'eval_set', count(*), NULL FROM k WHERE k = 5 HAVING count(*) > 0
UNION ALL SELECT 'order_dow', count(*), NULL FROM k WHERE k = 6 HAVING count(*) > 0""")
def _quarantined(c):
    """Rows that keep the contract of a file with broken lines, and how many lines each reason sends to quarantine."""
    path = f"{_root(c)}/orders.csv"
    _broken_orders(c, path)
    good, bad = readers.read_checked(c.spark, path, "orders")
    kept = good.agg(F.lit("kept").alias("reason"), F.count(F.lit(1)).alias("lines"), F.countDistinct("order_id").alias("orders"))
    return kept.unionByName(bad.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"), F.lit(None).cast("long").alias("orders")))


@query("partial_raw_folder", "S2,S3", sql="""
SELECT * FROM (VALUES ('aisles', 'ok', NULL), ('departments', 'columns', 'department'), ('products', 'missing', NULL),
  ('orders', 'ok', NULL), ('order_products__prior', 'missing', NULL), ('order_products__train', 'missing', NULL)) t("table", status, columns)""")
def _partial(c):
    """The report on a folder with two whole tables, one that lacks a column, and three that are not there."""
    root = _root(c)
    sinks.write_csv(c.aisles, f"{root}/aisles.csv")
    sinks.write_csv(c.orders, f"{root}/orders.csv")
    sinks.write_csv(c.departments.select("department_id"), f"{root}/departments.csv")
    return readers.read_present(c.spark, root)[1]
