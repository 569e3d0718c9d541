"""End-to-end jobs: the ETL load and the KPI export set.

Each is a short composition of operators and sinks; every write is a Spark
writer (job boundary), nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.operators import clean, kpi
from basketlens.operators import quality as Q
from basketlens.sources import sinks
from basketlens.sources.adapter import Canon


def cleaned_tables(c: Canon) -> dict[str, DataFrame]:
    """Clean stage: narrowed / bucketed orders, deduplicated and clustered
    lines per eval set, cleaned catalogue and the enriched products (J3)."""
    return {
        "orders": clean.clean_orders(c.orders),
        "order_products__prior": clean.cluster_items(clean.dedup_items(c.items("prior"))),
        "order_products__train": clean.cluster_items(clean.dedup_items(c.items("train"))),
        "products": clean.clean_products(c.products),
        "aisles": clean.clean_names(c.aisles, "aisle"),
        "departments": clean.clean_names(c.departments, "department"),
        "enriched_products": clean.enrich_products(c.products, c.aisles, c.departments),
    }


def integrity_report(c: Canon) -> DataFrame:
    """Q9: orphan keys per relation, rows only where some are missing."""
    items = kpi.all_items(c.items("prior"), c.items("train"))
    checks = [("order_products.order_id", items, "order_id", c.orders, "order_id"),
              ("order_products.product_id", items, "product_id", c.products, "product_id"),
              ("products.aisle_id", c.products, "aisle_id", c.aisles, "aisle_id"),
              ("products.department_id", c.products, "department_id", c.departments, "department_id")]
    return Q.fk_checks(checks).where(F.col("missing") > 0)


def data_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """Q2: per table shape and duplicates, per column type and nulls, and an
    ``__all__`` row with the overall total rows; one long table."""
    shapes = [Q.table_summary(n, df).select("table", F.lit(None).cast("string").alias("column"),
                                            F.lit(None).cast("string").alias("dtype"),
                                            F.col("rows"), F.col("cols"), F.col("duplicate_rows"),
                                            F.col("total_nulls").alias("nulls"))
              for n, df in tables.items()]
    cols = [Q.column_profile(n, df).select("table", "column", "dtype", F.lit(None).cast("long").alias("rows"),
                                           F.lit(None).cast("int").alias("cols"),
                                           F.lit(None).cast("long").alias("duplicate_rows"), "nulls")
            for n, df in tables.items()]
    out = reduce(DataFrame.unionByName, shapes + cols)
    total = (reduce(DataFrame.unionByName, shapes).agg(F.sum("rows").alias("rows"))
             .select(F.lit("__all__").alias("table"), F.lit(None).cast("string").alias("column"),
                     F.lit(None).cast("string").alias("dtype"), F.col("rows").cast("long"),
                     F.lit(None).cast("int").alias("cols"), F.lit(None).cast("long").alias("duplicate_rows"),
                     F.lit(None).cast("long").alias("nulls")))
    return out.unionByName(total)


def run_etl(c: Canon, root: str, partition_cols=("eval_set",)) -> dict:
    """ETL load: clean -> staging parquet (S9) -> processed parquet
    partitioned by the columns each table has (S7, S8) -> catalog JSON (Q4).
    The integrity report is returned, never blocking (as the reference)."""
    root = root.rstrip("/")
    tables = cleaned_tables(c)
    sinks.write_staging(tables, f"{root}/staging")
    # later steps read the staged tables: each is cleaned and clustered once
    tables = {n: c.spark.read.schema(df.schema).parquet(f"{root}/staging/{n}.parquet") for n, df in tables.items()}
    for name, df in tables.items():
        sinks.write_partitioned(df, f"{root}/processed/{name}", partition_cols)
    sinks.write_json(data_catalog(tables), f"{root}/catalog")
    return {"staging": f"{root}/staging", "processed": f"{root}/processed", "catalog": f"{root}/catalog",
            "integrity": integrity_report(c)}


def export_features(tables: dict[str, DataFrame], root: str) -> list[str]:
    """Each feature table as Parquet and as CSV below ``root``; the CSV is written from the Parquet, so a table is
    computed once."""
    root = root.rstrip("/")
    for name, df in tables.items():
        sinks.write_parquet(df, f"{root}/{name}.parquet")
        sinks.write_csv(df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}.parquet"), f"{root}/{name}.csv")
    return sorted(tables)


def export_predictions(predictions: DataFrame, path: str) -> None:
    """Predictions as CSV, or as Parquet where the path does not end in .csv."""
    (sinks.write_csv if path.rstrip("/").endswith(".csv") else sinks.write_parquet)(predictions, path)


def kpi_export(c: Canon, root: str) -> list[str]:
    """The dashboard KPI set as CSV files."""
    items = kpi.all_items(c.items("prior"), c.items("train"))
    pstats = kpi.product_stats(items, c.products)
    frames = {
        "kpis_summary": kpi.eda_kpis(c.orders, items),
        "orders_by_day": kpi.orders_by_dow(c.orders),
        "orders_by_hour": kpi.orders_by_hour(c.orders),
        "top_products": kpi.top_products(items, c.products, 50),
        "customer_segments": kpi.customer_tiers(c.orders),
        "department_performance": kpi.department_stats(pstats, c.departments),
        "aisle_performance": kpi.aisle_stats(pstats, c.aisles),
    }
    sinks.export_kpis(frames, root)
    return sorted(frames)
