"""Data-quality and profiling jobs (Q1-Q17).  Every job is one or a few
aggregates over the table; results are small long-format frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.functions import scalar as S
from basketlens.operators.common import side_by_side
from basketlens.operators.stats import exact_quantiles

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Q6 core: rows minus distinct rows = sum(n - 1) over identical rows
    (partial aggregate on the full row)."""
    return (df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
            .agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("long").alias("duplicate_rows")))


def table_summary(name: str, df: DataFrame) -> DataFrame:
    """Q1 / Q5: rows, columns, total nulls and their % of all cells (null for an empty table), duplicate rows."""
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
    base = df.agg(F.count(F.lit(1)).alias("rows"), nulls.cast("long").alias("total_nulls"))
    return (side_by_side(base, duplicate_rows(df))
            .select(F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("cols"),
                    "total_nulls", S.safe_div(F.col("total_nulls") * 100.0, F.col("rows") * len(df.columns))
                    .alias("null_pct"), "duplicate_rows"))


def column_profile(name: str, df: DataFrame) -> DataFrame:
    """Q2 / Q5: per column type, null count and null % of rows (one
    aggregate, unpivoted with ``stack``)."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    agg = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count_if(F.col(c).isNull()).alias(f"__n{i}") for i, c in enumerate(df.columns)])
    pairs = ", ".join(f"'{c}', '{types[c]}', __n{i}" for i, c in enumerate(df.columns))
    long = agg.selectExpr("__rows", f"stack({len(df.columns)}, {pairs}) AS (column, dtype, nulls)")
    return long.select(F.lit(name).alias("table"), "column", "dtype", "nulls",
                       S.safe_div(F.col("nulls") * 100.0, F.col("__rows")).alias("null_pct"))


def null_audit(name: str, df: DataFrame) -> DataFrame:
    """Q13: columns with at least one null."""
    return column_profile(name, df).where(F.col("nulls") > 0)


def duplicate_report(name: str, df: DataFrame) -> DataFrame:
    """Q6: duplicate rows and their % of rows."""
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    return side_by_side(rows, duplicate_rows(df)).select(F.lit(name).alias("table"), "duplicate_rows",
                                      S.safe_div(F.col("duplicate_rows") * 100.0, F.col("rows")).alias("duplicate_pct"))


def id_ranges(name: str, df: DataFrame, cols) -> DataFrame:
    """Q7: min, max, distinct count, rows per id column (one pass + stack)."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(cols):
        aggs += [F.min(c).cast("long").alias(f"mn{i}"), F.max(c).cast("long").alias(f"mx{i}"),
                 F.countDistinct(c).alias(f"nu{i}")]
    pairs = ", ".join(f"'{c}', mn{i}, mx{i}, nu{i}" for i, c in enumerate(cols))
    return (df.agg(*aggs)
            .selectExpr(f"'{name}' AS table", f"stack({len(cols)}, {pairs}) AS (column, min, max, nunique)",
                        "__rows AS rows"))


def missing_keys(child: DataFrame, key: str, parent: DataFrame, parent_key: str | None = None) -> DataFrame:
    """Distinct child keys absent from the parent (left anti join)."""
    pk = parent_key or key
    return (child.select(key).where(F.col(key).isNotNull()).distinct()
            .join(parent.select(F.col(pk).alias(key)).distinct(), key, "left_anti"))


def fk_checks(checks) -> DataFrame:
    """Q8 / Q9: ``checks`` = [(check_name, child, key, parent, parent_key)];
    one row per check with the orphan count and an all-present flag."""
    parts = [missing_keys(ch, k, par, pk).agg(F.count(F.lit(1)).alias("missing"))
             .select(F.lit(n).alias("check"), "missing", (F.col("missing") == 0).alias("all_present"))
             for n, ch, k, par, pk in checks]
    return reduce(DataFrame.unionByName, parts)


def duplicate_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Q10: rows minus distinct (a, b) pairs."""
    return (df.groupBy(a, b).agg(F.count(F.lit(1)).alias("__n"))
            .agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("long").alias("duplicate_pairs")))


def missing_count(df: DataFrame, col: str) -> DataFrame:
    """Q11."""
    return df.agg(F.count_if(F.col(col).isNull()).alias(f"missing_{col}"))


def _long(df: DataFrame, cols) -> DataFrame:
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    return df.selectExpr(f"stack({len(cols)}, {pairs}) AS (column, value)")


def describe(df: DataFrame, cols=None) -> DataFrame:
    """Q12: pandas ``describe()``: count, mean, std (n-1), min, 25/50/75 %
    (exact, linear), max; one row per column.  All columns are unpivoted
    once, so one aggregate and one ordered scan serve every column."""
    cols = cols or numeric_columns(df)
    lf = _long(df, cols)
    basic = lf.groupBy("column").agg(F.count("value").alias("count"), F.avg("value").alias("mean"),
                                     F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                                     F.max("value").alias("max"))
    q = exact_quantiles(lf, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, by=["column"])
    return basic.join(q, "column", "left")


def narrow_types(df: DataFrame) -> DataFrame:
    """Q15 (re-aimed): one min/max pass per integral column -> the smallest
    signed Spark type that holds the range (no unsigned types in Spark)."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, INTEGRAL)]
    agg = df.agg(*[F.min(c).cast("long").alias(f"__mn{i}") for i, c in enumerate(cols)],
                 *[F.max(c).cast("long").alias(f"__mx{i}") for i, c in enumerate(cols)])
    pairs = ", ".join(f"'{c}', __mn{i}, __mx{i}" for i, c in enumerate(cols))
    long = agg.selectExpr(f"stack({len(cols)}, {pairs}) AS (column, min, max)")
    fits = lambda lo, hi: (F.col("min") >= lo) & (F.col("max") <= hi)
    return long.withColumn("narrow_type",
                           F.when(fits(-128, 127), "tinyint").when(fits(-32768, 32767), "smallint")
                           .when(fits(-2147483648, 2147483647), "int").otherwise("bigint"))


def apply_narrowing(df: DataFrame, plan: dict[str, str]) -> DataFrame:
    """Cast columns to the chosen types."""
    return df.select(*[F.col(c).cast(plan[c]).alias(c) if c in plan else F.col(c) for c in df.columns])


def low_cardinality(df: DataFrame, threshold: float = S.LOW_CARDINALITY_RATIO) -> DataFrame:
    """Q16: string columns with distinct/rows below ``threshold``."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    aggs = [F.count(F.lit(1)).alias("rows")] + [F.countDistinct(c).alias(f"nu{i}") for i, c in enumerate(cols)]
    pairs = ", ".join(f"'{c}', nu{i}" for i, c in enumerate(cols))
    out = df.agg(*aggs).selectExpr(f"stack({len(cols)}, {pairs}) AS (column, nunique)", "rows")
    return out.withColumn("ratio", S.safe_div(F.col("nunique"), F.col("rows"))) \
              .withColumn("low_cardinality", F.col("ratio") < threshold)


def outlier_counts(df: DataFrame, cols, iqr_k: float = S.IQR_FACTOR, z: float = S.Z_LIMIT) -> DataFrame:
    """Q17: IQR (k x IQR beyond the quartiles) and z-score (|z| > z, sample
    std) outlier counts per column; quartiles are exact.  One unpivot, one
    ordered scan, and the per-column bounds (one row per column) joined back
    by column name."""
    lf = _long(df, cols)
    q = exact_quantiles(lf, "value", {"q1": 0.25, "q3": 0.75}, by=["column"])
    m = lf.groupBy("column").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
    bounds = q.join(m, "column")
    iqr = F.col("q3") - F.col("q1")
    x = F.col("value")
    return (lf.join(F.broadcast(bounds), "column").groupBy("column").agg(
        F.count_if((x < F.col("q1") - iqr_k * iqr) | (x > F.col("q3") + iqr_k * iqr)).alias("iqr_outliers"),
        F.count_if(F.abs(x - F.col("mu")) > z * F.col("sd")).alias("z_outliers")))


def catalog_samples(tables: dict, max_rows: int = S.SAMPLE_MAX_TABLE_ROWS, n: int = S.SAMPLE_ROWS) -> DataFrame:
    """Q3: up to n sample rows (first by the leading column) as JSON for each
    table with at most ``max_rows`` rows; the row count is checked with a
    bounded ``limit`` so large tables are never counted in full."""
    parts = []
    for name, df in tables.items():
        if df.limit(max_rows + 1).count() > max_rows:
            continue
        parts.append(df.orderBy(df.columns[0]).limit(n)
                     .select(F.lit(name).alias("table"),
                             F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row_json")))
    if not parts:
        some = next(iter(tables.values()))
        return some.select(F.lit("").alias("table"), F.lit("").alias("row_json")).limit(0)
    return reduce(DataFrame.unionByName, parts)
