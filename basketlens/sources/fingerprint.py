"""Order-free fingerprints of tables: a row count and the sums of the four 32-bit parts of each row's MD5.

Equal tables have equal fingerprints whatever the order of rows, files and
columns; a lost, added, repeated or changed row changes the sums.  The text of a
row is defined here, so that any SQL engine gives the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = ("h1", "h2", "h3", "h4")
SCALE = 1_000_000               # decimals of a floating value that count: six


def _text(df: DataFrame, col: str) -> Column:
    """Floating values in millionths, times in microseconds, arrays and others as JSON, null as \\N."""
    kind, c = df.schema[col].dataType, F.col(f"`{col}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = F.round(c.cast("double") * SCALE).cast("long").cast("string")
    elif isinstance(kind, T.TimestampType):
        c = F.unix_micros(c).cast("string")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        c = F.to_json(c)
    else:
        c = c.cast("string")
    return F.coalesce(c, F.lit("\\N"))


def fingerprint(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row: rows, h1 .. h4 (decimal strings) over ``cols`` (all), by name."""
    names = sorted(cols or df.columns)
    digest = F.md5(F.concat_ws("\x1f", *(_text(df, c) for c in names)))
    parts = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("decimal(20,0)") for k in range(4)]
    return df.agg(F.count(F.lit(1)).alias("rows"), *(
        F.coalesce(F.sum(p), F.lit(0)).cast("decimal(38,0)").cast("string").alias(h) for p, h in zip(parts, PARTS)))


def fingerprint_sql(table: str, cols: dict[str, str]) -> str:
    """The same as a DuckDB select list over ``table``; ``cols``: name -> "int", "text" or "double"."""
    def text(c: str) -> str:
        return f"coalesce(CAST(CAST(round({c} * {SCALE}) AS BIGINT) AS VARCHAR), '\\N')" if cols[c] == "double" else f"coalesce(CAST({c} AS VARCHAR), '\\N')"
    row = "md5(concat_ws(chr(31), " + ", ".join(text(c) for c in sorted(cols)) + "))"
    sums = ", ".join(f"CAST(coalesce(sum(('0x' || substr(d, {8 * k + 1}, 8))::HUGEINT), 0) AS VARCHAR) AS {h}" for k, h in enumerate(PARTS))
    return f"SELECT count(*) AS rows, {sums} FROM (SELECT {row} AS d FROM {table})"
