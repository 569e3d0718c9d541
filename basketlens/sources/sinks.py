"""Sinks (S5-S9, S11, S14-S16, Q4).  All writes are Spark writers; nothing
is collected to the driver."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from basketlens.sources.fingerprint import fingerprint


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S5 / S14 / S15."""
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV, no index column."""
    df.write.mode(mode).option("header", True).csv(path)


def present_partition_cols(df: DataFrame, cols) -> list[str]:
    """Only partition columns that exist in the table."""
    return [c for c in (cols or []) if c in df.columns]


def write_partitioned(df: DataFrame, path: str, partition_cols, mode: str = "overwrite") -> None:
    """Partitioned parquet.  Partition columns are low-cardinality
    (eval_set: ~90 % of rows are 'prior'), so the rows are NOT shuffled by
    them - that would hand most of the table to one writer.  Each task sorts
    its own rows by the partition values and writes one file per value it
    holds: no shuffle, bounded file count (tasks x values)."""
    cols = present_partition_cols(df, partition_cols)
    w = (df.sortWithinPartitions(*cols) if cols else df).write.mode(mode).option("compression", "snappy")
    if cols:
        w = w.partitionBy(*cols)
    w.parquet(path)


def write_staging(tables: dict[str, DataFrame], root: str) -> None:
    """Every cleaned table to ``<root>/<name>.parquet``."""
    for name, df in tables.items():
        write_parquet(df, f"{root.rstrip('/')}/{name}.parquet")


def archive(spark: SparkSession, src: str, dst: str) -> None:
    """S11 re-aimed: snapshot a parquet table by reading and rewriting it."""
    write_parquet(spark.read.parquet(src), dst)


MANIFEST = "_manifest.json"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def snapshot(spark: SparkSession, src: str, root: str, version: str) -> str:
    """An immutable copy of a parquet table as ``<root>/<version>``, with a manifest of its files, sizes and
    fingerprint.

    The copy is written beside its place, read back and compared with the
    source; then one rename publishes it.  An interrupted copy leaves a hidden
    folder that ``snapshots`` never lists and that the next copy does not touch.
    An existing version is an error.
    """
    root = root.rstrip("/")
    target, fs = _fs(spark, f"{root}/{version}")
    if fs.exists(target):
        raise FileExistsError(f"{root}/{version}")
    hidden = f"{root}/.{version}-{uuid.uuid4().hex}"
    table = spark.read.parquet(src)
    write_parquet(table, hidden)
    before, after = (fingerprint(df).first().asDict() for df in (table, spark.read.parquet(hidden)))
    if before != after:
        raise OSError(f"copy of {src} differs from it: {before} and {after}")
    folder, fs = _fs(spark, hidden)
    files = sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(folder) if not s.getPath().getName().startswith(("_", ".")))
    out = fs.create(_fs(spark, f"{hidden}/{MANIFEST}")[0], False)
    try:
        out.write(bytearray(json.dumps({"files": files, **after}).encode()))
    finally:
        out.close()
    if fs.exists(target) or not fs.rename(folder, target):
        raise FileExistsError(f"{root}/{version}")
    return f"{root}/{version}"


def snapshots(spark: SparkSession, root: str) -> dict[str, dict]:
    """The published versions below ``root`` and their manifests; copies that were not published are not there."""
    folder, fs = _fs(spark, root.rstrip("/"))
    out = {}
    for s in fs.listStatus(folder) if fs.exists(folder) else []:
        name = s.getPath().getName()
        path, _ = _fs(spark, f"{root.rstrip('/')}/{name}/{MANIFEST}")
        if not name.startswith((".", "_")) and fs.exists(path):
            stream = fs.open(path)
            try:
                out[name] = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
    return out


def verify_snapshot(spark: SparkSession, root: str, version: str) -> bool:
    """Whether a published version still has the files, sizes and rows of its manifest."""
    manifest = snapshots(spark, root)[version]
    folder, fs = _fs(spark, f"{root.rstrip('/')}/{version}")
    files = sorted([s.getPath().getName(), s.getLen()] for s in fs.listStatus(folder) if not s.getPath().getName().startswith(("_", ".")))
    if files != [list(f) for f in manifest["files"]]:
        return False
    now = fingerprint(spark.read.parquet(f"{root.rstrip('/')}/{version}")).first().asDict()
    return all(manifest[k] == v for k, v in now.items())


def write_json(df: DataFrame, path: str) -> None:
    """Q4: catalog persisted as JSON lines in one file.  For report-sized
    frames only (the catalog has one row per table and column)."""
    df.coalesce(1).write.mode("overwrite").json(path)


def export_kpis(frames: dict[str, DataFrame], root: str) -> None:
    """The KPI export set, each as one CSV file (dashboard format); the
    frames are aggregates bounded by dimensions (days, hours, departments,
    aisles, top-50), never raw facts."""
    for name, df in frames.items():
        write_csv(df.coalesce(1), f"{root.rstrip('/')}/{name}")
