"""Tables written to the shared checkpoint folder: cut lineage, survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from basketlens.session import ensure_checkpoint_dir


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the folder of a table that ``staged`` wrote and that no later plan reads."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = path(folder)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
