"""Spark session helpers.

The library never creates machine-local scratch space on a cluster: the
reliable checkpoint folder comes from ``spark.checkpoint.dir`` (a shared
filesystem on a cluster).  Only when that setting is absent *and* Spark runs
in local mode (tests, bench) do we make a throw-away folder under /tmp.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every session of ours wants; the bench and tests add master/memory.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "basketlens", extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench (local mode)."""
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)   # the session's own setting wins; a scratch folder only if none is set
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, configuring the context if needed.

    Order: the context's own dir, then ``spark.checkpoint.dir``; a local-mode
    session with neither gets a fresh /tmp folder.  A cluster session must name
    a folder that all executors share: the warehouse's default and /tmp are
    folders of one machine, so there is no fallback.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    target = spark.conf.get("spark.checkpoint.dir", None)
    if not target:
        if sc.master == "local" or sc.master.startswith("local["):     # not local-cluster: its executors are processes of their own
            target = tempfile.mkdtemp(prefix="basketlens-ckpt-", dir="/tmp")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir() or target


#: Stored bytes of the order tables that one shuffle partition is given at first (about 250,000 lines); AQE joins small ones.
PARTITION_BYTES = 4 << 20


def stored_bytes(spark: SparkSession, paths) -> int:
    """Bytes of the files and folders ``paths``; what is not there counts as 0."""
    sc, total = spark.sparkContext, 0
    for p in map(sc._jvm.org.apache.hadoop.fs.Path, paths):
        fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
        total += fs.getContentSummary(p).getLength() if fs.exists(p) else 0
    return total


def spread_shuffles(spark: SparkSession, n_bytes: int) -> None:
    """Let the number of shuffle partitions grow with the input, so that a task's share stays the same and does not spill;
    never below ``spark.sql.shuffle.partitions`` or what was set before."""
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(key, None) or 0))
    spark.conf.set(key, str(max(least, -(-n_bytes // PARTITION_BYTES))))


def apply_runtime_conf(spark: SparkSession) -> None:
    """Runtime SQL settings the operators rely on (safe to call repeatedly)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
