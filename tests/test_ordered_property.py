"""Randomised equivalence of ordered_scan with plain windows (hypothesis)."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from basketlens.operators.ordered import ordered_scan


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(n=st.integers(1, 400), n_keys=st.integers(1, 6), parts=st.integers(1, 12),
       null_keys=st.booleans(), descending=st.booleans(), seed=st.integers(0, 10_000))
def test_ordered_scan_equals_windows(spark, n, n_keys, parts, null_keys, descending, seed):
    rng = np.random.default_rng(seed)
    keys = rng.integers(0, n_keys, n).astype(float)
    if null_keys:
        keys[rng.random(n) < 0.2] = np.nan
    pdf = pd.DataFrame({"k": keys, "o": rng.permutation(n).astype("int64"), "v": rng.integers(0, 5, n).astype("int64")})
    df = spark.createDataFrame(pdf).withColumn("k", F.col("k").cast("long")).repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = ordered_scan(df, ["k"], ["o"], counter="rn", sums={"cs": "v"}, lags={"prev": "o"},
                           descending=descending).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    order = F.col("o").desc() if descending else F.col("o").asc()
    w = Window.partitionBy("k").orderBy(order)
    exp = (df.withColumn("rn", F.row_number().over(w))
           .withColumn("cs", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
           .withColumn("prev", F.lag("o").over(w))).toPandas()
    a = got.sort_values("o").reset_index(drop=True)
    b = exp.sort_values("o").reset_index(drop=True)
    assert (a["rn"].to_numpy() == b["rn"].to_numpy()).all()
    assert (a["cs"].to_numpy() == b["cs"].to_numpy()).all()
    assert a["prev"].fillna(-1).astype("int64").equals(b["prev"].fillna(-1).astype("int64"))


def test_exact_for_large_ids_and_nulls(spark):
    """Ids, payloads, sums and lags above 2^53, with nulls beside them, stay exact."""
    from basketlens.operators.ordered import ordered_scan
    big = 2**53
    rows = [(big, 1, big + 3, 1), (big + 1, 1, None, big + 1), (big + 1, 2, 2**62 + 1, None), (None, 1, 7, 5),
            (None, 2, None, 6), (2**63 - 1, 1, -2**63, 1), (2**63 - 1, 2, 2**63 - 1, 2)]
    df = spark.createDataFrame(rows, "k long, o long, v long, s long")
    got = {(r["k"], r["o"]): (r["v"], r["seq"], r["run"], r["prev"]) for r in
           ordered_scan(df, ["k"], ["o"], sums={"run": "s"}, lags={"prev": "v"}).collect()}
    assert got == {
        (big, 1): (big + 3, 1, 1, None), (big + 1, 1): (None, 1, big + 1, None), (big + 1, 2): (2**62 + 1, 2, big + 1, None),
        (None, 1): (7, 1, 5, None), (None, 2): (None, 2, 11, 7),
        (2**63 - 1, 1): (-2**63, 1, 1, None), (2**63 - 1, 2): (2**63 - 1, 2, 3, -2**63)}
