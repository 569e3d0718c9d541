"""Isolation forest, itemsets against FP-growth, fingerprints, snapshots, quarantine."""

import random

import duckdb
import pytest
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from basketlens.operators import isolation as ISO
from basketlens.operators import itemsets as IT
from basketlens.sources import readers, sinks
from basketlens.sources.fingerprint import fingerprint, fingerprint_sql


def test_planted_outliers_are_in_the_top_per_cent(spark):
    rng = random.Random(2)
    rows = [(i, rng.gauss(0, 1), rng.gauss(5, 2), 1.0) for i in range(6000)]
    rows += [(10000 + i, rng.choice([-1, 1]) * (9 + rng.random()), 40.0 + i, 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, a double, b double, constant double")
    scores = ISO.isolation_scores(df, "id", ["a", "b", "constant"]).orderBy(F.desc("score")).limit(60).collect()
    assert {10000 + i for i in range(20)} <= {r["id"] for r in scores}
    assert ISO.isolation_scores(df, "id", ["a", "b"]).where("score <= 0 OR score >= 1").count() == 0


def test_forest_of_odd_tables(spark):
    schema = "id long, a double"
    for rows in ([], [(1, 2.0)], [(1, 2.0)] * 3 + [(None, None), (2, None)], [(i, 1.0) for i in range(50)]):
        out = ISO.isolation_scores(spark.createDataFrame(rows, schema), "id", ["a"]).collect()
        assert len(out) == len(rows) and all(0 < r["score"] <= 1 for r in out)


def transactions(spark, seed=4):
    rng = random.Random(seed)
    rows = []
    for t in range(400):
        base = rng.choice([["a", "b", "c", "d"], ["a", "c"], ["e", "f", "g"], ["a", "b"], []])
        rows += [(t, x) for x in base if rng.random() < 0.85] + [(t, rng.choice("hijklm"))] * rng.randint(1, 2)
    return spark.createDataFrame([*rows, (1, None), (None, "a")], "order_id long, item string")


@pytest.mark.parametrize("support", [0.02, 0.15, 0.6, 1.0])
def test_itemsets_equal_fp_growth(spark, support):
    tx = transactions(spark)
    got = IT.frequent_itemsets(tx, "item", support).cache()
    baskets = tx.dropna().groupBy("order_id").agg(F.collect_set("item").alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=0.3).fit(baskets)
    as_set = lambda df: {(tuple(sorted(r["items"])), r["freq"]) for r in df.collect()}
    assert as_set(got) == as_set(model.freqItemsets)
    assert all(list(r["items"]) == sorted(r["items"]) for r in got.collect())
    rules = {(tuple(sorted(r["antecedent"])), tuple(r["consequent"]), round(r["confidence"], 9), round(r["lift"], 9)) for r in IT.association_rules(got, 0.3).collect()}
    assert rules == {(tuple(sorted(r["antecedent"])), tuple(r["consequent"]), round(r["confidence"], 9), round(r["lift"], 9))
                     for r in model.associationRules.collect()}
    if support == 0.02:
        assert max(len(r["items"]) for r in got.collect()) >= 4


def test_itemsets_of_nothing(spark):
    assert IT.frequent_itemsets(transactions(spark).limit(0), "item", 0.1).count() == 0


def test_candidates_drop_sets_with_an_infrequent_subset(spark):
    sets = [["a", "b"], ["a", "c"], ["b", "c"], ["b", "d"], ["c", "e"]]
    got = IT.candidates(spark.createDataFrame([(s,) for s in sets], "items array<string>"), 3)
    assert [r["items"] for r in got.collect()] == [["a", "b", "c"]]


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = [(1, "a", 0.1, None), (2, None, None, 5), (2, None, None, 5), (3, "é|\\N", -1.25, 0)]
    schema = "k long, s string, d double, n int"
    one = fingerprint(spark.createDataFrame(rows, schema)).first()
    again = fingerprint(spark.createDataFrame(rows[::-1], schema).repartition(3).select("n", "d", "s", "k")).first()
    assert one == again
    for other in (rows[:-1], [*rows, rows[0]], [(1, "a", 0.1, 0), *rows[1:]], [(1, "a", 0.2, None), *rows[1:]]):
        assert fingerprint(spark.createDataFrame(other, schema)).first() != one
    con = duckdb.connect()
    con.sql("CREATE TABLE t (k BIGINT, s VARCHAR, d DOUBLE, n INTEGER)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    kinds = {"k": "int", "s": "text", "d": "double", "n": "int"}
    assert con.sql(fingerprint_sql("t", kinds)).fetchall()[0] == tuple(one)
    con.sql("DELETE FROM t")
    assert con.sql(fingerprint_sql("t", kinds)).fetchall()[0] == tuple(fingerprint(spark.createDataFrame([], schema)).first())


def test_snapshots_publish_at_once_or_not_at_all(spark, tmp_path, monkeypatch):
    src, root = str(tmp_path / "t"), str(tmp_path / "snap")
    sinks.write_parquet(spark.range(1000).withColumn("v", F.col("id") % 7), src)
    assert sinks.snapshots(spark, root) == {}
    sinks.snapshot(spark, src, root, "v1")
    assert list(sinks.snapshots(spark, root)) == ["v1"] and sinks.snapshots(spark, root)["v1"]["rows"] == 1000
    with pytest.raises(FileExistsError):
        sinks.snapshot(spark, src, root, "v1")

    def torn(df, path, mode="overwrite"):       # the writer dies after some of the rows
        df.limit(10).write.mode(mode).parquet(path)
        raise OSError("interrupted")

    monkeypatch.setattr(sinks, "write_parquet", torn)
    with pytest.raises(OSError):
        sinks.snapshot(spark, src, root, "v2")
    monkeypatch.setattr(sinks, "write_parquet", lambda df, path, mode="overwrite": df.limit(10).write.mode(mode).parquet(path))
    with pytest.raises(OSError):                # rows are lost without an error
        sinks.snapshot(spark, src, root, "v2")
    assert list(sinks.snapshots(spark, root)) == ["v1"]
    monkeypatch.undo()
    sinks.snapshot(spark, src, root, "v2")
    assert sorted(sinks.snapshots(spark, root)) == ["v1", "v2"] and sinks.verify_snapshot(spark, root, "v2")
    part = next(p for p in (tmp_path / "snap" / "v1").iterdir() if p.suffix == ".parquet")
    part.write_bytes(part.read_bytes()[:-1])
    assert not sinks.verify_snapshot(spark, root, "v1")


def test_broken_lines_go_to_quarantine(spark, tmp_path):
    lines = ["order_id,user_id,eval_set,order_number,order_dow,order_hour_of_day,days_since_prior_order",
             "1,1,prior,1,0,8,", "2,1,prior,2,6,23,7.5", "x,1,prior,1,0,8,", "3,1,prior,1,0", "4,1,prior,1,0,8,,extra",
             ",1,prior,1,0,8,", "5,1,other,1,0,8,", "6,1,train,0,0,8,", "7,1,train,1,7,8,", "8,1,train,1,0,24,", "9,1,test,1,0,8,-1", "10,1,,1,0,8,"]
    (tmp_path / "orders.csv").write_text("\n".join(lines) + "\n")
    good, bad = readers.read_checked(spark, str(tmp_path / "orders.csv"), "orders")
    assert sorted(r["order_id"] for r in good.collect()) == [1, 2] and good.columns == readers.CONTRACTS["orders"].names
    got = {(r["line"].split(",")[0], r["reason"]) for r in bad.collect()}
    assert got == {("x", "malformed"), ("3", "malformed"), ("4", "malformed"), ("", "null_key"), ("5", "eval_set"), ("6", "order_number"),
                   ("7", "order_dow"), ("8", "order_hour_of_day"), ("9", "days_since_prior_order"), ("10", "eval_set")}
    assert good.count() + bad.count() == len(lines) - 1
    tables, report = readers.read_present(spark, str(tmp_path), ["orders", "aisles"])
    assert set(tables) == {"orders"} and {(r["table"], r["status"]) for r in report.collect()} == {("orders", "ok"), ("aisles", "missing")}
