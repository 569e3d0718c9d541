"""ETL load and KPI export end to end on sf0.001."""

import os

from basketlens.plans import jobs


def test_run_etl(spark, canon_small, tmp_path):
    out = jobs.run_etl(canon_small, str(tmp_path / "etl"))
    staged = sorted(d for d in os.listdir(out["staging"]))
    assert "orders.parquet" in staged and "enriched_products.parquet" in staged
    orders_dirs = os.listdir(os.path.join(out["processed"], "orders"))
    assert any(d.startswith("eval_set=") for d in orders_dirs)
    prior_dirs = os.listdir(os.path.join(out["processed"], "order_products__prior"))
    assert not any(d.startswith("eval_set=") for d in prior_dirs)      # column absent -> not partitioned
    cat = spark.read.json(out["catalog"])
    assert cat.where("column IS NULL AND table <> '__all__'").count() == 7
    total = cat.where("table = '__all__'").first()["rows"]
    assert total == sum(spark.read.parquet(os.path.join(out["staging"], f"{t}.parquet")).count()
                        for t in ("orders", "order_products__prior", "order_products__train", "products",
                                  "aisles", "departments", "enriched_products"))
    assert out["integrity"].count() == 0                                # all keys resolve
    back = spark.read.parquet(os.path.join(out["staging"], "orders.parquet"))
    assert back.count() == canon_small.orders.count()
    assert dict(back.dtypes)["order_dow"] == "tinyint"


def test_kpi_export(spark, canon_small, tmp_path):
    names = jobs.kpi_export(canon_small, str(tmp_path / "kpi"))
    assert len(names) == 7
    top = spark.read.option("header", True).csv(str(tmp_path / "kpi" / "top_products"))
    assert 0 < top.count() <= 50
