"""The reference's own CSV layout -> readers -> canonical set -> operators
give the same results as the derived canonical set."""

from pyspark.sql import functions as F

from basketlens.operators import features as FT
from basketlens.operators import kpi
from basketlens.sources import readers, sinks
from basketlens.sources.adapter import canon_from_tables


def test_reference_csv_tables_round_trip(spark, canon_small, tmp_path):
    root = str(tmp_path / "raw")
    c = canon_small
    sinks.write_csv(c.orders, f"{root}/orders.csv")
    sinks.write_csv(c.items("prior"), f"{root}/order_products__prior.csv")
    sinks.write_csv(c.items("train"), f"{root}/order_products__train.csv")
    sinks.write_csv(c.products, f"{root}/products.csv")
    sinks.write_csv(c.aisles, f"{root}/aisles.csv")
    sinks.write_csv(c.departments, f"{root}/departments.csv")
    tables = readers.read_all(spark, root)
    for name in tables:
        assert {r["status"] for r in readers.validate_schema(spark, tables[name], name).collect()} == {"ok"}
    rc = canon_from_tables(spark, tables)
    a = kpi.eda_kpis(rc.orders, kpi.all_items(rc.items("prior"), rc.items("train"))).first().asDict()
    b = kpi.eda_kpis(c.orders, kpi.all_items(c.items("prior"), c.items("train"))).first().asDict()
    assert a == b
    fa = FT.user_features(rc.orders, rc.basket).orderBy("user_id")
    fb = FT.user_features(c.orders, c.basket.where(F.col("eval_set") != "test")).orderBy("user_id")
    assert fa.collect() == fb.collect()
