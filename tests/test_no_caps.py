"""Operators that once had size limits, beyond them."""

from basketlens.operators.basket import category_copurchase
from basketlens.operators.quality import catalog_samples


def test_copurchase_of_200_categories(spark):
    rows = [(u, f"d{(u * 7 + k * 11) % 200:03d}") for u in range(300) for k in range(4)]
    got = {(r["category_a"], r["category_b"]): (r["buyers_both"], r["buyers_a"])
           for r in category_copurchase(spark.createDataFrame(rows, "user_id long, department string"), "department").collect()}
    baskets = {}
    for u, d in rows:
        baskets.setdefault(u, set()).add(d)
    want = {}
    for b in baskets.values():
        for x in b:
            for y in b - {x}:
                want[x, y] = want.get((x, y), 0) + 1
    n = {d: sum(d in b for b in baskets.values()) for _, d in rows}
    assert got == {k: (v, n[k[0]]) for k, v in want.items()}


def test_samples_of_large_tables_only(spark):
    assert catalog_samples({"a": spark.range(2000), "b": spark.range(1500)}).count() == 0
