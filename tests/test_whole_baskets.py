"""Basket operators on all lines and all departments."""

from collections import Counter, defaultdict

from basketlens.operators import basket as BK
from basketlens.plans.registry import load_all


def test_who_owns_the_top_gets_the_rest(spark):
    """User 1 owns the 3 best sellers of department 1; all other departments of the user are offered, too."""
    lines = [(1, p, "prior") for p in (1, 2, 3, 11)] + [(2, p, "prior") for p in (1, 2, 3, 4, 12, 12, 21)] + [(3, 21, "train")]
    products = [(p, 1) for p in (1, 2, 3, 4, 5)] + [(p, 2) for p in (11, 12, 13)] + [(21, 3)]
    got = BK.negative_candidates(spark.createDataFrame(lines, "user_id long, product_id long, eval_set string"),
                          spark.createDataFrame(products, "product_id long, department_id long"), 3)
    by = defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: (r["user_id"], r["rank"])):
        by[r["user_id"]].append((r["product_id"], r["department_id"]))
    assert by == {1: [(12, 2), (4, 1), (5, 1)], 2: [(11, 2), (5, 1), (13, 2)]}


def test_supports_count_all_lines(canon_small):
    lines = (canon_small.basket.join(canon_small.products, "product_id").select("order_id", "product_name").distinct().collect())
    orders = len({r["order_id"] for r in lines})
    want = Counter(r["product_name"] for r in lines)
    got = {r["items"]: r["freq"] for r in load_all()["frequent_itemsets"].build(canon_small).collect() if r["size"] == 1}
    assert got == {k: v for k, v in want.items() if v / orders >= 0.005}
    rules = load_all()["association_rules"].build(canon_small).count()
    pairs = load_all()["market_basket_rules"].build(canon_small)
    assert all(r["orders"] / orders == r["support"] for r in pairs.collect()) and rules >= 0
