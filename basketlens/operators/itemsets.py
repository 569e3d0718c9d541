"""Frequent itemsets and association rules (D2), level by level.

Candidates of size k are joins of two frequent sets of size k - 1 that share
all but their last item, kept if every subset of size k - 1 is frequent.
Occurrences are counted by extending the occurrences of the prefix in each
transaction by one of its frequent items, so a transaction never lists a set
whose prefix is infrequent.  Sizes are not limited; each level is a staged
table, and what a level does not need is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.operators.staging import drop_staged, staged


def candidates(frequent: DataFrame, size: int) -> DataFrame:
    """(items) of ``size`` (3 or more): prefix join of the frequent sets of ``size`` - 1, without those that have an
    infrequent subset."""
    sets = frequent.select("items", F.slice("items", 1, size - 2).alias("prefix"), F.element_at("items", -1).alias("last"))
    pairs = (sets.alias("a").join(sets.alias("b"), "prefix").where(F.col("a.last") < F.col("b.last"))
             .select(F.concat(F.col("a.items"), F.array(F.col("b.last"))).alias("items")))
    at = F.sequence(F.lit(0), F.lit(size - 3))        # the subsets without one of the first size - 2 items; the other two are the pair
    subsets = pairs.select("items", F.explode(F.transform(at, lambda i: F.filter(
        F.col("items"), lambda x, j: j != i))).alias("subset"))
    known = subsets.join(frequent.select(F.col("items").alias("subset")), "subset", "left_semi")
    return known.groupBy("items").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == size - 2).select("items")


def frequent_itemsets(transactions: DataFrame, item: str, min_support: float, key: str = "order_id") -> DataFrame:
    """(items array in ascending order, freq, support): every set of items that at least ``min_support`` of the
    transactions hold.  Null items and transactions do not count; repeated lines count once."""
    tx = staged(transactions.where(F.col(item).isNotNull() & F.col(key).isNotNull())
                .select(F.col(key).alias("t"), F.col(item).alias("i")).distinct(), "transactions")
    total = tx.agg(F.countDistinct("t")).first()[0]
    out = staged(tx.groupBy("i").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= min_support * total)
                 .select(F.array("i").alias("items"), "freq"), "level1")
    lines = staged(tx.join(out.select(F.col("items")[0].alias("i")), "i", "left_semi"), "frequent_lines")
    drop_staged(tx)
    level, occurrences, size = out, lines.select("t", F.array("i").alias("items")), 1
    while True:
        size += 1
        if size == 2:       # every pair of frequent items is a candidate: those that occur are counted
            held = occurrences.join(lines, "t").where(F.element_at("items", -1) < F.col("i")).select(
                "t", F.concat("items", F.array("i")).alias("items"))
        else:
            wanted = staged(candidates(level, size).select(F.slice("items", 1, size - 1).alias("items"), F.element_at("items", -1).alias("i")), "candidates")
            if wanted.isEmpty():
                break
            held = (occurrences.join(wanted, "items").join(lines, ["t", "i"])
                    .select("t", F.concat("items", F.array("i")).alias("items")))
        held = staged(held, "occurrences")
        level = staged(held.groupBy("items").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= min_support * total), "level")
        if level.isEmpty():
            break
        out = out.unionByName(level)
        old, occurrences = occurrences, staged(held.join(level.select("items"), "items", "left_semi"), "occurrences")
        drop_staged(held)
        if size > 2:
            drop_staged(old)
    return out.select("items", "freq", (F.col("freq") / F.lit(total or None).cast("long")).alias("support"))


def association_rules(itemsets: DataFrame, min_confidence: float) -> DataFrame:
    """(antecedent, consequent, orders, support, confidence, lift): rules with one consequent from ``frequent_itemsets``."""
    at = F.sequence(F.lit(0), F.size("items") - 1)
    parts = itemsets.where(F.size("items") > 1).select("freq", "support", F.explode(F.transform(at, lambda i: F.struct(
        F.filter(F.col("items"), lambda x, j: j != i).alias("antecedent"),
        F.filter(F.col("items"), lambda x, j: j == i).alias("consequent")))).alias("r"))
    parts = parts.select("r.antecedent", "r.consequent", F.col("freq").alias("orders"), "support")
    a = itemsets.select(F.col("items").alias("antecedent"), F.col("freq").alias("of"))
    b = itemsets.select(F.col("items").alias("consequent"), F.col("support").alias("alone"))
    return (parts.join(a, "antecedent").join(b, "consequent").withColumn("confidence", F.col("orders") / F.col("of"))
            .where(F.col("confidence") >= min_confidence)
            .select("antecedent", "consequent", "orders", "support", "confidence", (F.col("confidence") / F.col("alone")).alias("lift")))
