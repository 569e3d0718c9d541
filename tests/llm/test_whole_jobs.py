"""Jobs that were once cut short: whole results on small and awkward tables."""

from basketlens.llm import fertility, queries

SF = "/root/testdata/sf0.1"


def test_fertility_bands_follow_the_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    passed = fertility.fertility_quality(docs).join(labels, "doc_id").where("not base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in passed.groupBy("quality", "kept").count().collect()}
    assert n.get((0, False), 0) >= 0.9 * (n.get((0, False), 0) + n.get((0, True), 0)), n
    assert n.get((1, True), 0) >= 0.985 * (n.get((1, False), 0) + n.get((1, True), 0)), n


def test_copies_do_not_set_the_band(spark):
    """A third of the rows are one text: it is kept, and so are the others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one = docs.where("lang = 'en' and n_chars between 3000 and 4000").orderBy("doc_id").limit(1)
    many = docs.unionAll(one.crossJoin(spark.range(500)).drop("id"))
    alone = {r["doc_id"] for r in fertility.keep_fertile(docs).select("doc_id").collect()}
    among = {r["doc_id"] for r in fertility.keep_fertile(many).select("doc_id").collect()}
    assert alone == among


def test_every_line_that_repeats_goes(spark, tmp_path):
    """Short lines, too; blank lines stay."""
    rows = [(1, "Home\nAbout us\n\nsome words that are here only once"), (2, "home\n\nabout  US\nHome\nmore"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_units"], r["n_removed"], r["removed"])
           for r in queries.QUERIES["op6_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: (3, 0, ""), 2: (4, 3, "0:4,6:15,16:20"), 3: (0, 0, "")}


def test_backoff_counts_five_words(spark, tmp_path):
    """A five-word phrase seen twice is not scored by its bigrams."""
    import math
    spark.createDataFrame([(1, "a b c d e"), (2, "A b c d e"), (3, "x b c d q")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_stupid_backoff"](spark, str(tmp_path)).collect()}
    # a: 2/15; b c d e after their whole contexts: 2/2, 2/2, 2/2, 2/2
    assert (got[1]["n_backoffs"], got[1]["log_score"]) == (0, round(math.log(2 / 15), 4))
    # x 1/15; b: 0.4 * 3/15; c after b, unseen after x b: 0.4 * 3/3; d: 0.4 * 3/3 after b c; q: 0.4 ** 4 * 1/15
    want = math.log(1 / 15) + math.log(0.4 * 3 / 15) + 2 * math.log(0.4) + math.log(0.4 ** 4 / 15)
    assert (got[3]["n_backoffs"], got[3]["log_score"]) == (1, round(want, 4))
