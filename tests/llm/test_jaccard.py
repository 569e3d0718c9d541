"""The n-gram Jaccard join against all pairs, with parts small and large."""

import random
import re

import pytest

from basketlens.llm import ngram_jaccard as nj


def brute(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both, all_ = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if all_ and den * both >= num * all_:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def cluster(seed, copies, words=60):
    r = random.Random(seed)
    vocab = [f"w{r.randrange(400)}" for _ in range(300)]
    base = [r.choice(vocab) for _ in range(words)]
    rows = []
    for i in range(copies):
        w = list(base)
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        if r.random() < .3:
            w = w[: -r.randrange(1, 9)]
        rows.append(" ".join(w))
    return rows


@pytest.mark.parametrize("small,few,rounds,n,num", [(2, 0, 9, 2, 85), (2, 0, 1, 2, 85), (64, 16, 2, 4, 85)])
def test_near_copies_match_all_pairs(spark, monkeypatch, small, few, rounds, n, num):
    """SMALL = 2 sends nearly every part through pivots and prefix filters; what ROUNDS leave open is listed."""
    for name, value in (("SMALL", small), ("FEW", few), ("ROUNDS", rounds)):
        monkeypatch.setattr(nj, name, value)
    texts = cluster(1, 40) + cluster(2, 20, 25) + [" ".join(f"u{k}{j}" for j in range(30)) for k in range(10)]
    texts += ["", None, "one", "ONE", "one two", " \t ", "a b c d", "A  b\nc d"]
    rows = [(7 * i % 211, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.jaccard_components(df, n, num, 100).collect()}
    assert got == brute(rows, n, num, 100)


def test_pairs_of_a_part_become_rows_only_where_sketches_are_close(spark):
    """A part of 60 near copies of one component and 20 documents unlike them: 20 x 60 pairs in question, one of them close."""
    bits = {f"s{k}": 0 for k in range(nj.SKETCH_WORDS)}
    info = [{"id": i, "n": 100} | bits for i in range(60)]
    info += [{"id": i, "n": 100} | {c: (i * 2654435761 << 20 ^ i * 40503 + k) % 2**62 for k, c in enumerate(bits)} for i in range(60, 79)]
    info.append({"id": 79, "n": 100} | bits | {"s0": 7})
    info[30]["n"] = 50              # too small for any of the others
    info[31]["s0"] = 2**63 - 1      # too far from document 79
    few = [(1, i, 0, 0 if i < 60 else i, 0, 80, 20) for i in range(80)]
    few = spark.createDataFrame(few, "key long, id long, side int, component long, main long, m long, others long")
    info = spark.createDataFrame(info, "id long, n long, " + ", ".join(f"{c} long" for c in bits))
    got = nj._across(few, info, 85, 100)
    assert {tuple(sorted(r)) for r in got.collect()} == {(i, 79) for i in range(60) if i not in (30, 31)}


def test_pairs_are_never_listed_by_a_join(spark, monkeypatch):
    """No staged plan joins the documents of a part with each other, in the last round either."""
    for name, value in (("SMALL", 2), ("FEW", 0), ("ROUNDS", 0)):
        monkeypatch.setattr(nj, name, value)
    plans, stage = [], nj.stage
    monkeypatch.setattr(nj, "stage", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), stage(df, name))[1])
    rows = list(enumerate(cluster(5, 40)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.jaccard_components(
        spark.createDataFrame(rows, "doc_id long, text string"), 2, 85, 100).collect()}
    assert got == brute(rows, 2, 85, 100)
    assert not [x for p in plans for x in p.splitlines() if re.search(r"Join Inner.*component#\d+L? = component#", x)]


def test_texts_for_pairs_are_cut_down_to_those_asked_for(spark):
    texts = spark.range(1000).selectExpr("id", "concat('t', id) AS text")
    pairs = spark.createDataFrame([(1, 2, "x"), (3, 2, "y"), (5, 5000, "z")], "a long, b long, k string")
    got = nj._with_texts(pairs, texts)
    assert sorted(map(tuple, got.collect())) == [(1, 2, "x", "t1", "t2"), (3, 2, "y", "t3", "t2")]
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()


def test_part_counts_bound_differences():
    """Sets that link share a kept part key (pigeonhole with slack), over many random pairs."""
    import numpy as np
    r = np.random.default_rng(3)
    for _ in range(300):
        size = int(r.integers(1, 400))
        a = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
        b = a.copy()
        drop = int(r.integers(0, max(1, len(a) // 12) + 1))
        b = np.unique(np.concatenate([np.delete(b, r.choice(len(b), drop, False)), r.integers(0, 2**63, drop // 2, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 85 * (len(a) + len(b) - both):
            continue
        x, y = nj.part_keys(np.concatenate([a, b]), np.array([len(a), len(b)]), 85, 100)
        assert np.intersect1d(x, y).size


def test_edge_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b d"), (2, "a b c"), (3, None)], "doc_id long, text string")
    df = df.selectExpr("*", "text AS id", "1 AS n", "2 AS key")
    got = {tuple(r) for r in nj.jaccard_components(df, 5, 80, 100).collect()}
    assert got == {(1, 1, 1), (2, 1, 1), (3, 0, 3)}
    kept = nj.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, "a b c"), (1, "a b c"), (1, "a b d"), (3, "")]
    assert nj.jaccard_components(df.limit(0)).count() == 0
