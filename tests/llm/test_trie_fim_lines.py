"""Operators 11 to 13 against brute-force versions, on awkward rows, many shards and hot groups."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketlens.llm import fill_in_middle as fim
from basketlens.llm import line_bitmaps, prefix_trie, queries

CONV = "conv_id long, turn long, role string, text string, h1 string, depth long, ids string"
DOCS = "doc_id long, text string, id long, pos string, keep string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# -- 11 ----------------------------------------------------------------------------------------------------------------

def brute_trie(rows):
    """rows: (conv_id, turn, role, text)"""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    return brute_nodes(full)


def brute_nodes(full):
    members = defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in children[k])
    return sorted((m[0], len(k), members[k[:-1]][0] if k else -1, len(m), len(children[k]), leaves[k], saved[k],
                   sha(",".join(str(c) for c in m if len(full[c]) == len(k)))) for k, m in members.items())


def nodes_of(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.select(*prefix_trie.OUT).collect())


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], CONV)


def random_rows(seed, n, long_=0, alphabet=2):
    rng, rows = random.Random(seed), []
    for c in range(n):
        k = rng.choice([0, 1, 2, 3, 5, 8, 20, 40]) if long_ else rng.randint(1, 8)
        for t in range(k):
            rows.append((c, t, "user" if t % 2 else "assistant", "é" * (1 + rng.randrange(alphabet) if rng.random() < 0.5 else 1)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shards", [1, 3, 17])
@pytest.mark.parametrize("long_", [0, 1])
def test_trie_equals_brute_force_however_it_is_sharded(spark, shards, long_):
    """Long shared prefixes, deeper than a matrix is wide, that many shards cut through."""
    rows = random_rows(7 + long_, 120, long_)
    got = prefix_trie.branched_trie(conversations(spark, rows), shards)
    assert nodes_of(got) == brute_trie(rows)


def test_trie_of_awkward_rows(spark):
    """Null turn, role, text and conversation, tied and missing turns, a missing base, copies, a bare role change."""
    rows = [(5, None, None, None), (5, 1, "a", "x"), (5, 3, "a", None), (6, 0, "a", "x"), (7, 9, "", ""), (7, 10, "b", "x"),
            (None, 1, "a", "x"), (13, 0, "a", "own"), (14, 0, "a", "own"), (20, 1, "a", "tie"), (20, 1, "a", "tie"),
            (21, 0, "ab", "c"), (22, 0, "a", "bc"), (23, -5, "a", "before"), (23, 0, "a", "after")]
    rows += [(100 + 5 * k, 0, "u", "copy") for k in range(30)] + [(100 + 5 * k, 1, "u", "copy") for k in range(30)]
    rows += [(1000, t, "u", f"{t} long text " * 50) for t in range(300)]
    for shards in (1, 8):
        assert nodes_of(prefix_trie.branched_trie(conversations(spark, rows), shards)) == brute_trie(rows)


def test_trie_of_no_conversations(spark):
    assert nodes_of(prefix_trie.branched_trie(conversations(spark, []))) == []


def test_trie_with_turnless_conversations(spark):
    """All turns of a conversation can lie in the replaced prefix whose base is absent: it ends in the root."""
    rows = [(c, 0, "u", "t") for c in range(1, 60) if c % 5]
    got = nodes_of(prefix_trie.branched_trie(conversations(spark, rows), 4))
    assert got == brute_trie(rows)
    assert got[0][1] == 0 and got[0][7] != prefix_trie.EMPTY_SHA


def test_hot_conversation_spreads_over_shards(spark):
    """A third of all rows are copies of one conversation: no shard holds all of them."""
    rows = [(c, t, "u", f"{c % 3 and c}-{t}") for c in range(0, 3000, 5) for t in range(2)]
    df = conversations(spark, rows)
    shards = prefix_trie.sharded(prefix_trie.rebuilt_turns(prefix_trie.ordered_turns(df)), 12)
    per = shards.where("kind = 1 and depth = 2").groupBy("conv_id").agg(F.max("n_convs").alias("n")).collect()
    assert max(r["n"] for r in per) <= 120 and len({r["shard"] for r in shards.select("shard").collect()}) == 12
    assert nodes_of(prefix_trie.branched_trie(df, 12)) == brute_trie(rows)


def test_chunks_of_a_large_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(c, 0, "u", "same") for c in range(0, 500, 5)]
    conv, lens = np.arange(0, 500, 5), np.ones(100, np.int64)
    batches = prefix_trie.shard_nodes(0, conv, lens, np.tile([[1, 2]], (100, 1)), np.full(100, 4))
    chunks = [c for b in batches for c in b.to_pylist() if c["kind"] == prefix_trie.ENDS]
    assert b",".join(c["ends"] for c in chunks) == ",".join(str(r[0]) for r in rows).encode() and len(chunks) == 15


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=30), st.randoms())
def test_shard_trie_property(seqs, rng):
    """Counts and smallest members of every node, whatever the order of the rows in a task."""
    conv = np.array(rng.sample(range(1000), len(seqs)), np.int64)
    lens = np.array([len(s) for s in seqs], np.int64)
    flat = np.array([x for s in seqs for x in s], np.int64)
    trie = prefix_trie.ShardTrie(conv, lens, np.stack([flat, -flat], axis=1).reshape(-1, 2), flat + 1)
    want = defaultdict(list)
    for c, s in zip(conv.tolist(), seqs):
        for d in range(len(s) + 1):
            want[tuple(s[:d])].append(c)
    assert sorted(zip(trie.depth.tolist(), trie.first.tolist(), trie.count.tolist())) == sorted((len(k), min(m), len(m)) for k, m in want.items())
    ends = defaultdict(list)
    for node, row in zip(trie.end_nodes.tolist(), trie.end_rows.tolist()):
        ends[node].append(int(conv[row]))
    assert sorted(map(tuple, ends.values())) == sorted(
        tuple(sorted(c for c, s in zip(conv.tolist(), seqs) if tuple(s) == k)) for k in {tuple(s) for s in seqs})


# -- 12 ----------------------------------------------------------------------------------------------------------------

TEXTS = [None, "", " ", "\n\t", "one", " lead and trail  ", "a <P> b c d", "x<S>", "<M>", "< P> <", "ñandú ﬁ   em nb \u0000 z",
         "a\r\nb\x0bc\x0cd", "<<S <P" * 3, "w " * 50, "long" * 5000, " ".join(f"word{i % 997}" for i in range(60000))]


def documents(spark, texts, extra=()):
    return spark.createDataFrame([*((i, t, 1, "p", "k") for i, t in enumerate(texts)), *extra], DOCS)


def brute_fim(i, text):
    text = text or ""
    u = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    x = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[k:k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return i, len(u), "plain", None, None, text
    spm = h[3] % 100 < 80
    return i, len(u), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_brute_force(spark):
    """Every odd text under many ids (so in every form), a null id, a repeated row."""
    texts = [t for t in TEXTS for _ in range(25)]
    df = documents(spark, texts, [(None, "null id with some words", 1, "p", "k"), (0, "again " * 9, 1, "p", "k"), (0, "again " * 9, 1, "p", "k")])
    out = fim.restore(fim.fill_in_middle(df))
    got = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out.collect()]
    key = lambda r: (-1 if r[0] is None else r[0], r[5])
    want = [brute_fim(r["doc_id"], r["text"]) for r in df.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    for r in out.join(df.withColumnRenamed("text", "t").select("doc_id", "t"), "doc_id").where("doc_id <> 0").collect():
        assert r["restored"] == (r["t"] or "")
        assert (r["output_sha256"], r["restored_sha256"]) == (sha(r["output"]), sha(r["t"] or ""))


def test_pieces_describe_the_output(spark):
    df = documents(spark, TEXTS * 8)
    marks = b"<P><S><M>"
    for r in fim.fill_in_middle(df).join(df.select("doc_id", "text"), "doc_id").collect():
        buffers = ((r["text"] or "").encode(), marks)
        assert b"".join(buffers[p["buffer"]][p["start"]:p["start"] + p["length"]] for p in r["pieces"]).decode() == r["output"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 9), st.integers(1, 5)), max_size=6), st.integers(-3, 40))
def test_cut_splits_descriptors(raw, at):
    pieces = [fim.Piece(*p) for p in raw]
    views = (memoryview(b"0123456789abcde"), memoryview(b"ABCDEFGHIJKLMNO"))
    text = b"".join(fim.chunks(pieces, views))
    left, right = fim.cut(pieces, at)
    assert b"".join(fim.chunks(left, views)) == text[:max(at, 0)] and b"".join(fim.chunks(right, views)) == text[max(at, 0):]
    assert all(p.length > 0 for p in (*left, *right))


def test_fill_in_middle_other_parameters(spark):
    df = documents(spark, ["a b c d e f"] * 60)
    out = fim.restore(fim.fill_in_middle(df, seed=1, rate=100, spm_share=0, sentinels=("[[p]]", "[[s]]", "[[m]]")), ("[[p]]", "[[s]]", "[[m]]"))
    assert {(r["form"], r["restored"]) for r in out.collect()} == {("psm", "a b c d e f")}
    with pytest.raises(ValueError):
        fim.fill_in_middle(df, sentinels=("<a>", "<a>b", "c>"))
    with pytest.raises(ValueError):
        fim.parse(b"<P>a<M>b", "psm", (b"<P>", b"<S>", b"<M>"))


def test_fill_in_middle_of_no_documents(spark):
    out = fim.restore(fim.fill_in_middle(documents(spark, [])))
    assert out.count() == 0 and "restored_sha256" in out.columns


# -- 13 ----------------------------------------------------------------------------------------------------------------

def brute_lines(rows, min_chars=40, min_docs=5):
    """rows: (doc_id, text), ids distinct"""
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    docs = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            docs[key(x)].add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [len(key(x)) < min_chars or len(docs[key(x)]) < min_docs or max(docs[key(x)]) == d for x in lines]
        out[d] = (len(lines), len(lines) - sum(keep), "\n".join(x for x, k in zip(lines, keep) if k), keep)
    return out


LINE = ["This footer line is long enough to be a key of forty points", "Ünïcödé line that is long enough to count as well, yes it is",
        "short", "", "exactly forty code points are in here, ok", "x" * 39, "é" * 40, "ſ" + "K" * 39]


def random_docs(seed, n):
    rng, rows = random.Random(seed), []
    for d in range(n):
        lines = [rng.choice(LINE) if rng.random() < 0.5 else f"own line {d} {rng.random()} that nobody else has at all here" for _ in range(rng.randint(0, 12))]
        lines = [rng.choice([x, x.upper() if x.isascii() else x, f"  {x}\t\r", f"\x0b{x}"]) for x in lines]
        rows.append((d * 3 - 20, "\n".join(lines) if lines else rng.choice([None, ""])))
    rng.shuffle(rows)
    return rows


def check_lines(df, want):
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_bitmaps.line_dedup(df).collect()}
    assert got == {d: w[:3] for d, w in want.items()}
    maps = {r["doc_id"]: line_bitmaps.read_bitmap(r["keep"], r["n_lines"]).tolist() for r in line_bitmaps.keep_bitmaps(df).collect()}
    assert maps == {d: w[3] for d, w in want.items()}


def test_line_bitmaps_equal_brute_force(spark):
    """A line that every document holds, several times in some, cut through by many partitions."""
    rows = random_docs(3, 160)
    rows.append((9999, "\n".join([LINE[0]] * 3000 + [LINE[1].upper()])))
    rows.append((10000, "\n".join([LINE[0]] * 3)))
    df = spark.createDataFrame([(d, t, 1, "p", "k") for d, t in rows], DOCS)
    want = brute_lines(rows)
    check_lines(df, want)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "29")
        check_lines(df, want)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_line_bitmaps_of_awkward_rows(spark):
    """Null ids are left out, of repeated ids the smallest text counts, an empty table gives no rows."""
    long_ = LINE[0]
    rows = [(d, f"{long_}\nx{d}", 1, "p", "k") for d in range(6)]
    df = spark.createDataFrame([*rows, (None, long_, 1, "p", "k"), (3, f"zz\n{long_}", 1, "p", "k")], DOCS)
    check_lines(df, brute_lines([r[:2] for r in rows]))
    empty = df.where("doc_id = 77")
    assert line_bitmaps.line_dedup(empty).count() == 0 and line_bitmaps.keep_bitmaps(empty).count() == 0


def test_four_documents_are_too_few(spark):
    rows = [(d, LINE[0]) for d in range(4)]
    df = spark.createDataFrame([(*r, 1, "p", "k") for r in rows], DOCS)
    assert {r["n_dropped"] for r in line_bitmaps.line_dedup(df).collect()} == {0}
    assert sorted(r["n_dropped"] for r in line_bitmaps.line_dedup(df, min_docs=4).collect()) == [0, 1, 1, 1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 7), st.integers(0, 3)), max_size=60), st.integers(1, 4), st.data())
def test_scan_does_not_depend_on_partitions_and_batches(raw, min_docs, data):
    """Rows of the sorted order in any partitions and batches: rows dropped at once or by the summaries are the same."""
    rows = sorted({(h, h, d, p) for h, d, p in raw}, key=lambda r: (r[0], -r[2], r[3]))
    cuts = sorted(data.draw(st.lists(st.integers(0, len(rows)), max_size=4)))
    parts = [rows[i:j] for i, j in zip([0, *cuts], [*cuts, len(rows)])]
    gone, pending, summaries = set(), [], defaultdict(list)
    for part in parts:
        s, size = line_bitmaps.Scan(min_docs), data.draw(st.integers(1, 7))
        sent = [x for i in range(0, len(part), size) for x in s.feed(np.array(part[i:i + size], np.int64).reshape(-1, 4))]
        for kind, got in [*sent, *s.end()]:
            if kind == line_bitmaps.DROP:
                gone |= {(r[2], r[3], r[0]) for r in got.tolist()}
            else:
                pending += got.tolist()
        for h, _, n, first, last in s.summaries:
            summaries[h].append((n, first, last))
    for h, _, d, p in pending:
        x = summaries[h]
        n = sum(n for n, _, _ in x) - sum(a[2] == b[1] for a, b in zip(x, x[1:]))
        if n >= min_docs and d != max(f for _, f, _ in x):
            gone.add((d, p, h))
    ids = defaultdict(set)
    for h, _, d, _ in rows:
        ids[h].add(d)
    assert gone == {(d, p, h) for h, _, d, p in rows if len(ids[h]) >= min_docs and d != max(ids[h])}


def test_registered():
    for name in ("op11_prefix_trie", "op12_fill_in_middle", "op13_line_bitmaps"):
        assert name in queries.QUERIES and name in queries.ORACLE_SQL
