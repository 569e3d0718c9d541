"""The pipeline against a brute-force chain: rows per stage, cut texts, redacted texts, packed tokens; scratch tables."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as P
from basketlens.llm import bpe, common, fertility
from basketlens.session import ensure_checkpoint_dir

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of sf0.001 with planted copies, near copies, benchmark passages, secrets, nulls and empty texts."""
    root = str(tmp_path_factory.mktemp("pipeline"))
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    passages = [r["text"] for r in bench.collect() if len(re.findall(r"[a-z0-9]+", (r["text"] or "").lower())) >= 12]
    r = random.Random(9)
    clean = [d for d in docs if d[1] and d[2] == "en" and 200 <= len(d[1].split()) <= 600][:12]
    extra, at = [], 10_000
    for d in clean:
        words = d[1].split()
        for text in (d[1], " ".join([*words, "one", "more"]), " ".join(words[:120]) + " " + r.choice(passages) + " " + " ".join(words[120:]),
                     " ".join(words[5:]) + " password = hunter2hunter2hunter2 end"):
            extra.append((at, text, d[2], d[3], len(text)))
            at += 1
    extra += [(at, None, None, None, None), (at + 1, "", "en", "x", 0), (at + 2, passages[0] + " " + passages[0], "en", "x", 1), (None, clean[0][1] + " no id", "en", "x", 1)]
    spark.createDataFrame([*docs, *extra], SCHEMA).write.parquet(f"{root}/documents.parquet")
    bench.write.parquet(f"{root}/benchmark.parquet")
    return root


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_first(rows):
    """Rows without those of a group of links that do not have its smallest id."""
    sets = [(d, s) for d, s in ((r[0], shingles(r[1])) for r in rows if r[0] is not None) if s]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)) and len(x & y) * 100 >= 80 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return [r for r in rows if r[0] is None or root.get(r[0], r[0]) == r[0] or find(r[0]) == r[0]]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_decontaminated(rows, items):
    windows = set()
    for t in items:
        w = WORD.findall(lower(t or ""))
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes, out = sorted({len(w) for w in windows}), []
    for r in rows:
        text = r[1] or ""
        spans = [m.span() for m in WORD.finditer(lower(text))]
        w = [lower(text)[s:e] for s, e in spans]
        hit = np.zeros(len(w), bool)
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit[k:k + n] = True
        if not hit.any():
            out.append(r)
        elif hit.sum() <= 0.5 * len(w):
            cut, done = [], 0
            for s, e in common.run_list(hit).tolist():
                cut += [text[done:spans[s][0]], " "]
                done = spans[e - 1][1]
            new = "".join(cut) + text[done:]
            out.append((r[0], new, r[2], r[3], len(new)))
    return out


SECRETS = [(re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
           (re.compile(r"AKIA[A-Z0-9]+"), 0, 18), (re.compile(r"[0-9a-f]+"), 0, 16)]


def brute_redacted(rows):
    """Base patterns only; that the battery adds nothing here is asserted by equality."""
    out = []
    for r in rows:
        spans = sorted(m.span() for p, g, n in SECRETS for m in p.finditer(r[1] or "") if len(m[g]) >= n)
        text, done, parts = r[1], 0, []
        for s, e in spans:
            if s >= done:
                parts += [text[done:s], "[SECRET]"]
            done = max(done, e)
        new = "".join(parts) + text[done:] if spans else text
        out.append((r[0], new, r[2], r[3], len(new)) if spans else r)
    return out


def rows_of(df):
    return [tuple(r) for r in df.select(*(c.split()[0] for c in SCHEMA.split(", "))).collect()]


def test_pipeline_equals_a_brute_force_chain(spark, folder):
    from tokenizers import Tokenizer
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    stages = dict(P.STAGES)
    count = lambda rows: Counter(rows)

    kept = common.stage(stages["quality rules"](spark, docs, folder), "t1")
    verdict = defaultdict(list)
    for r in fertility.fertility_quality(docs).collect():
        verdict[r["doc_id"]].append(r["kept"])
    assert all(len(v) == 1 for v in verdict.values())
    want = [r for r in rows_of(docs) if verdict[r[0]][0]]
    assert count(rows_of(kept)) == count(want) and not any(len((r[1] or "").split()) < 20 for r in want)
    assert len(want) < docs.count()

    one = common.stage(stages["n-gram Jaccard join"](spark, kept, folder), "t2")
    want = brute_first(want)
    assert count(rows_of(one)) == count(want) and one.count() < kept.count()

    clean = common.stage(stages["benchmark decontamination"](spark, one, folder), "t3")
    before, want = want, brute_decontaminated(want, items)
    assert count(rows_of(clean)) == count(want) and count(before) != count(want)

    bare = common.stage(stages["secret scans"](spark, clean, folder), "t4")
    before, want = want, brute_redacted(want)
    assert count(rows_of(bare)) == count(want) and count(before) != count(want)

    t = Tokenizer.from_file(bpe.default_vocabulary())
    ids = {r[0]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in want}
    packed = stages["best-fit packing"](spark, bare, folder).collect()
    check_packing(packed, ids)
    # run() is the same chain
    again = P.run(spark, folder).collect()
    check_packing(again, ids)
    assert len({r["sequence_id"] for r in again}) == len({r["sequence_id"] for r in packed})


def check_packing(rows, ids):
    by, places = defaultdict(list), defaultdict(list)
    for r in rows:
        mine = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(mine) == r["length"] <= 2048 and zlib.crc32(np.array(mine, "<u4").tobytes()) == r["ids_crc32"]
        by[r["doc_id"]].append((r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert by.keys() == ids.keys()
    for d, pieces in by.items():
        assert [s for s, _ in sorted(pieces)] == list(range(0, len(ids[d]), 2048)) and sum(n for _, n in pieces) == len(ids[d])
    for p in places.values():
        end = 0
        for at, n in sorted(p):
            assert at == end
            end += n
        assert end <= 2048
    total = sum(map(len, ids.values()))
    assert -(-total // 2048) <= len(places) <= 1.1 * total / 2048 + 1


def folders(spark):
    root = ensure_checkpoint_dir(spark).removeprefix("file:") + "/llm"
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_run_leaves_little_behind(spark, folder):
    """Of all the tables that run() stages, the last stage's input and its pieces are left."""
    before = folders(spark)
    out = P.run(spark, folder)
    left = {f.rpartition("-")[0] for f in folders(spark) - before}
    assert left == {"secret_scans", "pieces"}
    assert out.count() > 0


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_other_columns_and_odd_rows(spark, folder):
    """Columns whose names the operators use, repeated and null ids, null texts: columns stay, rows are judged as stated."""
    long_ = " ".join(f"word{i}" for i in range(80))
    rows = [(1, f"{long_} a", "a", 1, 2), (1, f"{long_} a", "b", 1, 2), (2, f"{long_} b c d e f g h i j k l m n", "c", 3, 4), (None, long_, "d", 5, 6), (3, None, "e", 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, id long, c0 long")
    one = P.near_duplicates(spark, df, folder)
    assert one.columns == df.columns
    got = sorted((r["doc_id"] or -1, r["key"]) for r in one.collect())
    assert got in ([(-1, "d"), (1, "a"), (1, "b"), (2, "c"), (3, "e")], [(-1, "d"), (1, "a"), (1, "b"), (3, "e")])
    for step in (P.benchmark_decontamination, P.secret_scans):
        out = step(spark, df, folder)
        assert out.columns == df.columns and out.count() == 5


def test_scratch_scopes(spark):
    before = folders(spark)
    with common.scratch(spark) as keep:
        a = common.stage(spark.range(3).toDF("x"), "inner")
        b = keep(common.stage(a, "result"))
        with common.scratch(spark) as keep_inner:
            c = keep_inner(common.stage(a, "deeper"))
            common.stage(a, "gone")
        assert c.count() == 3
    assert {f.rpartition("-")[0] for f in folders(spark) - before} == {"result"} and b.count() == 3
    with common.step_of(spark, "test"):
        common.stage(b, "left")
    assert {f.rpartition("-")[0] for f in folders(spark) - before} == {"result", "left"}
    with common.step_of(spark, "test"):
        pass
    assert {f.rpartition("-")[0] for f in folders(spark) - before} == {"result"}
