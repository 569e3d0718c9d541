"""N-gram Jaccard join by parity sketches.

1. Each document becomes a set of hashed shingles.  Equal sets are one class
   (a 128-bit fingerprint and the size tell them apart); the rest works on one
   representative per class.
2. Two sets of sizes a <= b that link have a symmetric difference of at most
   D = floor((1 - t) / (1 + t) * (a + b)) shingles.  A size band fixes D and a
   number of parts p = D + 1 + slack.  Every shingle falls into one part and
   flips (by XOR) the parity word of that part, so the number of parts that
   differ is a Hamming distance that never exceeds the symmetric difference:
   at least slack + 1 parts are equal.
3. Pigeonhole with slack: a document keeps the D + 1 parts that hold most
   shingles.  Of slack + 1 equal parts the fullest is among the kept ones of
   both documents, so equal kept parts find every linked pair, while nearly
   empty parts, which match by chance, are never joined on.
4. Documents that share a part meet at the part's smallest document (a star,
   not all pairs); surviving pairs are verified on the exact shingle sets, and
   links are closed to components.  Parts whose documents are then still in
   several components are looked at again: those with few pairs of different
   components by pair, the others around a pivot.  All their documents are compared with the
   pivot, and dealt into new, smaller groups by a prefix filter on their
   differences from it, until no group is open.  No link that matters is lost,
   and no large group is expanded into pairs.

A second, one-bit-per-shingle parity sketch of 1,024 bits travels with each
document; its Hamming distance is checked before texts are fetched.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.common import GOLDEN, Words, drop_staged, hold_nothing, mix64, one_row_per_id, ragged, scratch, split, stage, steps

#: Size bands grow by two steps of the size ratio that links allow.
BAND_STEPS = 2
#: Slack parts: half as many as needed, so that only well-filled parts are kept.
LEAST_SLACK = 4
#: The pairs of a part are listed where they are at most SMALL for a document (of the documents outside the part's largest
#: component, with all others; FEW such documents always are); other parts are dealt anew around a pivot, ROUNDS times at most.
SMALL, FEW, ROUNDS = 64, 16, 2
#: Words of the bit sketch: unrelated sets of up to about 2,300 shingles are told apart before their texts are fetched.
SKETCH_WORDS = 16


def _by_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Order by row, then value: by value first, then stably by row (a radix sort for few rows)."""
    order = np.argsort(values)
    return order[np.argsort(row[order].astype(np.uint16 if n <= 65536 else np.int64), kind="stable")]


def shingle_sets(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row, one row after the other, and the set sizes."""
    words = Words(text, lower=True)
    h = mix64(words.hashes())[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    k = words.counts
    many = np.where(k >= n, k - n + 1, np.minimum(k, 1))
    width = np.minimum(k, n)
    first = ragged(words.starts[:-1], many)
    row = np.repeat(np.arange(len(k)), many)
    with np.errstate(over="ignore"):
        s = width[row].astype(np.uint64)
        for j in range(n):
            inside = j < width[row]
            w = h[np.where(inside, first + j, 0)] if len(h) else h
            s = np.where(inside, mix64(s * GOLDEN + w), s)
    # distinct inside each row
    order = _by_row(s, row, len(k))
    s, row = s[order], row[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    return s[keep], np.bincount(row[keep], minlength=len(k)).astype(np.int64)


@cache
def bands(num: int, den: int, upto: int) -> tuple[tuple[int, int, int], ...]:
    """(least size, D, parts) of each band that begins at or below ``upto``."""
    out, low = [], 1
    while low <= upto:
        high = max(low + 1, math.ceil(low * (den / num) ** BAND_STEPS))       # exclusive
        small = high - 1
        diff = (den - num) * (small + small * den // num) // (den + num)
        out.append((low, diff, diff + 1 + max(LEAST_SLACK, (diff + 2) // 2)))
        low = high
    return tuple(out)


def part_keys(sets: np.ndarray, sizes: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """Kept parity words of each row, hashed with band and part number: join keys."""
    out: list[np.ndarray] = []
    table = bands(num, den, int(sizes.max()) if len(sizes) else 0)
    lows = [b[0] for b in table]
    end = np.cumsum(sizes)
    for e, size in zip(end.tolist(), sizes.tolist()):
        if not size:
            out.append(np.zeros(0, np.int64))
            continue
        s = sets[e - size:e]
        band = int(np.searchsorted(lows, size, "right")) - 1
        mine = [band]
        # the larger of a pair also looks among the smaller ones' bands
        while mine[-1] > 0 and (lows[mine[-1]] - 1) * den >= num * size:
            mine.append(mine[-1] - 1)
        keys = []
        for g in mine:
            _, diff, parts = table[g]
            with np.errstate(over="ignore"):
                part = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)      # ascending, as s is
                edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                word = np.bitwise_xor.reduceat(mix64(s * GOLDEN), edge)
                filled = np.diff(np.append(edge, len(s)))
                number = part[edge]
                # the fullest D + 1 parts; ties by the parity word and number, so that equal parts rank alike
                order = np.lexsort((number, word, -filled))[:diff + 1]
                key = mix64(word[order] + mix64(number[order] * GOLDEN + np.uint64(g + 1)))
                if len(order) < diff + 1:          # the other parts are empty
                    empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), number)[:diff + 1 - len(order)]
                    key = np.concatenate([key, mix64(mix64(empty * GOLDEN + np.uint64(g + 1)))])
            keys.append(key)
        out.append(np.concatenate(keys).view(np.int64))
    return out


def _bit_sketch(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Parity sketch of 64 * SKETCH_WORDS bits per row: each shingle flips one bit."""
    bits = 64 * SKETCH_WORDS
    out = np.zeros((len(sizes), SKETCH_WORDS), np.int64)
    end = np.cumsum(sizes)
    for i in range(0, len(sizes), 2000):            # rows at a time: bounds the counts below
        some = sizes[i:i + 2000]
        mine = sets[end[i] - some[0]:end[i + len(some) - 1]]
        row = np.repeat(np.arange(len(some)), some)
        at = (mix64(mine + GOLDEN) % np.uint64(bits)).astype(np.int64)
        flips = np.bincount(row * bits + at, minlength=len(some) * bits) & 1
        out[i:i + 2000] = np.packbits(flips.astype(np.uint8).reshape(-1, 64), axis=1, bitorder="little").view(np.int64).reshape(-1, SKETCH_WORDS)
    return out


def sketches(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Per document: id, size, fingerprint (fp1, fp2), kept part keys, bit sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_nothing()
        for b in steps(batches):
            sets, sizes = shingle_sets(b.column("text"), n)
            start = (np.cumsum(sizes) - sizes)[sizes > 0]
            fp = [np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)]
            if len(start):
                with np.errstate(over="ignore"):
                    fp[0][sizes > 0] = np.add.reduceat(mix64(sets), start)
                    fp[1][sizes > 0] = np.bitwise_xor.reduceat(mix64(sets ^ GOLDEN), start)
            keys = part_keys(sets, sizes, num, den)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            sketch = _bit_sketch(sets, sizes)
            yield pa.RecordBatch.from_arrays([
                b.column("id"), pa.array(sizes), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)),
                pa.ListArray.from_arrays(pa.array(at), pa.array(flat)),
                *(pa.array(sketch[:, k].copy()) for k in range(SKETCH_WORDS))], names=names)

    names = ["id", "n", "fp1", "fp2", "keys", *(f"s{k}" for k in range(SKETCH_WORDS))]
    bits = ", ".join(f"s{k} long" for k in range(SKETCH_WORDS))
    return docs.mapInArrow(run, f"id long, n long, fp1 long, fp2 long, keys array<long>, {bits}")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): smallest id of each connected component of ``edges`` (a, b), for ids that have an edge.

    Alternating large-star and small-star steps; each step is one grouped
    minimum and one join, staged in the shared folder.  The graph has settled
    when it is a forest of stars: every id points to one smaller id, which
    points to none.
    """
    def settled(edges: DataFrame) -> bool:
        ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
            edges.select("b", F.lit(0), F.lit(1)))
        return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where(
            "up > 1 or up = 1 and down = 1").isEmpty()

    cur = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(max_rounds):
        if settled(cur):
            break
        both = cur.unionAll(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours go to the least of the neighbourhood
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: smaller neighbours and the node itself go to the least
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        nxt = stage(small.where("a <> b").distinct(), "edges")
        drop_staged(cur)
        cur = nxt
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(
        cur.select(F.col("b"), F.col("b")).distinct())


def _close(a: Callable[[str], Column], b: Callable[[str], Column], num: int, den: int) -> Column:
    """Whether the sizes and the bit sketches of two documents, whose columns ``a`` and ``b`` give, do not rule a link out."""
    bits = sum((F.bit_count(a(f"s{k}").bitwiseXOR(b(f"s{k}"))) for k in range(SKETCH_WORDS)), F.lit(0))
    return (F.least(a("n"), b("n")) * den >= F.greatest(a("n"), b("n")) * num) & (
        bits * (den + num) <= (den - num) * (a("n") + b("n")))


def _across(few: DataFrame, info: DataFrame, num: int, den: int) -> DataFrame:
    """Close pairs (a, b) of documents in different components of a part: those outside the largest component against all.

    Each document of a part meets lists of at most about SMALL of the others, with their sketches, and only pairs that the
    sketches do not rule out become rows.
    """
    rows = few.join(info, "id")
    side = ["id", "component", "side", *(c for c in info.columns if c != "id")]
    others = rows.where("component <> main").groupBy(
        "key", F.expr(f"pmod(xxhash64(id), ceil(others / {SMALL}))").alias("list")).agg(F.collect_list(F.struct(*side)).alias("with"))
    met = F.filter("with", lambda o: (o["component"] != F.col("component")) & (o["side"] + F.col("side")).isin(0, 3) & _close(
        F.col, lambda c: o[c], num, den))
    return rows.join(others.drop("list"), "key").select(
        F.col("id").alias("a"), F.explode(F.transform(met, lambda o: o["id"])).alias("b"))


def _differences(one: pa.Array, two: pa.Array, n: int, num: int, den: int) -> tuple[np.ndarray, ...]:
    """Per pair of texts: both set sizes and whether they link; the shingles of one set only, with their rows: those of
    the first set before those of the second, each by value."""
    a, a_n = shingle_sets(one, n)
    b, b_n = shingle_sets(two, n)
    row = np.concatenate([np.repeat(np.arange(len(a_n)), a_n), np.repeat(np.arange(len(b_n)), b_n)])
    both = np.concatenate([a, b])
    order = _by_row(both, row, len(a_n))
    s, r = both[order], row[order]
    twice = np.zeros(len(s) + 1, bool)
    twice[1:-1] = (s[1:] == s[:-1]) & (r[1:] == r[:-1])
    common = np.bincount(r[twice[:-1]], minlength=len(a_n))
    alone = ~(twice[:-1] | twice[1:])
    s, r, second = s[alone], r[alone], order[alone] >= len(a)
    order = np.argsort(2 * r + second, kind="stable")
    return np.stack([a_n, b_n]), common * den >= num * (a_n + b_n - common), s[order], r[order]


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of a staged table of pairs with both texts; of ``texts``, only those that a pair asks for meet the first ones."""
    asked = texts.join(pairs.select(F.col("b").alias("id")), "id", "left_semi")
    return pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(
        asked.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select(*pairs.columns, "ta", "tb")


def verify(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose exact shingle sets reach num / den: both texts meet in one row, sets are compared there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for outer in steps(batches, "ta"):
            for b in split(outer, "tb"):
                linked = _differences(b.column("ta"), b.column("tb"), n, num, den)[1]
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(linked))

    return _with_texts(pairs, texts).mapInArrow(run, "a long, b long")


def _against_pivot(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """For documents a (of weight w) and pivots b: linked, set sizes, and the shingles x that one of the two lacks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for outer in steps(batches, "ta"):
            for b in split(outer, "tb"):
                size, linked, x, row = _differences(b.column("ta"), b.column("tb"), n, num, den)
                at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    b.column("a"), b.column("b"), b.column("w"), pa.array(linked), pa.array(size[0]), pa.array(size[1]),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(x.view(np.int64)))],
                    names=["a", "b", "w", "linked", "n_a", "n_b", "x"])

    return _with_texts(pairs, texts).mapInArrow(run, "a long, b long, w long, linked boolean, n_a long, n_b long, x array<long>")


def _regroup(star: DataFrame, num: int, den: int) -> DataFrame:
    """(key, id, side, w): documents of a large part dealt anew by what tells them from their pivot.

    X and Y, the differences of two documents from the pivot, differ by as
    much as the documents do.  Where one of the two is not linked to the pivot,
    a link between them needs |X & Y| >= (|X| + |Y| - D) / 2 > 0, so both have a
    common shingle among the first |X| - overlap + 1 (prefix filter, right for
    any order that all documents of a pivot share).  Shingles that the pivot
    lacks come first, as few documents have them in common; only the prefixes
    are exploded.  Two unlinked documents meet with side 0, an unlinked (2) and
    a linked one (1) under keys of their own, with shorter prefixes.
    """
    c, size = f"({den} - {num})", "size(x)"
    most = f"floor({c} * (n_a + floor(n_a * {den} / {num})) / ({den} + {num}))"          # D for any partner
    # |Y| of an unlinked partner: more than its D to the pivot, and at most D less than |X|
    least = f"greatest(floor({c} * (ceil(n_a * {num} / {den}) + n_b) / ({den} + {num})) + 1, {size} - {most})"
    s = star.withColumns({
        "to_unlinked": F.expr(f"CASE WHEN linked THEN 0 ELSE {size} - greatest(1, ceil(({size} + {least} - {most}) / 2)) + 1 END"),
        "across": F.expr(f"CASE WHEN linked THEN {size} - floor(({size} + {c} * (n_b - n_a) / ({den} + {num})) / 2) "
                         f"ELSE {size} - greatest(1, {size} - {most}) + 1 END")})
    first = F.expr("slice(x, 1, cast(greatest(to_unlinked, across, 0) AS int))")
    e = s.select("a", "b", "w", "linked", "to_unlinked", "across", F.posexplode(first).alias("k", "e"))
    near = e.where("not linked and k < to_unlinked").select(F.xxhash64("b", "e", F.lit(0)).alias("key"), "a", F.lit(0).alias("side"), "w")
    far = e.where("k < across").select(
        F.xxhash64("b", "e", F.lit(1)).alias("key"), "a", F.when(F.col("linked"), 1).otherwise(2).alias("side"), "w")
    return _one_of_equal(near.unionAll(far).withColumnRenamed("a", "id"))


def _one_of_equal(groups: DataFrame) -> DataFrame:
    """One of the groups with the same documents on the same sides: what it finds, the others find."""
    h = F.xxhash64("id", "side")
    told = groups.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(h).alias("x"),
                                     F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("s")).where("m > 1")
    first = told.groupBy("m", "x", "s").agg(F.min("key").alias("key"))
    return groups.join(first.select("key"), "key", "left_semi")


def _join_groups(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(id, n, component) for documents (id, text) with distinct ids; a staged table."""
    with scratch(docs.sparkSession) as keep:
        return keep(stage(_linked(docs, n, num, den), "components"))


def _linked(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``_join_groups`` as a plan over tables of its own scope."""
    base = stage(sketches(docs, n, num, den), "sketches")
    meta = ["n", *(f"s{k}" for k in range(SKETCH_WORDS))]
    info = base.select("id", *meta)
    # equal sets are one class
    reps = base.where("n > 0").groupBy("fp1", "fp2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1")
    copies = stage(base.where("n > 0").select("id", "fp1", "fp2", "n").join(reps, ["fp1", "fp2", "n"]).where(
        "id <> rep").select("id", "rep"), "copies")
    # documents by part; one exchange serves the counts and the join
    keyed = base.where("n > 0").select("id", F.explode("keys").alias("key")).repartition("key")
    met = keyed.join(keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "key")
    met = stage(met.join(copies, "id", "left_anti").select("key", "id"), "members")
    many = met.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    # key, id, c: documents of the part, w: the company that a document has in all its parts
    members = stage(met.join(many, "key").withColumn("w", F.sum("c").over(Window.partitionBy("id"))), "members")
    drop_staged(met)
    texts = stage(docs.join(members.select("id").distinct(), "id", "left_semi"), "texts")

    def candidates(ab: DataFrame) -> DataFrame:
        ab = ab.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        for x in "ab":
            ab = ab.join(info.select(F.col("id").alias(x), *(F.col(m).alias(f"{x}_{m}") for m in meta)), x)
        return ab.where(_close(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"), num, den)).select("a", "b")

    # Pairs that meet alone in a part; of larger parts the document with most company is the likeliest original of near
    # copies: each document meets the best one of all its parts, so a cluster gives a pair a document, not one a part.
    two = members.where("c = 2").groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).select("a", "b")
    hub = members.where("c > 2").groupBy("key").agg(F.max(F.struct("w", "id")).alias("p"))
    star = members.where("c > 2").join(hub, "key").groupBy("id").agg(F.max("p").alias("p")).select(
        F.col("id").alias("a"), F.col("p.id").alias("b"))
    tried = stage(candidates(two.unionAll(star)), "tried")
    links = stage(verify(tried, texts, n, num, den), "links")
    comp = components(links)
    groups = _one_of_equal(members.where("c > 2").select("key", "id", F.lit(0).alias("side"), "w"))
    rounds = 0
    while True:
        # parts that hold documents of several components, and a pair of them that is not known yet
        placed = groups.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
        split = (placed.groupBy("key", "component").agg(F.count("*").alias("k"), F.min("side").alias("lo"), F.max("side").alias("hi"))
                 .groupBy("key").agg(F.max(F.struct("k", "component")).alias("main"), F.sum("k").alias("m"), F.count("*").alias("parts"),
                                     F.min("lo").alias("lo"), F.max("hi").alias("hi"))
                 .where("parts > 1 and (lo = 0 or lo <> hi)")
                 .select("key", "m", F.col("main.component").alias("main"), (F.col("m") - F.col("main.k")).alias("others")))
        open_ = stage(placed.join(split, "key"), "open")
        if open_.isEmpty():
            break
        # only pairs of different components matter: those outside the largest one against all, at most SMALL a document
        listed = f"others * m <= {SMALL * SMALL} OR others <= {FEW}" if rounds < ROUNDS else "true"
        pairs = _across(open_.where(listed), info, num, den).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        new = stage(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "tried")
        tried = tried.unionAll(new)
        fresh = verify(new, texts, n, num, den)
        large = open_.where(f"NOT ({listed})")
        more = not large.isEmpty()
        if more:
            pivot = large.groupBy("key").agg(F.max(F.struct("w", "id")).alias("p"))
            if not rounds:
                # parts of one cluster take one pivot: the best of all parts that their documents are in
                best = F.max("p").over(Window.partitionBy("id"))
                pivot = large.join(pivot, "key").withColumn("best", best).groupBy("key").agg(F.max("best").alias("p"))
            rounds += 1
            spokes = stage(large.join(pivot, "key").select(
                F.col("id").alias("a"), F.col("p.id").alias("b"), "w").where("a <> b").distinct(), "spokes")
            star = stage(_against_pivot(spokes, texts, n, num, den), "star")
            drop_staged(spokes)
            fresh = fresh.unionAll(star.where("linked").select("a", "b"))
            old, groups = groups, stage(_regroup(star, num, den), "groups")
            if rounds > 1:
                drop_staged(old)
        # only links between components change anything
        side = comp.select(F.col("id").alias("a"), F.col("component").alias("ca"))
        other = comp.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        fresh = stage(fresh.join(side, "a", "left").join(other, "b", "left").where(
            "coalesce(ca, a) <> coalesce(cb, b)").select("a", "b"), "links")
        drop_staged(open_)
        if not fresh.isEmpty():
            links = links.unionAll(fresh)
            comp = components(links)
        if not more:
            break
        drop_staged(star)
    # copies follow their representative; their own component is known by it
    placed = base.select("id", "n").join(copies, "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    return placed.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select(
        "id", "n", F.coalesce("component", "rep").alias("component"))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """Per distinct non-null id: ``id_col``, n_shingles, component_id (smallest id reached by links, itself included).

    Two documents link when ``den`` * intersection >= ``num`` * union of their
    sets of distinct ``n``-word shingles (words ``[^\\x20\\x09-\\x0D]+`` of the
    ASCII-lowered text; fewer words: the whole sequence).  Null and blank
    texts have empty sets and link with nothing.  Rows with a null id are left
    out; of rows that repeat an id, the one with the smallest text counts.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).where("id is not null")
    return _join_groups(one_row_per_id(rows), n, num, den).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_first(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of links (that of the smallest id); columns unchanged.

    Rows with a null id stay.  Rows that repeat an id stay or go together.
    """
    groups = jaccard_components(docs, n, num, den, id_col, text_col)
    gone = groups.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone"))
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
