"""Boosted trees (M13) and forests (M9, M15) by distributed histograms: MLlib's algorithms, bins, stopping rules and models.

MLlib adds every row to its bins one feature and one object at a time, and keeps
the rows as objects.  Here rows are kept as blocks of bin numbers, two features
in one 16-bit code.  A level of a tree is one Spark job: a
task counts its blocks in numpy, only histograms reach the driver, and of two
siblings only the smaller one is counted, the other is their parent less it.
Bin edges are MLlib's own, from MLlib's sample of rows; the result is MLlib's model.

A forest grows GROUP trees at a time, level by level.  A block holds, per tree,
only the rows that were drawn and whose node is still open: row, number of
draws, node.  Each node looks at its own few features.  Rows and features are
drawn from a seed per tree, block and node (MLlib's draws depend on how its
rows lie in partitions, and are other ones).
"""

from __future__ import annotations

import json
import math
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, RandomForestClassificationModel,
                                       RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.session import ensure_checkpoint_dir

try:  # ship this module's per-task code with the task, as in ordered.py
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to importing the package on workers
    pass

PAIRED = 64         # bins up to which two features share a code (MLlib makes more than its maxBins from uneven weights)
BLOCK = 8192        # rows of a block: with its state below half a megabyte, which the JVM's collector keeps in one region
ALONE = 1 << 19     # rows (about 25 MB of blocks) up to which one task fits all trees: a job a level would take longer than its work
SHARED = 1 << 21    # rows (about 70 MB of codes) up to which tasks get all of them and grow whole trees of a forest
GROUP = 6           # trees of a forest that grow at the same time where rows are spread
PASS_BYTES = 8 << 20        # a task's histograms of a forest's nodes; more nodes take more passes
KEPT = 10           # trees between two checkpoints of the rows' state
EPSILON = 2.0 ** -52        # impurity below which MLlib takes a node for pure
SAME = 1e-10        # share of a gain that rounding may change: of splits that close the first is taken, whatever the order of rows
ONE = float(1 << 26)        # a row of class 1 in a packed count: both counts of a block are exact in one double
PACKED = np.array([1.0, ONE + 1.0])
NODE_SCHEMA = ("treeID int, nodeData struct<id:int, prediction:double, impurity:double, impurityStats:array<double>, rawCount:bigint, "
               "gain:double, leftChild:int, rightChild:int, split:struct<featureIndex:int, leftCategoriesOrThreshold:array<double>, numCategories:int>>")


def _module(spark: SparkSession, name: str):
    at = spark.sparkContext._jvm
    for part in f"{name}$".split("."):
        at = getattr(at, part)
    return getattr(at, "MODULE$")


def thresholds(clf, vectors: DataFrame, dealt: DataFrame) -> tuple[list[np.ndarray], int]:
    """MLlib's bin edges per feature, from its seeded sample of ``dealt``, and the number of rows; ``vectors`` (the same rows) are
    counted and checked."""
    spark = vectors.sparkSession
    jvm = spark.sparkContext._jvm
    clf._transfer_params_to_java()
    java, utils = clf._java_obj, _module(spark, "org.apache.spark.ml.util.DatasetUtils")
    rows = [utils.extractInstances(java, d._jdf, jvm.scala.Option.apply(2)) for d in (vectors, dealt)]
    algo = jvm.org.apache.spark.mllib.tree.configuration.Algo
    strategy = java.getOldBoostingStrategy(jvm.PythonUtils.toScalaMap({}), algo.Classification()).treeStrategy()
    meta = _module(spark, "org.apache.spark.ml.tree.impl.DecisionTreeMetadata").buildMetadata(rows[0], strategy, 1, "all")
    splits = _module(spark, "org.apache.spark.ml.tree.impl.RandomForest").findSplits(rows[1], meta, clf.getSeed())
    return [np.array([s.threshold() for s in some]) for some in splits], int(meta.numExamples())


@dataclass(frozen=True)
class Layout:
    """How bin numbers are coded: ``each`` features (1 or 2) of ``bins`` bins in a code."""

    features: int
    bins: int
    each: int

    @classmethod
    def of(cls, edges: Sequence[np.ndarray]) -> Layout:
        bins = max(len(e) for e in edges) + 1
        if bins > 1 << 16:
            raise ValueError(f"{bins} bins of a feature: at most {1 << 16}")
        return cls(len(edges), bins, 2 if bins <= PAIRED else 1)

    def encode(self, x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
        bins = np.zeros((self.features + self.features % self.each, len(x)), np.uint16)
        for f, e in enumerate(edges):
            bins[f] = np.searchsorted(e, x[:, f])
        return bins if self.each == 1 else bins[::2] * self.bins + bins[1::2]

    def walk(self, codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after ``levels`` steps from the root (1; children of i: 2 i and 2 i + 1)."""
        n = codes.shape[1]
        flat, at, node = codes.ravel(), np.arange(n), np.ones(n, np.int64)
        row, second = feature // self.each * n, feature % self.each == 1
        for _ in range(levels):
            bins = flat[row[node] + at]
            if self.each == 2:
                first = bins // self.bins
                bins = np.where(second[node], bins - first * self.bins, first)
            node = 2 * node + (bins > cut[node])
        return node

    def bins_at(self, codes: np.ndarray, rows: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """The bin of ``feature`` in each of ``rows``."""
        got = codes.ravel()[feature // self.each * codes.shape[1] + rows]
        if self.each == 1:
            return got
        first = got // self.bins
        return np.where(feature % 2 == 1, got - first * self.bins, first)

    def histograms(self, codes: np.ndarray, slot: np.ndarray, slots: int, weights: Sequence[np.ndarray]) -> np.ndarray:
        """Sums of each of ``weights`` by slot (-1: none), feature and bin: [weights, slots, features, bins]."""
        rows = np.flatnonzero(slot >= 0)
        if len(rows) < len(slot):
            codes, slot, weights = codes[:, rows], slot[rows], [w[rows] for w in weights]
        width = self.bins ** self.each
        base, size = slot * width, slots * width
        out = np.empty((len(weights), len(codes), self.each, slots, self.bins))
        for c in range(len(codes)):
            at = base + codes[c]
            for i, w in enumerate(weights):
                h = np.bincount(at, w, size)
                if self.each == 1:
                    out[i, c, 0] = h.reshape(slots, self.bins)
                else:
                    h = h.reshape(slots, self.bins, self.bins)
                    out[i, c, 0], out[i, c, 1] = h.sum(axis=2), h.sum(axis=1)
        return np.moveaxis(out.reshape(len(weights), -1, slots, self.bins)[:, :self.features], 1, 2)


def blocks(vectors: DataFrame, features: str, label: str, edges: Sequence[np.ndarray], layout: Layout, parts: int) -> RDD:
    """The rows as blocks (codes uint16 [codes, rows], classes uint8 [rows], number), in one partition or in ``parts`` at least."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block() -> pa.RecordBatch:
            codes, y = np.concatenate([c for c, _ in held], axis=1), np.concatenate([y for _, y in held])
            held.clear()
            made.append(len(y))
            number = (TaskContext.get().partitionId() << 32) + len(made)
            return pa.RecordBatch.from_arrays([pa.array([codes.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary()),
                                               pa.array([number], pa.int64())], names=["codes", "y", "number"])

        made: list[int] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            if b.num_rows == 0:
                continue
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
            y = b.column("y").to_numpy().astype(np.uint8)
            for i in range(0, len(x), BLOCK):
                held.append((layout.encode(x[i:i + BLOCK], edges), y[i:i + BLOCK]))
                if sum(len(some) for _, some in held) >= BLOCK:
                    yield block()
        if held:
            yield block()

    found = (vectors.select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"))
             .mapInArrow(run, "codes binary, y binary, number bigint"))
    if parts == 1:
        found = found.coalesce(1)
    elif found.rdd.getNumPartitions() < parts:
        found = found.repartition(parts)

    def decoded(r) -> tuple[np.ndarray, np.ndarray, int]:
        y = np.frombuffer(r["y"], np.uint8)
        return np.frombuffer(r["codes"], np.uint16).reshape(-1, len(y)), y, r["number"]

    return found.rdd.map(decoded)


def unpacked(packed: np.ndarray) -> np.ndarray:
    """Counts of class 0 and class 1 out of packed counts."""
    ones = np.floor(packed / ONE)
    return np.stack([packed - ones * ONE - ones, ones])


@dataclass
class Tree:
    """A tree in heap order: position 1 is the root; a leaf sends its rows left, so that all walks take as many steps."""

    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    inner: np.ndarray
    value: np.ndarray
    stats: np.ndarray           # per node: rows, weight, sum and sum of squares of the residual

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 << depth
        return cls(np.zeros(n, np.int64), np.full(n, 1 << 16, np.int64), np.full(n, -1.0), np.zeros(n, bool), np.zeros(n), np.zeros((n, 4)))


def residuals(y: np.ndarray, f: np.ndarray | None) -> np.ndarray:
    """MLlib's pseudo-residuals of the log loss at margins ``f`` (none: the first tree is fitted to -1 and 1)."""
    sign = 2.0 * y - 1
    return sign if f is None else 4.0 * sign / (1.0 + np.exp(2.0 * sign * f))


def best_split(counts: np.ndarray, sums: np.ndarray, edges: Sequence[np.ndarray], weights: np.ndarray) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the largest gain in variance, as MLlib ranks them: the first of equal ones.

    ``counts`` [2, features, bins], ``sums`` [features, bins].
    """
    rows, weight = counts.sum(axis=0).cumsum(axis=1), (counts * weights[:, None, None]).sum(axis=0).cumsum(axis=1)
    total = sums.cumsum(axis=1)
    bins = sums.shape[1]
    valid = np.arange(bins)[None] < np.array([len(e) for e in edges])[:, None]
    valid &= (rows > 0) & (rows < rows[:, -1:])
    if not valid.any():
        return None
    right, rest = np.where(valid, weight[:, -1:] - weight, 1.0), total[:, -1:] - total
    w, s = weight[:, -1:], total[:, -1:]
    gain = np.where(valid, (total ** 2 / np.where(valid, weight, 1.0) + rest ** 2 / right - s ** 2 / w) / w, -np.inf)
    at = int((gain >= gain.max() - SAME * abs(gain.max())).argmax())
    return float(gain.flat[at]), at // bins, at % bins


def grow(passes: Callable[[Tree, int, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], edges: Sequence[np.ndarray],
         depth: int, weights: np.ndarray) -> Tree:
    """A tree of ``depth`` levels.  ``passes(tree, level, nodes)`` returns counts [2, nodes, features, bins], sums [nodes,
    features, bins] and sums of squares [nodes] of the rows in ``nodes``."""
    tree, known = Tree.empty(depth), {}
    for level in range(depth):
        if level == 0:
            nodes, want = [1], [1]
        else:
            nodes = [c for p in parents for c in (2 * p, 2 * p + 1)]            # noqa: F821 - set by the level before
            want = [2 * p if tree.stats[2 * p, 0] <= tree.stats[2 * p + 1, 0] else 2 * p + 1 for p in parents]      # noqa: F821
        if not want:
            break
        counts, sums, squares = passes(tree, level, np.array(want))
        found = {n: (counts[:, i], sums[i], squares[i]) for i, n in enumerate(want)}
        for n in want:
            if n > 1:
                found[n ^ 1] = tuple(a - b for a, b in zip(known[n // 2], found[n]))
        known, parents = found, []
        for n in nodes:
            c, s, q = found[n]
            per_class = c[:, 0].sum(axis=1)
            w, total = float((per_class * weights).sum()), float(s[0].sum())
            if level == 0:
                tree.value[1] = total / w
                tree.stats[1, 0] = per_class.sum()
            best = best_split(c, s, edges, weights) if (q - total * total / w) / w >= EPSILON else None
            if best is None or best[0] <= 0:
                continue
            tree.gain[n], tree.feature[n], tree.cut[n] = best
            tree.inner[n] = True
            left = c[:, tree.feature[n], :tree.cut[n] + 1].sum(axis=1)
            left_sum = s[tree.feature[n], :tree.cut[n] + 1].sum()
            for child, cs, ss in ((2 * n, left, left_sum), (2 * n + 1, per_class - left, s[tree.feature[n]].sum() - left_sum)):
                tree.value[child] = ss / (cs * weights).sum()
                tree.stats[child, 0] = cs.sum()
            parents.append(n)
    for n in range(1, 1 << depth):
        if not tree.inner[n]:
            tree.value[2 * n] = tree.value[n]           # where walks end
    return tree


def settle(tree: Tree, last: np.ndarray, depth: int) -> None:
    """Fill in the sums of all nodes from those of the last level, and merge leaves that answer alike, as MLlib does."""
    tree.stats[1 << depth:] = last
    for n in range((1 << depth) - 1, 0, -1):
        tree.stats[n] = tree.stats[2 * n] + tree.stats[2 * n + 1]
        if tree.inner[n]:
            a, b = 2 * n, 2 * n + 1
            if not any(tree.inner[c] for c in (a, b) if c < 1 << depth) and tree.value[a] == tree.value[b]:
                tree.inner[n] = False


def node_rows(trees: Sequence[Tree], edges: Sequence[np.ndarray]) -> list[tuple]:
    """The rows of a saved ensemble: nodes numbered in preorder."""
    out = []
    for t, tree in enumerate(trees):
        def put(n: int, at: int) -> int:
            rows, w, s, q = tree.stats[n].tolist()
            row, value = [t, None], s / w if w else 0.0
            out.append(row)
            impurity = (q - s * s / w) / w if w else 0.0
            if n < len(tree.inner) and tree.inner[n]:
                f = int(tree.feature[n])
                right = put(2 * n, at + 1)
                end = put(2 * n + 1, right)
                row[1] = (at, value, impurity, [w, s, q], int(rows), float(tree.gain[n]), at + 1, right,
                          (f, [float(edges[f][tree.cut[n]])], -1))
            else:
                end = at + 1
                row[1] = (at, float(tree.value[n]), impurity, [w, s, q], int(rows), -1.0, -1, -1, (-1, [], -1))
            return end
        put(1, 0)
    return [tuple(r) for r in out]


def as_model(spark: SparkSession, clf: GBTClassifier, trees: Sequence[Tree], edges: Sequence[np.ndarray], weights: Sequence[float]) -> GBTClassificationModel:
    """MLlib's model of these boosted trees."""
    nodes = spark.createDataFrame(node_rows(trees, edges), NODE_SCHEMA).coalesce(1)
    return _as_model(spark, clf, clf.copy({clf.maxIter: 1, clf.maxDepth: 1}), {"maxIter": clf.getMaxIter()}, nodes, weights, len(edges), GBTClassificationModel)


def _as_model(spark: SparkSession, clf, small, own: dict, nodes: DataFrame, weights: Sequence[float], features: int, kind):
    """A model by MLlib's file format: the files of ``small`` fitted to one row, with the tree nodes put in."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    columns = [c for c in (clf.getLabelCol(), clf.getFeaturesCol(), clf.getOrDefault(clf.weightCol) if clf.isSet(clf.weightCol) else None) if c]
    one = spark.createDataFrame([(1.0, Vectors.dense([0.0] * features), 1.0)[:len(columns)]], columns)
    small.fit(one).write().overwrite().save(f"{base}/one")
    about = json.loads(spark.read.text(f"{base}/one/metadata").first()[0])
    about["paramMap"] |= own | {"maxDepth": clf.getMaxDepth()}
    about["numTrees"] = len(weights)
    if "numClasses" in about:
        about["numClasses"] = 2
    each = json.loads(spark.read.parquet(f"{base}/one/treesMetadata").first()[1])
    each["paramMap"] |= {"maxDepth": clf.getMaxDepth()}
    if "numClasses" in each:
        each["numClasses"] = 2
    per_tree = [(i, json.dumps(each | {"uid": f"{each['uid'].rpartition('_')[0]}_{uuid.uuid4().hex[:12]}"}), float(w)) for i, w in enumerate(weights)]
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{base}/all/metadata")
    spark.createDataFrame(per_tree, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{base}/all/treesMetadata")
    nodes.write.parquet(f"{base}/all/data")
    model = kind.load(f"{base}/all")
    _delete(spark, base)
    return model


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@dataclass(frozen=True)
class Boosting:
    """What a task does for boosted trees; a block is (codes, classes, margins, sums of the last tree's end nodes)."""

    layout: Layout
    weights: np.ndarray         # of class 0 and 1
    depth: int

    def count(self, part: Iterable[tuple], tree: Tree, level: int, want: np.ndarray) -> np.ndarray:
        """Packed counts, sums and squares of the residuals of the nodes ``want``; at the root, the end nodes' sums, too."""
        slot_of, slots = np.full(2 << self.depth, -1), len(want)
        slot_of[want] = np.arange(slots)
        shape = slots, self.layout.features, self.layout.bins
        counts, sums, nodes, ends = np.zeros((2, *shape)), np.zeros(shape), np.zeros(slots), np.zeros((1 << self.depth, 4))
        for codes, y, f, end in part:
            slot = slot_of[self.layout.walk(codes, tree.feature, tree.cut, level)]
            r = residuals(y, f)
            wr = self.weights[y] * r
            h = self.layout.histograms(codes, slot, slots, [PACKED[y], wr])
            counts += unpacked(h[0])
            sums += h[1]
            here = slot >= 0
            nodes += np.bincount(slot[here], (wr * r)[here], slots)
            if end is not None and level == 0:
                ends += end
        return np.concatenate([counts.ravel(), sums.ravel(), nodes, ends.ravel()])

    def parted(self, got: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        shape = slots, self.layout.features, self.layout.bins
        size = int(np.prod(shape))
        counts, sums, nodes, ends = np.split(got, [2 * size, 3 * size, 3 * size + slots])
        return counts.reshape(2, *shape), sums.reshape(shape), nodes, ends.reshape(-1, 4)

    def move(self, block: tuple, tree: Tree, rate: float) -> tuple:
        """The block with its margins moved by ``tree``."""
        codes, y, f, _ = block
        node, r = self.layout.walk(codes, tree.feature, tree.cut, self.depth), residuals(y, f)
        w, at = self.weights[y], node - (1 << self.depth)
        end = np.stack([np.bincount(at, v, 1 << self.depth) for v in (np.ones(len(y)), w, w * r, w * r * r)], axis=1)
        return codes, y, (0.0 if f is None else f) + tree.value[node] * rate, end

    def fit(self, held: Blocks, edges: Sequence[np.ndarray], rates: Sequence[float]) -> list[Tree]:
        trees: list[Tree] = []

        def passes(tree: Tree, level: int, want: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            *found, ends = self.parted(held.total(lambda part: self.count(part, tree, level, want)), len(want))
            if level == 0 and trees:
                settle(trees[-1], ends, self.depth)
                held.settled()
            return tuple(found)

        for rate in rates:
            tree = grow(passes, edges, self.depth, self.weights)
            trees.append(tree)
            held.move(lambda block, tree=tree, rate=rate: self.move(block, tree, rate))
        settle(trees[-1], held.total(lambda part: sum((b[3] for b in part), np.zeros((1 << self.depth, 4)))), self.depth)
        return trees


class Blocks:
    """Blocks in this process."""

    def __init__(self, blocks: Iterable[tuple]):
        self.blocks = list(blocks)

    def total(self, run: Callable[[Iterable[tuple]], np.ndarray]) -> np.ndarray:
        return run(self.blocks)

    def move(self, run: Callable[[tuple], tuple]) -> None:
        self.blocks = [run(b) for b in self.blocks]

    def settled(self) -> None:
        """A pass over the moved blocks is done."""


class SharedBlocks(Blocks):
    """Blocks kept by Spark; each move is a new cached state, cut off from the ones before by a checkpoint after KEPT moves."""

    def __init__(self, spark: SparkSession, rdd: RDD):
        self.spark = spark          # a thread of its own may have no active session
        self.rdd, self.older, self.moves, self.kept = rdd.persist(StorageLevel.MEMORY_AND_DISK), None, 0, None

    def total(self, run):
        rdd = self.rdd.mapPartitions(lambda part: [run(part)])
        return rdd.reduce(np.add) if rdd.getNumPartitions() <= 64 else rdd.treeReduce(np.add)

    def move(self, run):
        self.older, self.rdd = self.rdd, self.rdd.map(run).persist(StorageLevel.MEMORY_AND_DISK)
        self.moves += 1
        if self.moves % KEPT == 0:
            self.rdd.checkpoint()       # written by the next pass

    def settled(self):
        self.older.unpersist()
        if self.moves % KEPT == 0:
            self._drop_file()
            self.kept = self.rdd.getCheckpointFile()

    def close(self) -> None:
        self.rdd.unpersist()
        if self.older:
            self.older.unpersist()
        self._drop_file()

    def _drop_file(self) -> None:
        if self.kept:
            _delete(self.spark, self.kept)


def fit_boosted(clf: GBTClassifier, vectors: DataFrame, dealt: DataFrame, weights: dict[int, float]) -> GBTClassificationModel:
    """``clf.fit(dealt)`` for rows ``vectors`` (as ``dealt``, before they are dealt out) with class weights."""
    spark = vectors.sparkSession
    edges, n = thresholds(clf, vectors, dealt)
    layout = Layout.of(edges)
    job = Boosting(layout, np.array([weights.get(0, 0.0), weights.get(1, 0.0)]), clf.getMaxDepth())
    rates = [1.0] + [clf.getStepSize()] * (clf.getMaxIter() - 1)
    alone = n <= ALONE
    parts = 1 if alone else spark.sparkContext.defaultParallelism
    rows = blocks(vectors, clf.getFeaturesCol(), clf.getLabelCol(), edges, layout, parts).map(lambda block: (*block[:2], None, None))
    if alone:
        trees = rows.mapPartitions(lambda part: job.fit(Blocks(part), edges, rates)).collect()
    else:
        held = SharedBlocks(spark, rows)
        try:
            trees = job.fit(held, edges, rates)
        finally:
            held.close()
    return as_model(spark, clf, trees, edges, rates)


@dataclass
class Growth:
    """The nodes of one tree of a forest in the order they were made; children come after their parent."""

    rng: np.random.Generator
    counts: list[np.ndarray]        # draws of each class per node
    feature: list[int]
    cut: list[int]
    gain: list[float]
    left: list[int]                 # the right child follows

    def add(self, counts: np.ndarray) -> int:
        self.counts.append(counts)
        for some, v in ((self.feature, -1), (self.cut, 0), (self.gain, -1.0), (self.left, -1)):
            some.append(v)
        return len(self.counts) - 1


@dataclass(frozen=True)
class Forest:
    """What a task does for a forest; a block is (codes, classes, number, rows, draws, slots of open nodes)."""

    layout: Layout
    weights: np.ndarray         # of class 0 and 1
    depth: int
    tried: int                  # features that a node looks at
    bootstrap: bool
    seed: int

    def draw(self, block: tuple, trees: Sequence[int]) -> tuple:
        """The block with the rows drawn for each tree, in the slot of the tree's root."""
        codes, y, number = block[:3]
        rows, draws, slots = [], [], []
        for slot, t in enumerate(trees):
            k = np.random.default_rng([self.seed, t, number]).poisson(1.0, len(y)) if self.bootstrap else np.ones(len(y), np.int64)
            at = np.flatnonzero(k)
            rows.append(at.astype(np.uint16))          # a block has at most 2 * BLOCK rows
            draws.append(np.minimum(k[at], 255).astype(np.uint8))
            slots.append(np.full(len(at), slot, np.int32))
        return codes, y, number, np.concatenate(rows), np.concatenate(draws), np.concatenate(slots)

    def count(self, part: Iterable[tuple], features: np.ndarray, low: int) -> np.ndarray:
        """Draws by class of the open nodes from slot ``low`` on: [2, nodes, tried features, bins]."""
        n, tried = features.shape
        out = np.zeros((2, n, tried, self.layout.bins))
        for codes, y, _, rows, draws, slots in part:
            here = np.flatnonzero((slots >= low) & (slots < low + n))
            if len(here) == 0:
                continue
            row, slot = rows[here], slots[here].astype(np.int64) - low
            w = PACKED[y[row]] * draws[here]
            for j in range(tried):
                bins = self.layout.bins_at(codes, row, features[slot, j])
                out[:, :, j] += unpacked(np.bincount(slot * self.layout.bins + bins, w, n * self.layout.bins)).reshape(2, n, -1)
        return out

    def move(self, block: tuple, feature: np.ndarray, cut: np.ndarray, to: np.ndarray) -> tuple:
        """The block with its rows in their nodes' children: ``to`` [slots, 2], -1 where a child is closed."""
        codes, y, number, rows, draws, slots = block
        split = np.flatnonzero(feature[slots] >= 0)
        rows, draws, slots = rows[split], draws[split], slots[split]
        right = self.layout.bins_at(codes, rows, feature[slots]) > cut[slots]
        slots = to[slots, right.astype(np.int64)]
        stay = np.flatnonzero(slots >= 0)
        return codes, y, number, rows[stay], draws[stay], slots[stay].astype(np.int32)

    def impurity(self, counts: np.ndarray) -> np.ndarray:
        """Gini impurity of weighted class counts [2, ...]."""
        weighted = counts * self.weights.reshape(2, *[1] * (counts.ndim - 1))
        total = weighted.sum(axis=0)
        return 1 - ((weighted / np.where(total > 0, total, 1)) ** 2).sum(axis=0)

    def splits(self, counts: np.ndarray, features: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gain, position in ``features``, bin) of each node's best split; gain -inf where there is none."""
        left = counts.cumsum(axis=3)
        whole = left[:, :, :, -1:]
        right = whole - left
        valid = (np.arange(self.layout.bins) < ends[features][:, :, None]) & (left.sum(axis=0) > 0) & (right.sum(axis=0) > 0)
        w = self.weights.reshape(2, 1, 1, 1)
        share = (left * w).sum(axis=0) / (whole * w).sum(axis=0)
        gain = np.where(valid, self.impurity(whole) - share * self.impurity(left) - (1 - share) * self.impurity(right), -np.inf)
        flat = gain.reshape(len(features), -1)
        top = flat.max(axis=1, keepdims=True)
        best = (flat >= np.where(np.isfinite(top), top - SAME * np.abs(top), top)).argmax(axis=1)
        return flat[np.arange(len(best)), best], best // self.layout.bins, best % self.layout.bins

    def fit(self, held: Blocks, edges: Sequence[np.ndarray], trees: Sequence[int]) -> list[pa.Table]:
        """The node tables of ``trees``."""
        ends, total = np.array([len(e) for e in edges]), self.layout.features
        grown = [Growth(np.random.default_rng([self.seed, t]), [], [], [], [], []) for t in trees]
        held.move(lambda block: self.draw(block, trees))
        most = max(1, PASS_BYTES // (16 * self.tried * self.layout.bins))
        open_nodes = [(i, -1) for i in range(len(trees))]       # (tree, node; -1: the root, not made yet)
        for level in range(self.depth):
            per_tree = np.bincount([i for i, _ in open_nodes], minlength=len(trees))        # slots are in the order of trees
            features = (np.concatenate([g.rng.random((k, total)).argsort(axis=1)[:, :self.tried] for g, k in zip(grown, per_tree)])
                        if self.tried < total else np.tile(np.arange(total), (len(open_nodes), 1)))
            feature, cut, to, after = np.full(len(open_nodes), -1), np.zeros(len(open_nodes), np.int64), np.full((len(open_nodes), 2), -1), []
            for low in range(0, len(open_nodes), most):
                some = features[low:low + most]
                counts = held.total(lambda part, some=some, low=low: self.count(part, some, low))
                if low == 0:
                    held.settled()
                gain, tried, at = self.splits(counts, some, ends)
                nodes = np.arange(len(some))
                left = counts.cumsum(axis=3)[:, nodes, tried, at]
                whole = counts[:, :, 0].sum(axis=2)
                pure = [self.impurity(c) < EPSILON for c in (left, whole - left)]
                for n in range(len(some)):
                    i, node = open_nodes[low + n]
                    g = grown[i]
                    if node < 0:
                        node = g.add(whole[:, n])
                        open_nodes[low + n] = i, node
                    if not gain[n] > 0:
                        continue
                    f = int(some[n, tried[n]])
                    g.feature[node], g.cut[node], g.gain[node] = f, int(at[n]), float(gain[n])
                    g.left[node] = g.add(left[:, n])
                    g.add(whole[:, n] - left[:, n])
                    feature[low + n], cut[low + n] = f, at[n]
                    for side in (0, 1):
                        if level + 1 < self.depth and not pure[side][n]:
                            to[low + n, side] = len(after)
                            after.append((i, g.left[node] + side))
            open_nodes = after
            if not open_nodes:
                break
            held.move(lambda block, feature=feature, cut=cut, to=to: self.move(block, feature, cut, to))
        return [self.table(t, g, edges) for t, g in zip(trees, grown)]

    def table(self, tree: int, g: Growth, edges: Sequence[np.ndarray]) -> pa.Table:
        """The rows of a saved tree, nodes numbered in preorder; leaves that answer alike are merged, as MLlib does."""
        n, left = len(g.counts), list(g.left)
        stats = np.array(g.counts).reshape(n, 2)
        weighted = stats * self.weights
        answer = (weighted[:, 1] > weighted[:, 0]).astype(float)
        size = np.ones(n, np.int64)
        for i in range(n - 1, -1, -1):
            if left[i] >= 0:
                a, b = left[i], left[i] + 1
                if left[a] < 0 and left[b] < 0 and answer[a] == answer[b]:
                    left[i] = -1
                else:
                    size[i] = 1 + size[a] + size[b]
        number = np.full(n, -1)
        number[0] = 0
        for i in range(n):
            if number[i] >= 0 and left[i] >= 0:
                number[left[i]] = number[i] + 1
                number[left[i] + 1] = number[i] + 1 + size[left[i]]
        kept = np.flatnonzero(number >= 0)
        left = np.array(left)[kept]
        inner, impurity = left >= 0, self.impurity(stats.T)[kept]
        child = lambda k: np.where(inner, number[np.where(inner, left + k, 0)], -1)
        feature = np.where(inner, np.array(g.feature)[kept], -1)
        cuts = [[float(edges[f][c])] if f >= 0 else [] for f, c in zip(feature.tolist(), np.array(g.cut)[kept].tolist())]
        split = pa.StructArray.from_arrays([pa.array(feature, pa.int32()), pa.array(cuts, pa.list_(pa.float64())), pa.array(np.full(len(kept), -1), pa.int32())],
                                           names=["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
        columns = {"id": pa.array(number[kept], pa.int32()), "prediction": pa.array(answer[kept]), "impurity": pa.array(impurity),
                   "impurityStats": pa.array(weighted[kept].tolist(), pa.list_(pa.float64())),
                   "rawCount": pa.array(stats[kept].sum(axis=1).astype(np.int64)), "gain": pa.array(np.where(inner, np.array(g.gain)[kept], -1.0)),
                   "leftChild": pa.array(child(0), pa.int32()), "rightChild": pa.array(child(1), pa.int32()), "split": split}
        return pa.table({"treeID": pa.array(np.full(len(kept), tree), pa.int32()), "nodeData": pa.StructArray.from_arrays(list(columns.values()), names=list(columns))})


def fit_forest(clf: RandomForestClassifier, vectors: DataFrame, dealt: DataFrame, weights: dict[int, float]) -> RandomForestClassificationModel:
    """A forest of ``clf``'s settings for rows ``vectors`` (as ``dealt``, before they are dealt out) with class weights."""
    spark, n_trees = vectors.sparkSession, clf.getNumTrees()
    sc = spark.sparkContext
    shape = {"featuresCol": clf.getFeaturesCol(), "labelCol": clf.getLabelCol(), "seed": clf.getSeed()}
    if clf.isSet(clf.weightCol):
        shape["weightCol"] = clf.getOrDefault(clf.weightCol)
    edges, n = thresholds(GBTClassifier(**shape), vectors, dealt)
    layout = Layout.of(edges)
    subset = clf.getFeatureSubsetStrategy()
    if subset not in ("sqrt", "all"):
        raise ValueError(f"features of a split: {subset}")
    tried = len(edges) if subset == "all" else math.ceil(math.sqrt(len(edges)))
    job = Forest(layout, np.array([weights.get(0, 0.0), weights.get(1, 0.0)]), clf.getMaxDepth(), tried, clf.getBootstrap(), clf.getSeed())
    cores = sc.defaultParallelism
    rows = blocks(vectors, clf.getFeaturesCol(), clf.getLabelCol(), edges, layout, cores)
    if n <= SHARED:
        shared = sc.broadcast(rows.collect())          # at most SHARED rows
        few = max(1, min(GROUP, -(-n_trees // cores)))
        groups = [list(range(i, min(i + few, n_trees))) for i in range(0, n_trees, few)]
        tables = [t for some in sc.parallelize(groups, len(groups)).map(
            lambda g: job.fit(Blocks(shared.value), edges, g)).collect() for t in some]
        shared.destroy()
    else:
        tables, rows = [], rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for i in range(0, n_trees, GROUP):
                held = SharedBlocks(spark, rows.map(lambda block: block))
                try:
                    tables += job.fit(held, edges, range(i, min(i + GROUP, n_trees)))
                finally:
                    held.close()
        finally:
            rows.unpersist()
    nodes = spark.createDataFrame(pa.concat_tables(tables)).selectExpr(
        "treeID", f"cast(nodeData as {NODE_SCHEMA.partition('nodeData ')[2]}) as nodeData")
    return _as_model(spark, clf, clf.copy({clf.numTrees: 1, clf.maxDepth: 1}), {"numTrees": n_trees}, nodes, [1.0] * n_trees, len(edges),
                     RandomForestClassificationModel)
