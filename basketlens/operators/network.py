"""The network of M14 (sigmoid layers, softmax, mean log loss) by distributed L-BFGS.

MLlib's network multiplies its matrices in the JVM, row blocks of 128 at a
time.  Here each pass over the assembled vectors is one Spark job: a task
multiplies its rows block by block in numpy and returns one row, the sums of
loss and gradient, which Spark adds up in a tree; only sums of the size of the
weights reach the driver.  The start (MLlib's seeded weights), the number of
iterations, the tolerance and the memory of ten steps are those of MLlib's
solver, and the result is MLlib's own model.
"""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:  # ship this module's per-task code with the task, as in ordered.py
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to importing the package on workers
    pass

MEMORY = 10         # step pairs that L-BFGS keeps
BLOCK = 1024        # rows that one matrix product takes
STALL = 20          # values that the convergence test looks back on, as in MLlib's solver


def unpack(weights: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(matrix inputs x outputs, intercepts) of each layer, views of MLlib's weight vector."""
    out, at = [], 0
    for n, m in zip(layers, layers[1:]):
        out.append((weights[at:at + n * m].reshape(n, m), weights[at + n * m:at + n * m + m]))
        at += n * m + m
    return out


def loss_and_gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray, layers: Sequence[int]) -> tuple[float, np.ndarray]:
    """Sums of log loss and gradient over the rows ``x`` with classes ``y``."""
    net, grad = unpack(weights, layers), np.zeros_like(weights)
    parts, seen = unpack(grad, layers), [x]
    for i, (w, b) in enumerate(net):
        z = seen[-1] @ w + b
        if i + 1 < len(net):
            seen.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
    z -= z.max(axis=1, keepdims=True)
    log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    rows = np.arange(len(x))
    delta = np.exp(log_p)
    delta[rows, y] -= 1
    for i in range(len(net) - 1, -1, -1):
        parts[i][0][:] = seen[i].T @ delta
        parts[i][1][:] = delta.sum(axis=0)
        if i:
            delta = (delta @ net[i][0].T) * seen[i] * (1 - seen[i])
    return float(-log_p[rows, y].sum()), grad


def objective(rows: DataFrame, layers: Sequence[int]) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Mean loss and its gradient over ``rows`` (x array<double>, y int) at given weights: one job a call."""
    sc, layers = rows.sparkSession.sparkContext, list(layers)

    def at(weights: np.ndarray) -> tuple[float, np.ndarray]:
        shared = sc.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + len(shared.value))
            for b in batches:
                x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
                y = b.column("y").to_numpy()
                for i in range(0, len(x), BLOCK):
                    loss, grad = loss_and_gradient(x[i:i + BLOCK], y[i:i + BLOCK], shared.value, layers)
                    total[0] += len(x[i:i + BLOCK])
                    total[1] += loss
                    total[2:] += grad
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

        total = rows.mapInArrow(run, "s binary").rdd.map(lambda r: np.frombuffer(r["s"])).treeReduce(np.add)
        shared.destroy()
        if total[0] == 0:
            raise ValueError("no rows to fit the network on")
        return float(total[1] / total[0]), total[2:] / total[0]

    return at


def minimise(at: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """L-BFGS with a Wolfe line search by bisection; ends after ``max_iter`` steps, or where the value or gradient stalls."""
    w, (f, g) = start, at(start)
    first, values, pairs = abs(f), deque([f], STALL), deque(maxlen=MEMORY)
    for _ in range(max_iter):
        d, back = -g, []
        for s, v in reversed(pairs):
            back.append(s @ d / (s @ v))
            d = d - back[-1] * v
        if pairs:
            s, v = pairs[-1]
            d = d * (s @ v / (v @ v))
        for (s, v), a in zip(pairs, reversed(back)):
            d = d + s * (a - v @ d / (s @ v))
        slope = float(g @ d)
        if slope >= 0:
            break
        low, high, size = 0.0, np.inf, 1.0 if pairs else 1 / max(float(np.linalg.norm(g)), 1e-12)
        best = None
        for _ in range(10):
            f1, g1 = at(w + size * d)
            if not f1 <= f + 1e-4 * size * slope:
                high = size
            else:
                best = size, f1, g1
                if g1 @ d >= 0.9 * slope:
                    break
                low = size
            size = (low + high) / 2 if np.isfinite(high) else 2 * low
        if best is None:
            break
        size, f1, g1 = best
        if (g1 - g) @ d > 0:
            pairs.append((size * d, g1 - g))
        w, f, g = w + size * d, f1, g1
        if abs(f - max(values)) <= tol * first or np.linalg.norm(g) <= max(tol * abs(f), 1e-8):
            break
        values.append(f)
    return w


def fit(clf: MultilayerPerceptronClassifier, vectors: DataFrame) -> MultilayerPerceptronClassificationModel:
    """``clf.fit(vectors)``, with the passes of this module between MLlib's start and MLlib's model."""
    layers, label = clf.getLayers(), clf.getLabelCol()
    one = vectors.limit(1)
    still = clf.copy({clf.maxIter: 0})          # takes weights as they are: no row moves them
    rows = vectors.select(vector_to_array(F.col(clf.getFeaturesCol())).alias("x"), F.col(label).cast("int").alias("y")).persist()
    try:
        start = still.fit(one).weights.toArray()
        weights = minimise(objective(rows, layers), start, clf.getMaxIter(), clf.getTol())
    finally:
        rows.unpersist()
    return still.copy({still.initialWeights: Vectors.dense(weights)}).fit(one)
