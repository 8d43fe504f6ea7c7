"""Ridge logistic regression by Newton steps: for a bounded sample on the driver, and over a whole table by sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with the intercept last, mean, scale) for labels y in 0..1; columns are standardised."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    loss = lambda w: np.sum(np.logaddexp(0, z @ w) - y * (z @ w)) + 0.5 * np.sum(penalty * w * w)
    now = loss(w)
    for _ in range(steps):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        rate = 1.0
        while (new := loss(w + rate * step)) > now and rate > 1e-4:
            rate /= 2
        w = w + rate * step
        if now - new < 1e-7 * abs(now):
            break
        now = new
    return w, mean, scale


def decide(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The log-odds of each row."""
    w, mean, scale = model
    return ((x - mean) / scale) @ w[:-1] + w[-1]


def summed(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of the matrices that run makes of the partitions of rows. Matrix rows meet by number, first those of 256 tasks each, so no task gets whole matrices or a row of every task."""

    def one(batches):
        x = run(batches)
        some = np.flatnonzero(x.any(1))
        batch = np.full(len(some), TaskContext.get().partitionId() >> 8)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(batch, pa.int64()), pa.array([r.tobytes() for r in x[some]], pa.binary())], ["i", "batch", "x"])

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"i": t.column("i")[:1], "batch": t.column("batch")[:1], "x": pa.array([sum(sorted_rows(t)).tobytes()], pa.binary())})

    def sorted_rows(t: pa.Table) -> list[np.ndarray]:
        return [np.frombuffer(x) for x in sorted(t.column("x").to_pylist())]  # the same sum whatever order the rows come in

    out = np.zeros(shape)
    schema = "i long, batch long, x binary"
    parts = rows.mapInArrow(one, schema).groupBy("i", "batch").applyInArrow(add, schema)
    for r in parts.groupBy("i").applyInArrow(add, schema).collect():
        out[r["i"]] = np.frombuffer(r["x"])
    return out


def newton(rows: DataFrame, training: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]], width: int, ridge: float = 1.0, steps: int = 8) -> tuple | None:
    """fit_logistic over a whole table: training makes (x, y) of batches, and every step is one job that sums slopes and curvature. None if all y are on one side."""
    d = width + 1

    def first(batches):
        out = np.zeros((3, d))
        for x, y in training(batches):
            out += np.stack([np.append(x.sum(0), len(x)), np.append((x * x).sum(0), (y >= 0.5).sum()), np.append(x[:0].sum(0), y.sum())])
        return out

    sums = summed(rows, first, (3, d))
    n, bad = sums[0, -1], sums[1, -1]
    if not 0 < bad < n:
        return None
    mean = sums[0, :-1] / n
    scale = np.sqrt(np.maximum(sums[1, :-1] / n - mean * mean, 0))
    scale[scale < 1e-9] = 1.0
    penalty = np.append(np.full(width, ridge), 1e-6)
    share = sums[2, -1] / n
    w, last, known = np.append(np.zeros(width), np.log(share / (1 - share))), None, np.inf

    def look(batches):
        out = np.zeros((d + 2, d))
        for x, y in training(batches):
            z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
            at = z @ w
            p = sigmoid(at)
            out[:d] += (z * (p * (1 - p) + 1e-9)[:, None]).T @ z
            out[d] += z.T @ (y - p)
            out[d + 1, 0] += np.sum(np.logaddexp(0, at) - y * at)
        return out

    for _ in range(steps):
        got = summed(rows, look, (d + 2, d))
        loss = got[d + 1, 0] + 0.5 * np.sum(penalty * w * w)
        if loss > known:  # too far: half the way
            w = (w + last) / 2
            continue
        if known - loss < 1e-6 * abs(loss):
            break
        last, known = w, loss
        w = w + np.linalg.solve(got[:d] + np.diag(penalty), got[d] - penalty * w)
    return (w, mean, scale) if last is None or loss <= known else (last, mean, scale)
