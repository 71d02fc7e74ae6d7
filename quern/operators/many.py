"""Many yes/no models at once: one matrix of weights, a column per tag and held-out fold.

Every model's loss and gradient come from the same pass over the rows, so fifty tags in five folds take as many passes as one
model does. A pass sends each task the matrix and brings back sums per slice of columns, which are added up in
as many tasks as there are slices. The steps are those of L-BFGS for each model by itself, taken in lockstep.
The matrix is bounded: hash columns times models, 4 bytes each (33 MB for 250 models); it and a few like it are
held by the driver. More tags than MOST_MODELS allows are fitted in several such runs.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern.functions import words as W
from quern.operators.learn import fold
from quern.session import cut_lineage

#: Hash columns of a slice of the gradient; cells of a matrix that a task works on at once; steps that L-BFGS remembers.
SLICE, CELLS, MEMORY = 1024, 4_000_000, 6
MOST_MODELS = 500
#: Sums of 32-bit products are no more exact than this.
NOISE = 1e-6


@dataclass
class Models:
    tags: list[str]
    folds: int          # 0: one model per tag, of all rows
    weights: np.ndarray  # columns x models
    passes: int

    def of(self, tag: str, held_out: int = 0) -> np.ndarray:
        return self.weights[:, self.tags.index(tag) * max(self.folds, 1) + held_out]


def sparse_rows(cells: DataFrame, labels: DataFrame | None, folds: int) -> DataFrame:
    """(doc_id, cols, vals, tags, fold) of hashed cells(doc_id, col, value), or of (doc_id, cols, vals) with them in their row, and labels(doc_id, tags array);
    without labels the tags are in the row, too."""
    if "cols" in cells.columns:
        c = cells.withColumn("vals", F.col("vals").cast("array<float>"))
    else:
        c = cells.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("cv")).select(
            "doc_id", F.transform("cv", lambda x: x["col"]).alias("cols"), F.transform("cv", lambda x: x["value"].cast("float")).alias("vals"))
    return (c if labels is None else c.join(labels, "doc_id")).select("doc_id", "cols", "vals", "tags", (fold(F.col("doc_id"), folds) if folds else F.lit(-1)).cast("int").alias("fold"))


class _Batch:
    """Some rows as arrays."""

    def __init__(self, batch: pa.RecordBatch, tags: list[str]):
        cols = batch.column("cols")
        self.sizes = np.diff(cols.offsets.to_numpy())
        self.cols, self.vals = cols.flatten().to_numpy(), batch.column("vals").flatten().to_numpy().astype(np.float32)
        self.ends = np.cumsum(self.sizes)
        self.fold = batch.column("fold").to_numpy()
        self.y = np.array([[t in held for t in tags] for held in (set(x or ()) for x in batch.column("tags").to_pylist())], np.float32).reshape(len(self.sizes), len(tags))

    def parts(self, dim: int) -> Iterator[tuple[slice, np.ndarray]]:
        """Runs of rows, each as a matrix of all hash columns: products of such matrices are quicker than gathering cells."""
        step = max(1, CELLS // dim)
        for start in range(0, len(self.sizes), step):
            rows = slice(start, min(start + step, len(self.sizes)))
            at = slice(int(self.ends[start] - self.sizes[start]), int(self.ends[rows.stop - 1]))
            x = np.zeros((rows.stop - start, dim), np.float32)
            x[np.repeat(np.arange(rows.stop - start), self.sizes[rows]), self.cols[at]] = self.vals[at]
            yield rows, x


def _sums(rows: DataFrame, weights: np.ndarray, tags: list[str], positive: np.ndarray, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each model and its gradient over the rows it may see."""
    dim, models = weights.shape
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, loss, gradient = shared.value, np.zeros(models), np.zeros((dim, models), np.float32)
        k = max(folds, 1)
        for batch in batches:
            b = _Batch(batch, tags)
            for part, x in b.parts(dim):
                z = x @ w
                y = np.repeat(b.y[part], k, axis=1)
                weight = np.where(y > 0, np.repeat(positive, k)[None, :], 1.0).astype(np.float32)
                if folds:
                    weight *= b.fold[part][:, None] != np.tile(np.arange(folds), len(tags))[None, :]
                loss += (weight * (np.logaddexp(0, z) - y * z)).sum(axis=0, dtype=np.float64)
                r = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
                gradient += x.T @ r
        yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([loss.tobytes()], pa.binary())], names=["slice", "sums"])
        for s in range(0, dim, SLICE):
            if gradient[s:s + SLICE].any():
                yield pa.record_batch([pa.array([s // SLICE], pa.int32()), pa.array([gradient[s:s + SLICE].tobytes()], pa.binary())], names=["slice", "sums"])

    def added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, total = np.float64 if key[0].as_py() < 0 else np.float32, None
        for batch in batches:
            for x in batch.column("sums"):
                one = np.frombuffer(x.as_py(), kind)
                total = one.astype(np.float64) if total is None else total + one
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "sums"])

    schema = "slice int, sums binary"
    # a task sends as many bytes as the matrix has: as many tasks as there are cores
    few = rows.select("cols", "vals", "tags", "fold").coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    parts = few.mapInArrow(run, schema).groupBy("slice").applyInArrow(added, schema).collect()   # a row per slice
    shared.destroy()
    loss, gradient = np.zeros(models), np.zeros((dim, models))
    for r in parts:
        sums = np.frombuffer(r["sums"], np.float64)
        if r["slice"] < 0:
            loss = sums
        else:
            at = r["slice"] * SLICE
            gradient[at:at + SLICE] = sums.reshape(-1, models)
    return loss, gradient


def fit_many(rows: DataFrame, positive: dict[str, float], folds: int = 0, l2: float = 1.0, steps: int = 50, close: float = 1e-4, dim: int = W.HASH_COLUMNS) -> Models:
    """One model per tag in ``positive`` (with the weight of its positive rows) and held-out fold, on rows as ``sparse_rows`` gives them;
    without folds one per tag. Each minimises weighted log loss plus ``l2`` / 2 times its squared weights. It ends when every
    gradient is below ``close`` of its first length, or after ``steps``."""
    tags, k = list(positive), max(folds, 1)
    models = len(tags) * k
    if not 0 < models <= MOST_MODELS:
        raise ValueError(f"{models} models; at most {MOST_MODELS} at once")
    pos = np.array([positive[t] for t in tags], np.float32)
    passes = 0

    def at(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nonlocal passes
        passes += 1
        loss, gradient = _sums(rows, w.astype(np.float32), tags, pos, folds)
        return loss + l2 / 2 * (w * w).sum(axis=0), gradient + l2 * w

    w = np.zeros((dim, models))
    f, g = at(w)
    first = np.maximum(np.sqrt((g * g).sum(axis=0)), 1e-12)
    past: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        done = np.sqrt((g * g).sum(axis=0)) <= close * first
        if done.all():
            break
        p = np.where(done, 0, -_two_loops(g, past))
        slope = (p * g).sum(axis=0)
        size = np.ones(models) if past else 1 / first
        for _try in range(8):
            f2, g2 = at(w + size * p)
            good = f2 <= f + 1e-4 * size * slope + NOISE * np.abs(f)
            if good.all():
                break
            size = np.where(good, size, size / 4)
        good = f2 <= f + NOISE * np.abs(f)
        s, y = np.where(good, size * p, 0), np.where(good, g2 - g, 0)
        w, f, g = w + s, np.where(good, f2, f), np.where(good, g2, g)
        past = [*past, (s, y, (s * y).sum(axis=0))][-MEMORY:]
        if not good.any():
            break
    return Models(tags, folds, w.astype(np.float32), passes)


def _two_loops(g: np.ndarray, past: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Inverse curvature times the gradient, for each model from its own steps; steps without curvature are passed over."""
    q, alphas = g.copy(), []
    for s, y, sy in reversed(past):
        a = np.where(sy > 1e-12, (s * q).sum(axis=0) / np.maximum(sy, 1e-12), 0)
        q -= a * y
        alphas.append(a)
    if past:
        s, y, sy = past[-1]
        q *= np.where(sy > 1e-12, sy / np.maximum((y * y).sum(axis=0), 1e-300), 1)
    for (s, y, sy), a in zip(past, reversed(alphas), strict=True):
        b = np.where(sy > 1e-12, (y * q).sum(axis=0) / np.maximum(sy, 1e-12), 0)
        q += (a - b) * s
    return q


def scores(rows: DataFrame, models: Models) -> DataFrame:
    """(doc_id, tag, p, truth): each row scored for every tag, with folds by the models that never saw its own."""
    tags, folds = models.tags, models.folds
    shared = rows.sparkSession.sparkContext.broadcast(models.weights)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t = shared.value, len(tags)
        for batch in batches:
            b = _Batch(batch, tags)
            for part, x in b.parts(w.shape[0]):
                z = x @ w
                n = len(z)
                if folds:
                    z = z.reshape(n, t, folds)[np.arange(n), :, b.fold[part]]
                ids = batch.column("doc_id").slice(part.start, n).take(pa.array(np.repeat(np.arange(n), t)))
                p = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))
                yield pa.record_batch([ids, pa.array(tags * n), pa.array(p.ravel()), pa.array(b.y[part].astype(np.int32).ravel())], names=["doc_id", "tag", "p", "truth"])
    return rows.select("doc_id", "cols", "vals", "tags", "fold").mapInArrow(run, f"doc_id {kind}, tag string, p double, truth int")


def out_of_fold(cells: DataFrame, labels: DataFrame | None, positive: dict[str, float], folds: int = 5, most: int = MOST_MODELS, **how) -> DataFrame:
    """(doc_id, tag, p, truth) of hashed cells and labels(doc_id, tags) as ``sparse_rows`` takes them: every row scored by models that never saw its fold.
    Tags with more than ``most`` models in all are fitted some at a time, as each model's steps are its own."""
    rows = cut_lineage(sparse_rows(cells, labels, folds))
    step, tags, out = max(1, most // max(folds, 1)), list(positive), None
    for k in range(0, len(tags), step):
        some = scores(rows, fit_many(rows, {t: positive[t] for t in tags[k:k + step]}, folds, **how))
        out = some if out is None else out.unionByName(some)
    if out is None:
        raise ValueError("no tags")
    return out
