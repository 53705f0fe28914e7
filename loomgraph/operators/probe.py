"""Linear probe on frozen vectors with the epoch chosen on the valid rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.storage import discard, stash


def _labels(column: pa.Array, outputs: int) -> np.ndarray:
    """(rows x outputs) of 0 and 1, NaN where a task's label is missing."""
    out = np.full((len(column), outputs), np.nan)
    for i, y in enumerate(column.to_pylist()):
        if y is not None:
            out[i, : len(y)] = [np.nan if v is None else v for v in y[:outputs]]
    return out


def outputs_of(x: np.ndarray, weights: np.ndarray, classes: bool) -> np.ndarray:
    """Probabilities of the classes (softmax), or of each task by itself; the last row of the weights is the bias."""
    z = x @ weights[:-1] + weights[-1]
    if not classes:
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probe(rows: DataFrame, outputs: int, classes: bool = True, epochs: int = 40, rate: float = 1.0, decay: float = 0.0) -> tuple[DataFrame, int, list[float]]:
    """V19. ((id, split, p), best epoch, valid metric of every epoch): logistic regression on ``rows`` (id, x, y, split) by gradient descent
    from zero weights.

    ``y`` is an array with one number for each output: for ``classes`` 1 at the row's class, else the label of each task, null where
    it is missing; such a label, and a row whose y is null, counts in neither gradient nor metric. An epoch is one job: each
    task sums the gradient of its train rows and the hits of its valid rows under the weights so far, and the driver adds
    up one (dimensions + 1) x outputs matrix a task. The weights with the largest share of right labels on the valid rows stay, the
    earliest on a tie; without valid rows the last. p are the probabilities under these weights."""
    stored = stash(rows.select("id", "x", "y", "split").where("x is not null"), "probe")
    width = stored.agg(F.max(F.size("x")).alias("w")).first()["w"] or 0
    weights = np.zeros((width + 1, outputs))
    best, chosen, metric = weights, 0, []
    known = stored.where("split in ('train', 'valid') and y is not null").select("x", "y", "split")
    for epoch in range(epochs + 1):
        shared = stored.sparkSession.sparkContext.broadcast(weights)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            grad, n, right, judged = np.zeros_like(shared.value), np.zeros(outputs), 0.0, 0.0
            for b in batches:
                if not b.num_rows:
                    continue
                x = np.asarray(b.column("x").flatten(), dtype=float).reshape(b.num_rows, -1)
                y, train = _labels(b.column("y"), outputs), np.array([s == "train" for s in b.column("split").to_pylist()])
                p = outputs_of(x, shared.value, classes)
                there = ~np.isnan(y)
                off = np.where(there, p - np.nan_to_num(y), 0) * train[:, None]
                grad += np.vstack([x.T @ off, off.sum(axis=0)])
                n += (there & train[:, None]).sum(axis=0)
                if classes:
                    full = there.any(axis=1) & ~train
                    right += float((p.argmax(axis=1) == np.nan_to_num(y).argmax(axis=1))[full].sum())
                    judged += float(full.sum())
                else:
                    full = there & ~train[:, None]
                    right += float(((p >= 0.5) == (y >= 0.5))[full].sum())
                    judged += float(full.sum())
            yield pa.RecordBatch.from_pydict({"g": [grad.tobytes()], "n": [n.tobytes()], "a": [right], "b": [judged]})

        parts = known.mapInArrow(sums, "g binary, n binary, a double, b double").collect()
        shared.unpersist()
        judged = sum(r["b"] for r in parts)
        metric.append(sum(r["a"] for r in parts) / judged if judged else float("nan"))
        if not judged or epoch == 0 or metric[-1] > metric[chosen]:
            best, chosen = weights, epoch
        if epoch < epochs:
            grad = sum((np.frombuffer(r["g"]).reshape(weights.shape) for r in parts), np.zeros_like(weights))
            n = sum((np.frombuffer(r["n"]) for r in parts), np.zeros(outputs))
            weights = weights - rate * (grad / np.maximum(n, 1) + decay * np.vstack([weights[:-1], np.zeros((1, outputs))]))
    last = stored.sparkSession.sparkContext.broadcast(best)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column("x").flatten(), dtype=float).reshape(b.num_rows, width)
            p = outputs_of(x, last.value, classes)
            lists = pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * outputs, p.ravel())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("split"), lists], names=["id", "split", "p"])

    kind = stored.schema["id"].dataType.simpleString()
    out = stash(stored.select("id", "split", "x").mapInArrow(score, f"id {kind}, split string, p array<double>"), "probed")
    discard(stored)
    return out, chosen, metric
