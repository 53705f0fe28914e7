"""Extension points: functions chosen by name, chains from a short text, user encoders and metrics."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import UserDefinedTableFunction

from loomgraph.functions.columns import quoted

Transform = Callable[[DataFrame], DataFrame]


def resolve(config: dict[str, dict], registry: dict[str, Callable]) -> dict[str, Transform]:
    """U01. Task -> function from rows {task: {"op": name, "args": {...}}}; an unknown name is an error at once."""
    unknown = {c["op"] for c in config.values()} - set(registry)
    if unknown:
        raise KeyError(f"unknown operators: {sorted(unknown)}")
    return {task: (lambda df, c=c: registry[c["op"]](df, **c.get("args", {}))) for task, c in config.items()}


def chain(spec: str, registry: dict[str, Callable[[DataFrame, float], DataFrame]]) -> Transform:
    """U02. A chain such as ``ND0.5,NZ0.5``: letters name the step, the number is its share."""
    steps = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        name = part.rstrip("0123456789.")
        steps.append((registry[name], float(part[len(name) :] or 0)))

    def run(df: DataFrame) -> DataFrame:
        for f, share in steps:
            df = df.transform(f, share)
        return df

    return run


def encode(rows: DataFrame, encoder: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """U03. Rows with the encoder's array<float> as ``x``; a pandas_udf or any column function will do."""
    return rows.withColumn("x", encoder(F.col(text)).cast("array<float>"))


def metric(preds: DataFrame, keys: list[str], compute: Callable[[Column, Column], Column], name: str = "value") -> DataFrame:
    """U04. A user's aggregate of prediction and label in each group: a column expression or grouped pandas_udf."""
    return preds.groupBy(*keys).agg(compute(F.col("pred"), F.col("y")).alias(name))


def expand(rows: DataFrame, many: Callable[[DataFrame], Column], name: str = "item") -> DataFrame:
    """U05. One row for each element of the array that ``many`` makes, with its position."""
    return rows.select("*", F.posexplode(many(rows)).alias("pos", name))


class StatefulMetric(Protocol):
    """U04. A user's metric with a state that tasks build apart and Spark merges: any object that pickle knows."""

    def start(self) -> Any: ...
    def update(self, state: Any, pred: list, y: list) -> Any: ...
    def merge(self, a: Any, b: Any) -> Any: ...
    def finish(self, state: Any) -> float | None: ...


def metric_with_state(preds: DataFrame, keys: list[str], how: StatefulMetric, pred: str = "pred", y: str = "y", name: str = "value") -> DataFrame:
    """U04. (keys, value): ``how`` over the rows of each group. Each task updates one state for each group that it meets, and only
    states are shuffled; so a group may hold most rows, and a task holds a state for each group. Null keys are a group."""
    schema = preds.select(*quoted(keys)).schema
    packed = "{}_state binary".format("".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema.fields))
    final = "{}`{}` double".format("".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema.fields), name)

    def grouped(batch: pa.RecordBatch) -> Iterator[tuple[tuple, list[int]]]:
        at: dict[tuple, list[int]] = {}
        for i, k in enumerate(zip(*(batch.column(c).to_pylist() for c in keys), strict=True) if keys else [()] * batch.num_rows):
            at.setdefault(k, []).append(i)
        yield from at.items()

    def rows(states: dict[tuple, Any], like: pa.Schema, last: str, make: Callable, kind: pa.DataType) -> pa.RecordBatch:
        columns = {c: pa.array([k[i] for k in states], like.field(c).type) for i, c in enumerate(keys)}
        return pa.RecordBatch.from_pydict({**columns, last: pa.array([make(v) for v in states.values()], kind)})

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Any] = {}
        for b in batches:
            p, q = b.column(pred).to_pylist(), b.column(y).to_pylist()
            for k, at in grouped(b):
                states[k] = how.update(states[k] if k in states else how.start(), [p[i] for i in at], [q[i] for i in at])
        if states:
            yield rows(states, b.schema, "_state", pickle.dumps, pa.binary())

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Any] = {}
        for b in batches:
            data = b.column("_state").to_pylist()
            for k, at in grouped(b):
                for i in at:
                    new = pickle.loads(data[i])
                    states[k] = how.merge(states[k], new) if k in states else new
        if states:
            yield rows(states, b.schema, name, how.finish, pa.float64())

    parts = preds.select(*quoted(keys), pred, y).mapInArrow(partial, packed)
    parts = parts.repartition(*quoted(keys)) if keys else parts.repartition(1)  # one state of each task
    return parts.mapInArrow(merged, final)


class HitsAtK:
    """Share of positives strictly above the k-th best negative, 1 with fewer than k negatives; the state holds the k best negatives and
    those positives by score that may still be above the k-th."""

    def __init__(self, k: int):
        self.k = k

    def start(self):
        return [], Counter(), 0, 0

    def _cut(self, best, above, n_pos, n_neg):
        best = sorted(best, reverse=True)[: self.k]
        if len(best) == self.k:  # the k-th best only rises
            above = Counter({s: c for s, c in above.items() if s > best[-1]})
        return best, above, n_pos, n_neg

    def update(self, state, pred, y):
        best, above, n_pos, n_neg = state
        pos = [p for p, v in zip(pred, y, strict=True) if v]
        neg = [p for p, v in zip(pred, y, strict=True) if not v]
        return self._cut(best + neg, above + Counter(pos), n_pos + len(pos), n_neg + len(neg))

    def merge(self, a, b):
        return self._cut(a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] + b[3])

    def finish(self, state):
        _, above, n_pos, n_neg = state
        return 1.0 if n_neg < self.k else sum(above.values()) / n_pos if n_pos else None


def expand_table(rows: DataFrame, function: UserDefinedTableFunction, keys: list[str], order: list[str]) -> DataFrame:
    """U05. What a user's table function makes of each group of rows, which it is fed one by one in the given order."""
    return function(rows.asTable().partitionBy(*keys).orderBy(*order))


@udtf(returnType="root bigint, nodes array<bigint>")
class NodeSequence:
    """The nodes of a root's rows (root, pos, node), as they come."""

    def __init__(self):
        self.root, self.nodes = None, []

    def eval(self, row):
        self.root = row["root"]
        self.nodes.append(row["node"])

    def terminate(self):
        if self.nodes:
            yield self.root, self.nodes
