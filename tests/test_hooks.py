"""Metrics with a state and table functions of users."""

import numpy as np
import pytest

from loomgraph.functions import hooks as U
from loomgraph.operators import metrics as M


@pytest.mark.parametrize("k", [1, 5, 40, 10_000])
def test_hits_with_state(spark, k):
    rng = np.random.default_rng(k)
    rows = [(i, int(rng.integers(0, 3)), int(rng.integers(0, 30)), int(rng.integers(0, 2))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, task int, score int, y int").repartition(7)
    want = {r["task"]: r[f"hits_{k}"] for r in M.hits_at_k(df, [k], ["task"]).collect()}
    got = U.metric_with_state(df.withColumnRenamed("score", "pred"), ["task"], U.HitsAtK(k)).collect()
    assert {r["task"]: pytest.approx(r["value"]) for r in got} == want


def test_state_of_groups_with_null_and_no_keys(spark):
    class Mean:
        def start(self):
            return 0.0, 0

        def update(self, state, pred, y):
            return state[0] + sum(abs(p - v) for p, v in zip(pred, y)), state[1] + len(pred)

        def merge(self, a, b):
            return a[0] + b[0], a[1] + b[1]

        def finish(self, state):
            return state[0] / state[1]

    df = spark.createDataFrame([("a", 1.0, 2.0), (None, 3.0, 1.0), (None, 3.0, 3.0)], "`the key` string, pred double, y double")
    assert {r[0]: r[1] for r in U.metric_with_state(df, ["the key"], Mean()).collect()} == {"a": 1.0, None: 1.0}
    assert U.metric_with_state(df, [], Mean()).first()[0] == 1.0
    assert U.metric_with_state(df.limit(0), ["the key"], Mean()).count() == 0


def test_table_function_takes_rows_in_order(spark):
    df = spark.createDataFrame([(1, 2, 30), (1, 0, 10), (2, 0, 5), (1, 1, 20)], "root long, pos int, node long")
    got = {r.root: r.nodes for r in U.expand_table(df, U.NodeSequence, ["root"], ["pos"]).collect()}
    assert got == {1: [10, 20, 30], 2: [5]}
