"""The probe against the same descent in numpy."""

import numpy as np
import pytest

from loomgraph.operators.probe import outputs_of, probe


@pytest.mark.parametrize("classes", [True, False])
def test_probe_equals_numpy(spark, classes):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in table], dtype=float)
    label = np.array([r.label for r in table]) % 4
    split = np.array(["train", "valid", "test", "train", "train"] * len(x))[: len(x)]
    y = np.eye(4)[label]
    if not classes:
        y[:, 1] = x[:, 0] > 0
        y[::3, 2] = np.nan
        y[::7] = np.nan
    rows = [(i, x[i].tolist(), None if np.isnan(y[i]).all() else [None if np.isnan(v) else int(v) for v in y[i]], str(split[i])) for i in range(len(x))]
    df = spark.createDataFrame(rows, "id long, x array<double>, y array<int>, split string").repartition(3)
    out, chosen, metric = probe(df, 4, classes, epochs=6, rate=2.0, decay=0.01)
    w, best, want, there = np.zeros((65, 4)), None, [], ~np.isnan(y)
    train, valid = split == "train", split == "valid"
    for _ in range(7):
        p = outputs_of(x, w, classes)
        hit = (p.argmax(axis=1) == np.nan_to_num(y).argmax(axis=1))[valid] if classes else ((p >= 0.5) == (y >= 0.5))[there & valid[:, None]]
        want.append(hit.mean())
        if want[-1] > max(want[:-1], default=-1):
            best = p
        off = np.where(there & train[:, None], p - np.nan_to_num(y), 0)
        n = (there & train[:, None]).sum(axis=0)
        w = w - 2.0 * (np.vstack([x.T @ off, off.sum(axis=0)]) / n + 0.01 * np.vstack([w[:-1], np.zeros((1, 4))]))
    assert np.allclose(metric, want) and chosen == int(np.argmax(want))
    got = {r.id: r.p for r in out.collect()}
    assert len(got) == len(x) and np.allclose([got[i] for i in range(len(x))], best)


def test_probe_without_valid_rows_or_rows(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0], [1, 0], "train"), (2, [1.0, 0.0], [0, 1], "train"), (3, None, [0, 1], "train"), (4, [1.0, 1.0], None, "test")], "id long, x array<double>, y array<int>, split string")
    out, chosen, metric = probe(df, 2, epochs=3)
    assert chosen == 3 and len(metric) == 4 and {r.id for r in out.collect()} == {1, 2, 4}
    assert probe(df.limit(0), 2, epochs=1)[0].count() == 0
