"""The dense head: gradient against differences and over tasks, learning, early stop, storage."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexis.operators import dense as D
from lexis.sources import stored as S


def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(12, 4)), rng.integers(0, 3, 12)
    weights = D.start_weights(4, 5, 3, 1)
    gradient, loss, _ = D.gradient_sums(x, y, weights)
    for w, g in zip(weights, gradient):
        for at in np.ndindex(w.shape):
            keep = w[at]
            w[at] = keep + 1e-6
            assert (D.gradient_sums(x, y, weights)[1] - loss) / 1e-6 == pytest.approx(g[at], rel=1e-3, abs=1e-4)
            w[at] = keep


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(2)
    label = np.arange(240) % 3
    rows = [(i, int(c), (np.eye(3)[c] * 3 + rng.normal(scale=0.4, size=3)).tolist(), i % 10 == 0) for i, c in enumerate(label)]
    return spark.createDataFrame(rows + [(900, None, [0.0] * 3, False), (901, 1, None, None)], "doc_id long, label int, vec array<double>, is_val boolean").repartition(4).cache()


def test_batch_gradient_is_the_sum_over_tasks(blobs):
    rows = blobs.filter("label IS NOT NULL AND vec IS NOT NULL")
    weights = D.start_weights(3, 4, 3, 7)
    gradient, loss, hits, n = D.batch_gradient(rows.select("label", F.col("vec").alias("v")), weights, 3)
    local = rows.collect()
    want = D.gradient_sums(np.array([r["vec"] for r in local]), np.array([r["label"] for r in local]), weights)
    assert n == 240 and hits == want[2] and loss == pytest.approx(want[1])
    assert all(np.allclose(a, b) for a, b in zip(gradient, want[0]))


def test_learns_stops_and_is_stored(spark, blobs, monkeypatch):
    monkeypatch.setattr(D, "LEARNING_RATE", 0.05)
    model, params, history = D.fit_dense(blobs, 3, 3, "doc_id", validation_col="is_val", epochs=12, batch_rows=60, patience=3, hidden=30)
    out = model.transform(blobs.filter("label IS NOT NULL AND vec IS NOT NULL"))
    assert out.filter("prediction = label").count() > 0.9 * 240
    assert len(history) < 12 or max(history[-3:]) > max(history[:-3])  # no rise for three epochs ends it
    path = tempfile.mkdtemp(prefix="lexis-dense-", dir="/tmp")
    model.save(path)
    back = S.load_model(path).transform(blobs.filter("vec IS NOT NULL")).select("doc_id", "prediction").orderBy("doc_id").collect()
    assert back == model.transform(blobs.filter("vec IS NOT NULL")).select("doc_id", "prediction").orderBy("doc_id").collect()
