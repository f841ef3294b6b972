"""A dense ReLU layer with a softmax output, trained by mini-batches as Spark jobs (M6, M7).

The train rows are written once, dealt into batches by a seeded key; a step
reads one batch, every task sums the gradients of its rows, and the sums meet
per weight matrix.  Weights and the optimiser's moments are on the driver:
their size is the model's.  After every epoch the held-out rows are scored;
training stops when their accuracy has not risen for ``patience`` epochs, and
the best weights are kept.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexis.functions.arrays import hex_int, seeded_key
from lexis.operators.boosting import matrix, softmax
from lexis.session import ensure_checkpoint_dir, written

# The reference's settings of the sequence model's head and its training.
HIDDEN = 100
EPOCHS = 2
BATCH_ROWS = 32
PATIENCE = 10
MIN_DELTA = 0.0001
LEARNING_RATE = 0.001
DECAY = 0.0001
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-7

MAX_STEPS = 200
"""Steps of an epoch at most: batches grow with the table beyond ``MAX_STEPS x BATCH_ROWS`` rows."""

Weights = list[np.ndarray]


def start_weights(dim: int, hidden: int, classes: int, seed: int) -> Weights:
    """Uniform weights within ``sqrt(6 / (in + out))``, biases zero."""
    rng = np.random.default_rng(seed)
    layer = lambda a, b: rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))
    return [layer(dim, hidden), np.zeros(hidden), layer(hidden, classes), np.zeros(classes)]


def forward(x: np.ndarray, weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Hidden activations and class probabilities."""
    w1, b1, w2, b2 = weights
    a = np.maximum(x @ w1 + b1, 0.0)
    return a, softmax(a @ w2 + b2)


def gradient_sums(x: np.ndarray, labels: np.ndarray, weights: Weights) -> tuple[Weights, float, int]:
    """Summed cross-entropy gradient by weight, summed loss, and rows classified right."""
    a, p = forward(x, weights)
    rows = np.arange(len(x))
    loss = float(-np.log(np.maximum(p[rows, labels], 1e-300)).sum())
    hits = int((p.argmax(axis=1) == labels).sum())
    off = p.copy()
    off[rows, labels] -= 1.0
    back = (off @ weights[2].T) * (a > 0)
    return [x.T @ back, back.sum(axis=0), a.T @ off, off.sum(axis=0)], loss, hits


def batch_gradient(batch: DataFrame, weights: Weights, dim: int) -> tuple[Weights, float, int, int]:
    """Gradient, loss, hits and rows of one batch (``label, v``), summed over its tasks."""
    def run(batches):
        sums, total = [np.zeros_like(w) for w in weights], np.zeros(3)
        for part in batches:
            labels = part.column("label").to_numpy().astype(np.int64)
            g, loss, hits = gradient_sums(matrix(part.column("v"), dim), labels, weights)
            sums = [a + b for a, b in zip(sums, g)]
            total += (loss, hits, len(labels))
        yield pa.RecordBatch.from_arrays([pa.array(range(5), pa.int32()), pa.array([s.tobytes() for s in (*sums, total)], pa.binary())], names=["layer", "part"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(x.as_buffer(), float) for batch in batches for x in batch.column("part"))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.asarray(total).tobytes()], pa.binary())], names=["layer", "part"])

    rows = {r["layer"]: np.frombuffer(bytes(r["part"]), float) for r in batch.mapInArrow(run, "layer int, part binary").groupBy("layer").applyInArrow(add, "layer int, part binary").collect()}
    if not rows:
        return [np.zeros_like(w) for w in weights], 0.0, 0, 0
    loss, hits, n = rows[4]
    return [rows[i].reshape(w.shape) for i, w in enumerate(weights)], float(loss), int(hits), int(n)


class _Adam:
    """Adaptive moments with a learning rate that falls as ``1 / (1 + decay x step)``."""

    def __init__(self, weights: Weights):
        self.step, self.first, self.second = 0, [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]

    def apply(self, weights: Weights, gradient: Weights) -> Weights:
        rate = LEARNING_RATE / (1 + DECAY * self.step)
        self.step += 1
        self.first = [BETA1 * m + (1 - BETA1) * g for m, g in zip(self.first, gradient)]
        self.second = [BETA2 * v + (1 - BETA2) * g * g for v, g in zip(self.second, gradient)]
        scale = rate * np.sqrt(1 - BETA2 ** self.step) / (1 - BETA1 ** self.step)
        return [w - scale * m / (np.sqrt(v) + EPSILON) for w, m, v in zip(weights, self.first, self.second)]


class DenseHead(Model):
    """A fitted head; ``transform`` adds ``prediction`` (the first class of highest probability)."""

    def __init__(self, weights: Weights, vec_col: str):
        super().__init__()
        self.weights, self.vec_col = weights, vec_col

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = self.weights

        @F.pandas_udf("double")
        def predicted(vectors):
            import pandas as pd

            x = np.stack(vectors.to_numpy()).astype(float) if len(vectors) else np.zeros((0, len(weights[0])))
            return pd.Series(forward(x, weights)[1].argmax(axis=1).astype(float))

        return dataset.withColumn("prediction", predicted(F.col(self.vec_col).cast("array<double>")))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        rows = [(i, list(w.shape), [float(x) for x in w.ravel()]) for i, w in enumerate(self.weights)]
        spark.createDataFrame(rows, "layer int, shape array<int>, entries array<double>").write.mode("overwrite").parquet(f"{path}/weights")
        meta = {"class": f"{type(self).__module__}.{type(self).__name__}", "vec_col": self.vec_col}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @staticmethod
    def load(path: str) -> "DenseHead":
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        rows = spark.read.parquet(f"{path}/weights").orderBy("layer").collect()
        return DenseHead([np.array(r["entries"]).reshape(r["shape"]) for r in rows], meta["vec_col"])


def fit_dense(train: DataFrame, classes: int, dim: int, id_col: str, vec_col: str = "vec", label_col: str = "label", validation_col: str | None = None,
              hidden: int = HIDDEN, epochs: int = EPOCHS, batch_rows: int = BATCH_ROWS, patience: int = PATIENCE, seed: int = 42) -> tuple[DenseHead, str, list[float]]:
    """A head fitted on the train rows, its settings, and the accuracy that ended each epoch.

    Accuracy is that of the rows marked in ``validation_col`` (without it, of
    the epoch's batches).  Rows with a null label or vector are left out.
    """
    spark = train.sparkSession
    held = F.coalesce(F.col(validation_col), F.lit(False)) if validation_col else F.lit(False)
    rows = train.filter(F.col(label_col).isNotNull() & F.col(vec_col).isNotNull())
    rows = written(rows.select(F.col(label_col).cast("int").alias("label"), F.col(vec_col).cast("array<double>").alias("v"), held.alias("held"),
                               hex_int(seeded_key(f"{seed}-batch", id_col), 1, 12).alias("at")), "dense-rows")
    n = rows.filter("NOT held").count()
    steps = max(1, min(MAX_STEPS, -(-n // batch_rows)))
    dealt = rows.withColumn("batch", F.when(F.col("held"), -1).otherwise(F.col("at") % steps).cast("int")).select("batch", "label", "v")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lexis/dense-batches-{uuid.uuid4().hex}"
    dealt.write.partitionBy("batch").parquet(path)
    table = spark.read.schema(dealt.schema).parquet(path)  # a batch is a folder: a step reads no other
    weights, rng = start_weights(dim, hidden, classes, seed), np.random.default_rng(seed)
    optimiser, best, best_weights, waited, history = _Adam(weights), -np.inf, weights, 0, []
    for _ in range(epochs):
        seen = [0, 0]
        for b in rng.permutation(steps).tolist():
            gradient, _, hits, count = batch_gradient(table.filter(F.col("batch") == b).select("label", "v"), weights, dim)
            if count:
                seen = [seen[0] + hits, seen[1] + count]
                weights = optimiser.apply(weights, [g / count for g in gradient])
        if validation_col:
            _, _, hits, count = batch_gradient(table.filter("batch = -1").select("label", "v"), weights, dim)
            seen = [hits, count] if count else seen
        history.append(seen[0] / seen[1] if seen[1] else 0.0)
        if history[-1] > best + MIN_DELTA:
            best, best_weights, waited = history[-1], weights, 0
        else:
            waited += 1
            if waited >= patience:
                break
    params = {"hidden": hidden, "epochs": epochs, "batch_rows": batch_rows, "patience": patience, "learning_rate": LEARNING_RATE, "decay": DECAY}
    return DenseHead(best_weights, vec_col), json.dumps(params, sort_keys=True), history
