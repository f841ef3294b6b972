"""Linear scoring and arg-max decoding as table operations."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexis.functions.arrays import argmax
from lexis.operators.joins import DEFAULT_BROADCAST_BYTES, bounded_broadcast_bytes


def linear_scores(doc_vecs: DataFrame, weights: list[list[float]], vec_col: str = "vec",
                  bias: list[float] | None = None) -> DataFrame:
    """M8: ``scores[c] = vec . W[c] (+ b[c])`` per document and the arg-max class.

    ``weights`` is k x dim (a trained linear model's coefficients: bounded by
    the class count), inlined as literals, so scoring is one projection -
    no join, no shuffle.  Sums run left to right over the dimensions.
    """
    v = F.col(vec_col)
    per_class = []
    for c, row in enumerate(weights):
        terms = [v[d] * F.lit(float(w)) for d, w in enumerate(row)]
        s = reduce(lambda a, b: a + b, terms)
        if bias is not None:
            s = s + F.lit(float(bias[c]))
        per_class.append(s)
    scores = F.array(*per_class)
    return doc_vecs.withColumn("scores", F.when(v.isNotNull(), scores)) \
        .withColumn("y_pred", argmax("scores"))


def softmax(scores) -> F.Column:
    """Row-wise softmax of a score array (max-shifted)."""
    scores = F.col(scores) if isinstance(scores, str) else scores
    m = F.array_max(scores)
    ex = F.transform(scores, lambda s: F.exp(s - m))
    tot = F.aggregate(ex, F.lit(0.0), lambda a, x: a + x)
    return F.transform(ex, lambda x: x / tot)


def argmax_decode(df: DataFrame, probs_col: str = "probs", out_col: str = "y_pred") -> DataFrame:
    """Class index of the first maximum probability (one-hot rows decode the same way)."""
    return df.withColumn(out_col, argmax(probs_col))


# ------------------------------------------------- fitted linear models
COEFFICIENTS = "class int, position int, coefficient double"
"""A linear model as a table: one row per class and vector position; position -1 holds the intercept."""


def fit_centroids(doc_vecs: DataFrame, label_col: str = "code", vec_col: str = "vec") -> DataFrame:
    """A nearest-centroid classifier as a linear model: ``w_c`` is the mean vector of a class, the intercept ``-|w_c|^2 / 2``.

    One aggregation; rows without a vector or label are left out.
    """
    entries = doc_vecs.filter(F.col(vec_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(label_col).cast("int").alias("class"), F.posexplode(vec_col).alias("position", "x"))
    means = entries.groupBy("class", "position").agg(F.avg("x").alias("coefficient"))
    intercepts = means.groupBy("class").agg((-F.sum(F.col("coefficient") * F.col("coefficient")) / 2).alias("coefficient"))
    return means.unionByName(intercepts.select("class", F.lit(-1).alias("position"), "coefficient"))


def model_coefficients(spark, weights: list[list[float]], intercepts: list[float]) -> DataFrame:
    """The coefficient table of a fitted linear model (e.g. the ``coefficientMatrix`` and ``interceptVector`` of a Spark ML one)."""
    rows = [(c, d, float(w)) for c, row in enumerate(weights) for d, w in enumerate(row)]
    return spark.createDataFrame(rows + [(c, -1, float(b)) for c, b in enumerate(intercepts)], COEFFICIENTS)


def _collected(coefficients: DataFrame) -> tuple[list[int], list[list[float]], list[float]]:
    """Classes, weights and intercepts: classes x positions numbers, bounded by the model."""
    rows = coefficients.collect()
    classes = sorted({r["class"] for r in rows})
    at = {(r["class"], r["position"]): r["coefficient"] for r in rows}
    dim = max((r["position"] for r in rows), default=-1) + 1
    return classes, [[at.get((c, d), 0.0) for d in range(dim)] for c in classes], [at.get((c, -1), 0.0) for c in classes]


class LinearClassifier(Model):
    """A linear model over a coefficient table; ``transform`` adds ``prediction`` (the first class of highest score)."""

    def __init__(self, classes: list[int], weights: list[list[float]], intercepts: list[float], vec_col: str):
        super().__init__()
        self.classes, self.weights, self.intercepts, self.vec_col = classes, weights, intercepts, vec_col

    def coefficients(self, spark) -> DataFrame:
        rows = [(c, d, float(w)) for c, row in zip(self.classes, self.weights) for d, w in enumerate(row)]
        return spark.createDataFrame(rows + [(c, -1, float(b)) for c, b in zip(self.classes, self.intercepts)], COEFFICIENTS)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored = linear_scores(dataset.withColumn("_linear_vec", F.col(self.vec_col)), self.weights, "_linear_vec", self.intercepts)
        labels = F.array(*[F.lit(float(c)) for c in self.classes])
        return scored.withColumn("prediction", labels[F.col("y_pred")]).drop("_linear_vec", "scores", "y_pred")

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.coefficients(spark).write.mode("overwrite").parquet(f"{path}/coefficients")
        meta = {"class": f"{type(self).__module__}.{type(self).__name__}", "vec_col": self.vec_col}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @staticmethod
    def load(path: str) -> "LinearClassifier":
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        return LinearClassifier(*_collected(spark.read.parquet(f"{path}/coefficients")), meta["vec_col"])


def centroid_classifier(doc_vecs: DataFrame, label_col: str = "label", vec_col: str = "vec") -> LinearClassifier:
    """``fit_centroids`` as a model that predicts, saves and loads."""
    return LinearClassifier(*_collected(fit_centroids(doc_vecs, label_col, vec_col)), vec_col)


def token_contributions(tokens: DataFrame, vectors: DataFrame, coefficients: DataFrame, tokens_col: str = "tokens", doc_col: str = "doc_id",
                        true_col: str = "code", broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """``doc_id, pos, word, weight, y_true, y_pred, score`` of every known token, exact for a linear model over mean vectors.

    A document's vector is the mean of its n known word vectors, so the class
    score is the intercept plus, for each known token, ``w_c . vec / n``: that
    is the token's weight, and weights and intercept sum to the score.  The
    products are worked out once per word; documents without a known word
    have no rows.  The predicted class is the first of highest score.
    """
    classes, weights, intercepts = _collected(coefficients)
    dot = lambda row: F.aggregate(F.zip_with("vec", F.array(*[F.lit(w) for w in row]), lambda x, w: x.cast("double") * w), F.lit(0.0), lambda a, x: a + x)
    words = vectors.select("word", F.array(*[dot(row) for row in weights]).alias("_parts"))
    words, _ = bounded_broadcast_bytes(words, 8 * len(classes) + 64, broadcast_bytes)
    known = tokens.select(doc_col, F.col(true_col).alias("y_true"), F.posexplode_outer(tokens_col).alias("pos", "word")).join(words, "word", "inner")
    sums = known.groupBy(doc_col).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col("_parts")[i]).alias(f"_s{i}") for i in range(len(classes))])
    scores = F.array(*[F.col(f"_s{i}") / F.col("_n") + F.lit(b) for i, b in enumerate(intercepts)])
    scored = sums.select(doc_col, "_n", scores.alias("_scores")).withColumn("_best", argmax("_scores"))
    labels = F.array(*[F.lit(c) for c in classes])
    return known.join(scored, doc_col).select(
        doc_col, "pos", "word", (F.col("_parts")[F.col("_best")] / F.col("_n")).alias("weight"), "y_true", labels[F.col("_best")].alias("y_pred"),
        F.col("_scores")[F.col("_best")].alias("score"))
