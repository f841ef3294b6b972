"""Evaluation operators.

Everything derives from one aggregate: the long confusion table
``(group..., y_true, y_pred, n)``.  It has at most k*k rows per model, so
reports, accuracies and roll-ups never touch the predictions again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexis.functions.names import split_model_name
from lexis.operators.joins import bounded_broadcast

MAX_LABELS = 10_000


def _zero_div(num, den):
    """``num / den`` with 0 when the denominator is 0 (sklearn's zero_division=0)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def confusion_long(preds: DataFrame, group_cols: list[str] | None = None,
                   y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """V5: ``group..., y_true, y_pred, n`` over the sorted union of labels, zeros kept.

    Counting is a partial + final hash aggregate (k*k rows per group after
    the map side).  The label set per group is at most k values, so the
    zero grid is built from it with two explodes - no cross join.
    """
    g = list(group_cols or [])
    counts = preds.groupBy(*g, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n"))
    labels = counts.groupBy(*g).agg(
        F.array_sort(F.array_union(F.collect_set("y_true"), F.collect_set("y_pred"))).alias("labels"))
    grid = (labels.select(*g, F.explode("labels").alias("y_true"), "labels")
            .select(*g, "y_true", F.explode("labels").alias("y_pred")))
    return (grid.join(counts, g + ["y_true", "y_pred"], "left")
            .select(*g, "y_true", "y_pred", F.coalesce("n", F.lit(0).cast("long")).alias("n")))


def class_stats(conf: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Per class: ``tp, support`` (row sum), ``predicted`` (column sum) from a long confusion."""
    g = list(group_cols or [])
    parts = F.explode(F.array(
        F.struct(F.col("y_true").alias("cls"), F.col("n").alias("sup"), F.lit(0).cast("long").alias("prd"),
                 F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).cast("long").alias("tp")),
        F.struct(F.col("y_pred").alias("cls"), F.lit(0).cast("long").alias("sup"), F.col("n").alias("prd"),
                 F.lit(0).cast("long").alias("tp")),
    ))
    return (conf.select(*g, parts.alias("p")).select(*g, "p.*")
            .groupBy(*g, "cls").agg(F.sum("tp").alias("tp"), F.sum("sup").alias("support"),
                                    F.sum("prd").alias("predicted")))


def per_class_metrics(conf: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """V3: ``group..., cls, precision, recall, f1_score, support, tp``; 0 when a denominator is 0."""
    g = list(group_cols or [])
    s = class_stats(conf, g)
    return s.select(*g, "cls", "tp",
                    _zero_div(F.col("tp"), F.col("predicted")).alias("precision"),
                    _zero_div(F.col("tp"), F.col("support")).alias("recall"),
                    _zero_div(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1_score"),
                    F.col("support"))


def accuracy_f1(conf: DataFrame, group_cols: list[str] | None = None, digits: int = 4) -> DataFrame:
    """V1 + V2: accuracy and macro F1, half-even rounded to ``digits``.

    Both come from the per-class table in one aggregation: accuracy is
    sum(tp) / sum(support) (= trace / total), macro F1 the mean class F1.
    """
    g = list(group_cols or [])
    m = per_class_metrics(conf, g)
    return m.groupBy(*g).agg(
        F.bround(F.sum("tp") / F.sum("support"), digits).alias("accuracy"),
        F.bround(F.avg("f1_score"), digits).alias("f1"))


def classification_report(conf: DataFrame, names: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """V3 + V4 in the long report layout (one table per group).

    Rows: one per class (name from ``names(code, label)``), then
    ``accuracy`` (its value in ``f1_score``, total in ``support``), ``macro avg``
    and ``weighted avg``.  ``row_order`` keeps the reference's row order.
    """
    g = list(group_cols or [])
    m = per_class_metrics(conf, g)
    lookup = bounded_broadcast(names.select(F.col("code").alias("cls"), F.col("label").alias("class")),
                               MAX_LABELS)
    cls_rows = (m.join(lookup, "cls", "left")
                .select(*g, F.coalesce(F.col("class"), F.col("cls").cast("string")).alias("class"),
                        "precision", "recall", "f1_score", "support",
                        F.col("cls").cast("int").alias("row_order")))
    tot = m.groupBy(*g).agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1_score") * F.col("support")) / F.sum("support")).alias("wf"),
        F.sum("support").alias("support"), F.count(F.lit(1)).alias("k"),
        (F.sum("tp") / F.sum("support")).alias("acc"))
    none = F.lit(None).cast("double")
    summary = tot.select(*g, F.explode(F.array(
        F.struct(F.lit("accuracy").alias("class"), none.alias("precision"), none.alias("recall"),
                 F.col("acc").alias("f1_score"), F.col("support"), (F.col("k") + 0).cast("int").alias("row_order")),
        F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1_score"), F.col("support"), (F.col("k") + 1).cast("int").alias("row_order")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                 F.col("wf").alias("f1_score"), F.col("support"), (F.col("k") + 2).cast("int").alias("row_order")),
    )).alias("r")).select(*g, "r.*")
    return cls_rows.unionByName(summary)


def confusion_dense(conf: DataFrame, names: DataFrame, classes: list[str],
                    group_cols: list[str] | None = None) -> DataFrame:
    """rows = actual class, one column per predicted class (explicit pivot values)."""
    g = list(group_cols or [])
    lookup = bounded_broadcast(names.select(F.col("code"), F.col("label")), MAX_LABELS)
    named = (conf.join(lookup.withColumnRenamed("code", "y_true")
                       .withColumnRenamed("label", "actual"), "y_true", "left")
             .join(lookup.withColumnRenamed("code", "y_pred")
                   .withColumnRenamed("label", "predicted"), "y_pred", "left"))
    return (named.groupBy(*g, "actual").pivot("predicted", classes).agg(F.sum("n"))
            .na.fill(0, subset=classes))


def confusion_rollup(conf: DataFrame, group_cols: list[str]) -> DataFrame:
    """Element-wise sum of confusion tables over everything not in ``group_cols``."""
    return conf.groupBy(*group_cols, "y_true", "y_pred").agg(F.sum("n").cast("long").alias("n"))


def results_with_parts(results: DataFrame) -> DataFrame:
    """P12 + P13: add ``model``/``embedding`` and percent-scaled metrics."""
    model, emb = split_model_name("model_name")
    return results.select("model_name", model.alias("model"), emb.alias("embedding"),
                          (F.col("accuracy") * 100.0).alias("accuracy"), (F.col("f1") * 100.0).alias("f1"))


def leaderboard(results: DataFrame, by: str) -> DataFrame:
    """Mean percent accuracy / F1 per ``model`` or ``embedding``, best first."""
    parts = results_with_parts(results)
    return (parts.groupBy(by).agg(F.avg("accuracy").alias("accuracy"), F.avg("f1").alias("f1"),
                                  F.count(F.lit(1)).alias("n_runs"))
            .orderBy(F.desc("accuracy"), F.asc(by)))


def class_metric_pivot(reports: DataFrame, model: str, metric: str,
                       embeddings: list[str], classes: list[str]) -> DataFrame:
    """V9: per class, one column per embedding with ``metric``; ``axis_floor`` = min - 0.15.

    ``reports`` is the union of report tables with a ``model_name`` column;
    runs that are missing are simply absent (the reference skips missing files).
    """
    m, emb = split_model_name("model_name")
    rows = (reports.filter(F.col("class").isin(classes))
            .select(m.alias("model"), emb.alias("embedding"), "class", F.col(metric).alias("v"))
            .filter(F.col("model") == model))
    wide = rows.groupBy("class").pivot("embedding", embeddings).agg(F.first("v"))
    mins = [F.min(F.col(e)).over(Window.partitionBy()) for e in embeddings]
    floor = (F.least(*mins) if len(mins) > 1 else mins[0]) - F.lit(0.15)
    return wide.withColumn("axis_floor", floor)


def model_accuracy(results: DataFrame, model_name: str) -> DataFrame:
    """Accuracy row(s) of one run."""
    return results.filter(F.col("model_name") == model_name).select("model_name", "accuracy")


def upsert_by_key(old: DataFrame, new: DataFrame, key: str = "model_name") -> DataFrame:
    """Drop the rows of ``old`` whose key is in ``new``, then append ``new``."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
