"""Writers of pipeline artefacts.

Everything is written by the executors through Spark's commit protocol;
small result tables are versioned snapshots rather than in-place rewrites,
because a table cannot be overwritten while the same job reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexis.operators.evaluate import upsert_by_key
from lexis.sources.stored import PARAMS_SCHEMA, RESULTS_SCHEMA, committed_versions, listed_versions


def write_split(df: DataFrame, path: str, overwrite: bool) -> None:
    """K1: write the split table partitioned by ``split`` only when ``overwrite`` is set.

    Without the flag the stored split is kept (mode ``ignore``) and later
    stages read it back with ``lexis.sources.stored.read_split``.
    """
    df.write.mode("overwrite" if overwrite else "ignore").partitionBy("split").parquet(path)


def write_doc_vectors(df: DataFrame, path: str, emb_name: str) -> None:
    """K2: document vectors of one embedding into ``path/emb_name=<name>/split=<s>``.

    Dynamic partition overwrite replaces only this embedding's partitions.
    """
    (df.withColumn("emb_name", F.lit(emb_name))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("emb_name", "split").parquet(path))


def _write_next(df: DataFrame, path: str) -> int:
    """Write ``df`` as a version number that no folder has yet; nothing existing is touched."""
    version = max(listed_versions(df.sparkSession, path), default=-1) + 1
    df.write.mode("errorifexists").parquet(f"{path}/version={version}")
    return version


def upsert_versioned(new: DataFrame, path: str, key: str = "model_name") -> int:
    """Keyed upsert (``upsert_by_key``) as a new snapshot ``version=<n+1>``.

    Readers take the highest *committed* version (``read_versioned``); a write
    that died leaves an uncommitted folder whose number is never used again.
    Returns the new version.
    """
    spark = new.sparkSession
    versions = committed_versions(spark, path)
    merged = upsert_by_key(spark.read.schema(new.schema).parquet(f"{path}/version={versions[0]}"), new, key) if versions else new
    return _write_next(merged, path)


def create_results_tables(spark: SparkSession, base: str, overwrite_results: bool,
                          overwrite_params: bool) -> None:
    """K3: empty the results / best-parameter tables when the flags are set (an empty next version)."""
    if overwrite_results:
        _write_next(spark.createDataFrame([], RESULTS_SCHEMA), f"{base}/results")
    if overwrite_params:
        _write_next(spark.createDataFrame([], PARAMS_SCHEMA), f"{base}/best_params")


def report_file_layout(report: DataFrame) -> DataFrame:
    """K4: long report -> the reference's CSV layout.

    Columns ``class, precision, recall, f1-score, support, accuracy``; the
    accuracy row carries only ``accuracy``; rows in ``row_order``.
    """
    is_acc = F.col("class") == "accuracy"
    return report.orderBy("row_order").select(
        F.when(~is_acc, F.col("class")).alias("class"),
        F.when(~is_acc, F.col("precision")).alias("precision"),
        F.when(~is_acc, F.col("recall")).alias("recall"),
        F.when(~is_acc, F.col("f1_score")).alias("f1-score"),
        F.when(~is_acc, F.col("support").cast("double")).alias("support"),
        F.when(is_acc, F.col("f1_score")).alias("accuracy"),
    )


def write_report(report: DataFrame, base: str, name: str) -> None:
    """K4: ``<base>/<name>-results.csv`` (one small file: the report has k + 3 rows)."""
    (report_file_layout(report).coalesce(1).write.mode("overwrite").option("header", True)
     .csv(f"{base}/{name}-results.csv"))


def write_conf_matrix(conf: DataFrame, base: str, name: str, k: int) -> None:
    """K5: dense headerless ``<name>-conf_mat.csv`` (rows = actual) plus the long Parquet form.

    The dense file is k rows; the long form keeps the row order explicit.
    """
    dense = (conf.groupBy("y_true").pivot("y_pred", list(range(k))).agg(F.sum("n").cast("double"))
             .na.fill(0.0).orderBy("y_true"))
    (dense.select(*[F.col(str(j)) for j in range(k)]).coalesce(1)
     .write.mode("overwrite").option("header", False).csv(f"{base}/{name}-conf_mat.csv"))
    conf.write.mode("overwrite").parquet(f"{base}/{name}-conf_mat.parquet")


def save_model(model, base: str, model_name: str, emb_name: str = "") -> str:
    """K8 / K9: ``<base>/<model>-<embedding>`` (or ``<model>``), overwritten."""
    name = f"{model_name}-{emb_name}" if emb_name else model_name
    path = f"{base}/{name}"
    if hasattr(model, "write"):
        model.write().overwrite().save(path)
    else:
        model.save(path)  # the library's own models overwrite their tables
    return path


def store_results(spark: SparkSession, base: str, model_name: str, emb_name: str, model,
                  params: str, results: DataFrame, report: DataFrame, conf: DataFrame, k: int) -> str:
    """Store one run - model, report, confusion matrix, results and parameter upserts.

    ``results`` is the one-row ``accuracy, f1`` table of the run; the
    matrix is computed once by the caller and every sink reads it.
    """
    name = f"{model_name}-{emb_name}" if emb_name else model_name
    if model is not None:
        save_model(model, f"{base}/models", model_name, emb_name)
    write_report(report, base, name)
    write_conf_matrix(conf, base, name, k)
    upsert_versioned(results.select(F.lit(name).alias("model_name"), "accuracy", "f1"), f"{base}/results")
    params_row = spark.createDataFrame([(name, params)], PARAMS_SCHEMA)
    upsert_versioned(params_row, f"{base}/best_params")
    return name


__all__ = ["write_split", "write_doc_vectors", "upsert_versioned", "create_results_tables",
           "report_file_layout", "write_report", "write_conf_matrix", "save_model", "store_results"]
