"""Readers of stored pipeline artefacts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPORT_SCHEMA = T.StructType([
    T.StructField("class", T.StringType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1-score", T.DoubleType()),
    T.StructField("support", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()),
])
RESULTS_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("f1", T.DoubleType()),
])
PARAMS_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("params", T.StringType()),
])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written (committed) at ``path``."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The stored split table; ``split`` = 'train' / 'test' prunes partitions."""
    df = spark.read.parquet(path)
    return df if split is None else df.filter(F.col("split") == split)


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_doc_vectors(spark: SparkSession, path: str, emb_name: str, split: str | None = None) -> DataFrame:
    """Document vectors of one embedding (partition pruning on ``emb_name``/``split``)."""
    df = spark.read.parquet(path).filter(F.col("emb_name") == emb_name)
    return df if split is None else df.filter(F.col("split") == split)


def listed_versions(spark: SparkSession, path: str) -> dict[int, bool]:
    """``{version: committed?}`` of the ``version=<n>`` folders under ``path``.

    Lists the folder through the cluster's file system.  Only a folder that
    does not exist counts as empty; every other error is raised, so a table
    that cannot be read is never taken for a new one.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return {}
    found = {}
    for entry in fs.listStatus(root):
        name = entry.getPath().getName()
        if entry.isDirectory() and re.fullmatch(r"version=\d+", name):
            found[int(name.split("=")[1])] = fs.exists(jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS"))
    return found


def committed_versions(spark: SparkSession, path: str) -> list[int]:
    """Snapshot versions under ``path`` whose write committed (``_SUCCESS`` present), newest first."""
    return sorted((v for v, done in listed_versions(spark, path).items() if done), reverse=True)


def read_versioned(spark: SparkSession, path: str) -> DataFrame:
    """Latest committed snapshot of a table written by ``lexis.sinks.upsert_versioned``."""
    versions = committed_versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no committed snapshot under {path}")
    return spark.read.parquet(f"{path}/version={versions[0]}")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results table ``model_name, accuracy, f1`` (latest snapshot)."""
    return read_versioned(spark, path)


def read_reports(spark: SparkSession, base: str, pattern: str = "*-results.csv") -> DataFrame:
    """Every report file under ``base`` in one scan, with ``model_name`` from the file name.

    Files that are missing are simply not matched (the reference skips them).
    Works for single files (the reference's layout) and for Spark-written
    ``<model>-results.csv/part-*`` directories.
    Layout per file: class rows, ``accuracy`` row (only the last field), macro and
    weighted rows; ``row_order`` keeps the file order (k + 3 rows per file).
    """
    raw = (spark.read.option("header", True).schema(REPORT_SCHEMA).csv(f"{base.rstrip('/')}/{pattern}")
           .withColumn("model_name", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)-results\.csv(/[^/]*)?$", 1))
           .withColumn("_ord", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                                       F.monotonically_increasing_id())))
    w = Window.partitionBy("model_name").orderBy("_ord")
    return raw.withColumn("row_order", (F.row_number().over(w) - 1).cast("int")).drop("_ord")


def report_metric(reports: DataFrame, metric: str, classes: list[str]) -> DataFrame:
    """One metric column, class rows only (the first k rows of each report)."""
    return (reports.filter(F.col("class").isin(classes))
            .select("model_name", "class", F.col(f"`{metric}`").alias(metric)))


def read_conf_matrices(spark: SparkSession, base: str, k: int, pattern: str = "*-conf_mat.csv") -> DataFrame:
    """Headerless dense k x k matrices -> long ``model_name, y_true, y_pred, n``.

    Row order in the file is the actual class; it is recovered per file
    from the scan order (a window over k rows per file), then ``stack``
    unpivots the k columns.
    """
    schema = T.StructType([T.StructField(f"c{j}", T.DoubleType()) for j in range(k)])
    raw = (spark.read.option("header", False).schema(schema).csv(f"{base.rstrip('/')}/{pattern}")
           .withColumn("model_name", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)-conf_mat\.csv(/[^/]*)?$", 1))
           .withColumn("_ord", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                                       F.monotonically_increasing_id())))
    w = Window.partitionBy("model_name").orderBy("_ord")
    rows = raw.withColumn("y_true", (F.row_number().over(w) - 1).cast("int"))
    stack = "stack({k}, {pairs}) as (y_pred, n)".format(
        k=k, pairs=", ".join(f"{j}, c{j}" for j in range(k)))
    return rows.select("model_name", "y_true", F.expr(stack)).select(
        "model_name", "y_true", F.col("y_pred").cast("int").alias("y_pred"), F.col("n").cast("long").alias("n"))


def load_model(path: str, spark: SparkSession | None = None):
    """Any saved model: Spark ML's (pipeline, cross-validation, classifier, word2vec) or the library's own.

    The model class is read from the saved metadata, mapped to its
    ``pyspark.ml`` counterpart where it is Spark's, and loads itself.
    """
    import importlib
    import json

    spark = spark or SparkSession.getActiveSession()
    meta = json.loads(spark.read.text(f"{path.rstrip('/')}/metadata").first()[0])
    jvm_class = meta["class"]                      # e.g. org.apache.spark.ml.classification.XModel
    module, name = jvm_class.replace("org.apache.spark.ml", "pyspark.ml").rsplit(".", 1)
    return getattr(importlib.import_module(module), name).load(path)
