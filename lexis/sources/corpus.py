"""Corpus and table readers (S1, S7, S9, driver tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexis.sources.records import read_csv_table

# Strings pandas' CSV reader turns into missing values by default.
NA_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table: ``<sf_dir>/<name>.parquet``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_corpus_csv(spark: SparkSession, path: str, columns: dict[str, str] | None = None,
                    id_col: str = "doc_id") -> DataFrame:
    """Headered CSV with quoted multi-line text, columns taken **by header name**.

    ``columns`` maps the result's names to header names (default ``product``
    and ``narrative``); extra columns and any order are fine, a missing one
    raises.  All values are read as text.  pandas' default missing-value
    strings become nulls so that P2 drops the same rows.  One large file is read
    by many tasks (``lexis.sources.records``).

    A CSV row has no key.  ``doc_id`` is made from the file name and the
    row's content and rank among equal rows of the file, so it does not depend
    on how the files are split; equal rows get different keys.
    """
    columns = columns or {"product": "product", "narrative": "narrative"}
    raw = read_csv_table(spark, path)
    missing = [c for c in columns.values() if c not in raw.columns]
    if missing:
        raise ValueError(f"{path}: no column {missing}")
    cell = lambda c: F.when(F.col(f"`{c}`").isin(NA_STRINGS), F.lit(None)).otherwise(F.col(f"`{c}`"))
    df = raw.select(F.col("file").alias("_file"), F.xxhash64(*[F.col(f"`{c}`") for c in raw.columns]).alias("_row"),
                    *[cell(c).alias(name) for name, c in columns.items()])
    # equal rows of one file are ranked: the window's groups are sets of equal rows
    again = F.row_number().over(Window.partitionBy("_file", "_row").orderBy("_row"))
    return df.withColumn(id_col, F.xxhash64("_file", "_row", again).bitwiseAND((1 << 62) - 1)).drop("_file", "_row")


def load_corpus(spark: SparkSession, sf_dir: str, text_col: str = "text",
                label_col: str = "lang", spread_input: bool = True) -> DataFrame:
    """Driver ``documents`` as the corpus: ``doc_id, text, label`` (P1 + P2).

    ``text`` plays the reference's ``narrative``, ``lang`` its ``product``.
    The column selection reaches the Parquet scan (``ReadSchema``).  An
    under-partitioned scan is spread over the cluster (``spread``).
    """
    from lexis.operators.partitioning import spread

    docs = read_table(spark, sf_dir, "documents")
    present = F.col("doc_id").isNotNull() & F.col(text_col).isNotNull() & F.col(label_col).isNotNull()
    corpus = docs.filter(present).select("doc_id", F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    return spread(corpus, "doc_id") if spread_input else corpus
