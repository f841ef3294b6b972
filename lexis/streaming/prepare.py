"""The preparation and word-count operators over a Structured Streaming source.

The reference is batch-only; this module does not add operators.  It runs
the same column functions on documents arriving as files:

* ``stream_prepare`` - tokenize, attach label codes (static broadcast
  lookup), assign the split per row from the seeded md5 key, append to a
  Parquet table.  On an unbounded stream the exact "ceil(n * 0.1) rows"
  split has no fixed n, so the per-row form ``unit(md5) < test_size`` is
  used; it gives the same expected share and never changes a row's split.
* ``stream_word_class_counts`` - the X5 term-frequency table maintained
  incrementally (stateful aggregation keyed by word; the state store holds
  one row per word, checkpointed to the shared folder).

Checkpoints live under ``spark.checkpoint.dir`` (the cluster's shared
folder) unless a location is passed.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexis.functions.arrays import seeded_key, unit_interval
from lexis.functions.text import word_tokens
from lexis.operators.joins import bounded_broadcast
from lexis.session import ensure_checkpoint_dir

DOCUMENT_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


def read_document_stream(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT_SCHEMA,
                         max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files under ``path`` (a folder or glob) as a stream ``doc_id, text, label``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.parquet(path)
    present = F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()
    return df.filter(present).select("doc_id", "text", F.col("lang").alias("label"))


def prepare_stream(docs: DataFrame, codes: DataFrame, test_size: float = 0.1, seed: str = "42") -> DataFrame:
    """Streaming rows ``doc_id, label, code, tokens, split`` (a stateless projection + broadcast join)."""
    split = F.when(unit_interval(seeded_key(f"{seed}s", "doc_id")) < F.lit(test_size), "test").otherwise("train")
    return (docs.select("doc_id", "label", word_tokens("text").alias("tokens"), split.alias("split"))
            .join(bounded_broadcast(codes, 10_000), "label", "inner"))


def _checkpoint(spark: SparkSession, name: str, location: str | None, sink: str) -> str:
    """Checkpoint folder of one stream: given, or ``<spark.checkpoint.dir>/streams/<name>-<hash(sink)>``.

    Tied to the sink, so restarting the same stream resumes where it stopped
    (exactly-once with the file sink) while streams writing elsewhere never
    share offsets.
    """
    if location:
        return location
    digest = hashlib.md5(sink.encode("utf8")).hexdigest()[:16]
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{digest}"


def stream_prepare(spark: SparkSession, source: str, codes: DataFrame, out_path: str,
                   checkpoint: str | None = None, available_now: bool = True, test_size: float = 0.1):
    """Start the preparation stream (append to ``out_path`` partitioned by split); returns the query."""
    rows = prepare_stream(read_document_stream(spark, source), codes, test_size)
    writer = (rows.writeStream.format("parquet").option("path", out_path)
              .option("checkpointLocation", _checkpoint(spark, "prepare", checkpoint, out_path))
              .partitionBy("split").outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def word_class_counts_stream(docs: DataFrame, classes: list[str]) -> DataFrame:
    """X5 as a streaming aggregation: ``word, <class>..., total`` (update mode)."""
    words = (docs.select("label", F.explode_outer(word_tokens("text")).alias("word"))
             .filter(F.col("word").isNotNull()))
    per_class = [F.count(F.when(F.col("label") == F.lit(c), 1)).alias(c) for c in classes]
    return words.groupBy("word").agg(*per_class, F.count(F.lit(1)).alias("total"))


def stream_word_class_counts(spark: SparkSession, source: str, classes: list[str], out_path: str,
                             checkpoint: str | None = None, available_now: bool = True):
    """Maintain the word x class table as a keyed, versioned table at ``out_path``.

    Each micro-batch's updated rows are merged by ``word`` into the next
    snapshot (``lexis.sinks.upsert_versioned``; read it with
    ``lexis.sources.read_versioned``), on the executors; nothing is held on the
    driver.  The rows are absolute counts, so a batch that is run again after a
    failure gives the same table.
    """
    from lexis.sinks.writers import upsert_versioned

    agg = word_class_counts_stream(read_document_stream(spark, source), classes)

    def merge(batch: DataFrame, _: int) -> None:
        upsert_versioned(batch, out_path, key="word")

    writer = agg.writeStream.foreachBatch(merge).outputMode("update").option(
        "checkpointLocation", _checkpoint(spark, "word-counts", checkpoint, out_path))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
