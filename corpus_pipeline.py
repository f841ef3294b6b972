"""Corpus pipeline: language ID, line dedup, near-duplicate documents, decontamination, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its
predecessor kept; its result is written as Parquet and reread as the next
stage's ``docs``.  All but the last return the columns of ``docs`` unchanged in
name and order (``text`` and ``n_chars`` change where lines go).

Rows are matched by ``doc_id``.  Where ids are null or repeat, a stage works on
written keys of its own, one per row in the order of the ids (null last), and
the rows get their ids back: every row is judged and keeps its own text.  Null
and empty texts have no letter, so language ID rejects them.  Empty tables give
empty results.  Extra columns of any name are carried along.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexis.llm import bpe, decontam, langid, lines, ngram_join
from lexis.llm.common import read, written
from lexis.llm.queries import rank_file

# Generated names, so that no column of a table can clash with them.
GIVEN_ID, LEFT_TEXT = f"given_id_{uuid.uuid4().hex}", f"left_text_{uuid.uuid4().hex}"


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select(*docs.columns)


def _every_row(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` over rows with unique keys in ``doc_id``; the given ids wait in a column of generated name."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").limit(1).count():
            return stage(spark, docs, sf_dir)
        # the text's hash in the order spreads the rows of one repeated id over the range partitions
        ordered = docs.withColumn(GIVEN_ID, F.col("doc_id")).orderBy(F.col("doc_id").cast("long").asc_nulls_last(), F.xxhash64("text"))
        keyed = written(ordered.withColumn("doc_id", F.monotonically_increasing_id()), "row-keys")
        return stage(spark, keyed, sf_dir).withColumn("doc_id", F.col(GIVEN_ID)).select(*docs.columns)

    return run


@_every_row
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those without letters or with a narrow margin go."""
    learned = langid.learn(docs.filter(~langid.held_out(GIVEN_ID if GIVEN_ID in docs.columns else "doc_id")))
    judged = langid.identify(docs, learned)
    return _only(docs, judged.filter("NOT rejected"))


@_every_row
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; documents whose every judged line is a repeat go whole."""
    left = lines.deduplicated(docs).filter("NOT only_copies").select("doc_id", F.col("text").alias(LEFT_TEXT))
    cut = docs.join(left, "doc_id")
    new = {"text": F.col(LEFT_TEXT).alias("text"), "n_chars": F.length(LEFT_TEXT).cast("long").alias("n_chars")}
    return cut.select(*[new.get(c, F.col(c)) for c in docs.columns])


@_every_row
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest key, stays of each group of linked documents (five-word shingles, 0.8)."""
    groups = ngram_join.join_groups(docs, n=5, threshold=80)
    return _only(docs, groups.filter("doc_id = component_id"))


@_every_row
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    found = decontam.contamination(docs, read(spark, sf_dir, "benchmark"))
    return _only(docs, found.filter(F.size("hit_spans") == 0))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining document, checked to decode to the text's bytes."""
    return bpe.round_trip_digests(docs, rank_file())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("token_ids", token_ids),
]

#: Compression sizes cannot be expressed in SQL; tests check every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
