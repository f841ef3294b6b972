"""Registered round trips through sources and sinks, each with a SQL twin.

Every query derives a table from ``documents``, writes it with the library's
sinks into a fresh folder under the shared checkpoint folder, and reads it back
with the library's sources, so a green row covers the code that users run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexis.operators import evaluate as V
from lexis.operators import prep as P
from lexis.plans import fixtures as fx
from lexis.plans.catalog import (EVAL_CTES, REPORT_SQL, SPLIT_SEED, _conf, _names, _params, _rerun_sql,
                                 _results, _run_preds, PARAMS_EXPR_SQL, RUN_PREDS_SQL, r6, register)
from lexis.operators.analysis import class_filter
from lexis.plans.fixtures import CORPUS_SQL, PREDICTIONS_SQL, WORD_VECTORS_SQL, sql
from lexis.session import ensure_checkpoint_dir, written
from lexis.sinks import writers as K
from lexis.sources import stored as S
from lexis.sources.corpus import read_corpus_csv
from lexis.sources.vectors import embedding_registry, read_text_vectors, read_vector_table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/round-trips/{name}-{uuid.uuid4().hex}"


UPSERT_SQL = """
SELECT {cols} FROM {old} WHERE model_name NOT IN (SELECT model_name FROM {new}) UNION ALL SELECT {cols} FROM {new}"""


@register("results_upsert", sql(*EVAL_CTES, _rerun_sql(), body=UPSERT_SQL.format(cols="model_name, accuracy, f1", old="results", new="results2")))
def q_results_upsert(spark, sf):
    """K6 + S9: two keyed upserts through the versioned sink, read back."""
    path = _folder(spark, "results")
    K.upsert_versioned(_results(spark, sf), path)
    K.upsert_versioned(_results(spark, sf, fx.RERUNS), path)
    return S.read_results(spark, path)


@register("params_upsert", sql(*EVAL_CTES, _rerun_sql(), body=f"""
SELECT model_name, {PARAMS_EXPR_SQL} AS params FROM results
WHERE model_name NOT IN (SELECT model_name FROM results2)
UNION ALL SELECT model_name, {PARAMS_EXPR_SQL} AS params FROM results2"""))
def q_params_upsert(spark, sf):
    """K7: the parameter table through the same sink."""
    path = _folder(spark, "params")
    K.upsert_versioned(_params(_results(spark, sf)), path)
    K.upsert_versioned(_params(_results(spark, sf, fx.RERUNS)), path)
    return S.read_versioned(spark, path)


@register("results_reset", sql(*EVAL_CTES, _rerun_sql(), body="SELECT model_name, accuracy, f1 FROM results2"))
def q_results_reset(spark, sf):
    """K3: results stored, the tables emptied, the re-runs stored: only these are left."""
    base = _folder(spark, "reset")
    K.upsert_versioned(_results(spark, sf), f"{base}/results")
    K.create_results_tables(spark, base, True, True)
    K.upsert_versioned(_results(spark, sf, fx.RERUNS), f"{base}/results")
    return S.read_results(spark, f"{base}/results")


@register("corpus_csv_round_trip", sql(CORPUS_SQL, body="""
SELECT md5(text) AS text_md5, label, count(*) AS n FROM corpus WHERE text <> '' GROUP BY ALL"""))
def q_corpus_csv(spark, sf):
    """The corpus as quoted multi-line CSV with an extra column and another column order."""
    path = _folder(spark, "csv")
    (fx.corpus(spark, sf).select(F.lit("x").alias("extra"), F.col("text").alias("narrative"), F.col("label").alias("product"))
     .write.option("header", True).option("escape", '"').option("quoteAll", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    back = read_corpus_csv(spark, path, {"label": "product", "text": "narrative"}).na.drop()
    return back.groupBy(F.md5(F.col("text").cast("binary")).alias("text_md5"), "label").agg(F.count(F.lit(1)).alias("n"))


def _components_text(vectors: DataFrame) -> DataFrame:
    return vectors.select("word", F.array_join(F.transform("vec", lambda x: x.cast("int").cast("string")), ",").alias("vec"))


VECTORS_QUERY = sql(CORPUS_SQL, WORD_VECTORS_SQL, body="SELECT word, array_to_string(list_transform(vec, lambda v: v::INTEGER), ',') AS vec FROM vectors")


@register("text_vectors_round_trip", VECTORS_QUERY)
def q_text_vectors(spark, sf):
    """S2 + S3 + S6: word vectors as text with an earlier duplicate of every word."""
    base = _folder(spark, "text-vectors")
    vecs = fx.word_vectors(spark, sf, fx.WORD_VEC_DIM)
    line = F.concat_ws(" ", "word", F.array_join(F.transform("vec", lambda x: x.cast("string")), " "))
    # the duplicates are in files that come earlier
    vecs.select(F.concat_ws(" ", "word", F.array_join(F.array_repeat(F.lit("99"), fx.WORD_VEC_DIM), " "))).write.text(f"{base}/part=0")
    vecs.select(line).write.text(f"{base}/part=1")
    loader = embedding_registry({"fasttext": f"{base}/part=*"})["fasttext"]
    return _components_text(loader(spark))


@register("vector_table_round_trip", VECTORS_QUERY)
def q_vector_table(spark, sf):
    """Word vectors as a Parquet table."""
    path = _folder(spark, "vectors")
    fx.word_vectors(spark, sf, fx.WORD_VEC_DIM).write.parquet(path)
    return _components_text(read_vector_table(spark, path))


@register("split_round_trip", sql(CORPUS_SQL, body="""
SELECT doc_id, label FROM corpus
QUALIFY row_number() OVER (ORDER BY md5('42s-' || doc_id)) <= (SELECT ceil(0.1::DOUBLE * count(*)) FROM corpus)"""))
def q_split(spark, sf):
    """K1 + S7: the split written partitioned, a second write without the overwrite flag, the test part read."""
    path = _folder(spark, "split")
    split = P.train_test_split(fx.corpus(spark, sf).select("doc_id", "label"), P.TEST_SIZE, seed=SPLIT_SEED)
    K.write_split(split, path, True)
    K.write_split(split.limit(1), path, False)
    return S.read_split(spark, path, "test").select("doc_id", "label")


@register("report_files_round_trip", sql(*EVAL_CTES, REPORT_SQL, body="""
SELECT model_name, class, round(precision, 6) AS precision, round(recall, 6) AS recall FROM report WHERE class IN (SELECT label FROM codes)"""))
def q_report_files(spark, sf):
    """K4 + S10: every run's report file written and read in one scan."""
    base = _folder(spark, "reports")
    conf = written(_conf(spark, sf), "confusion")
    for run, _ in fx.RUNS:
        K.write_report(V.classification_report(conf.filter(F.col("model_name") == run).drop("model_name"), _names(spark, sf)), base, run)
    return S.read_reports(spark, base).filter(F.col("class").isin(fx.class_names(spark, sf))).select(
        "model_name", "class", r6("precision").alias("precision"), r6("recall").alias("recall"))


@register("matrix_files_round_trip", sql(*EVAL_CTES, body="SELECT model_name, y_true, y_pred, n FROM conf"))
def q_matrix_files(spark, sf):
    """K5 + S11: every run's dense matrix file written and read as long rows."""
    base = _folder(spark, "matrices")
    k = len(fx.class_names(spark, sf))
    conf = written(_conf(spark, sf), "confusion")
    for run, _ in fx.RUNS:
        K.write_conf_matrix(conf.filter(F.col("model_name") == run).drop("model_name"), base, run, k)
    return S.read_conf_matrices(spark, base, k)


@register("class_membership_filter", sql(CORPUS_SQL, PREDICTIONS_SQL, RUN_PREDS_SQL, body="""
SELECT doc_id, y_true, y_pred, code_list FROM (SELECT *, 'some' AS code_list FROM pr WHERE y_true IN (0, 2)
UNION ALL SELECT *, 'all' AS code_list FROM pr)"""))
def q_class_filter(spark, sf):
    """Predictions of the listed classes; an empty list keeps all."""
    preds = _run_preds(spark, sf).select("doc_id", "y_true", "y_pred")
    return class_filter(preds, [0, 2]).withColumn("code_list", F.lit("some")).unionByName(class_filter(preds, []).withColumn("code_list", F.lit("all")))
