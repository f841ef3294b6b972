"""The whole run as registered queries: prepare, fit, predict, evaluate, store, and read everything back.

The model is the nearest-centroid one, whose coefficients SQL can work out too,
so every stored number has a twin.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexis.operators import train as T
from lexis.plans import fixtures as fx
from lexis.plans import jobs
from lexis.plans.catalog import CONF_SQL, DIMS, DOCVEC_FULL_SQL, DOCVEC_SQL, METRICS_SQL, r6, register
from lexis.plans.fixtures import CORPUS_SQL, WORD_VEC_DIM, WORD_VECTORS_SQL, sql
from lexis.session import ensure_checkpoint_dir
from lexis.sources import stored as S

RUN_SQL = """
sp AS (SELECT doc_id, label, row_number() OVER (ORDER BY md5('42s-' || doc_id)) <= (SELECT ceil(0.1::DOUBLE * count(*)) FROM corpus) AS test FROM corpus),
dz AS (SELECT doc_id, n_known, {filled} FROM docvec),
cen AS (SELECT c.code, {means} FROM dz JOIN coded c USING (doc_id) JOIN sp USING (doc_id) WHERE NOT test GROUP BY c.code),
cs AS (SELECT dz.doc_id, cen.code, {dot} - ({norm}) / 2 AS score FROM dz, cen),
best AS (SELECT doc_id, code AS y_pred FROM cs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code) = 1),
preds AS (SELECT 'centroid-glove' AS model_name, doc_id, c.code AS y_true, y_pred FROM best JOIN coded c USING (doc_id) JOIN sp USING (doc_id) WHERE test)""".format(
    filled=", ".join(f"coalesce(v{d}, 0) AS v{d}" for d in DIMS), means=", ".join(f"avg(v{d}) AS m{d}" for d in DIMS),
    dot=" + ".join(f"dz.v{d} * cen.m{d}" for d in DIMS), norm=" + ".join(f"cen.m{d} * cen.m{d}" for d in DIMS))
RUN_CTES = (CORPUS_SQL, WORD_VECTORS_SQL, DOCVEC_SQL, DOCVEC_FULL_SQL, RUN_SQL)


def _run(spark, sf) -> tuple[str, dict[str, str], str]:
    """Entries 1 and 2 over the whole corpus; the folder, its paths and the stored run's name."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/runs/{uuid.uuid4().hex}"
    vectors = fx.word_vectors(spark, sf, WORD_VEC_DIM)
    paths = jobs.prepare(spark, fx.corpus(spark, sf), base, {"glove": lambda s: vectors}, frac=1.0, seed="42", overwrite_results=True, overwrite_params=True)
    return base, paths, jobs.run_all(spark, base, paths, "centroid", T.centroid_grid, ["glove"])[0]


@register("end_to_end_report", sql(*RUN_CTES, CONF_SQL, METRICS_SQL, body="""
SELECT c.label AS class, round(pm.precision, 6) AS precision, round(pm.recall, 6) AS recall, round(pm.f1_score, 6) AS f1_score, pm.support::DOUBLE AS support,
       r.accuracy, r.f1 AS macro_f1, (SELECT count(*) FROM preds) AS n_predicted, (SELECT count(*) FROM preds) AS n_predicted_again
FROM pm JOIN codes c ON c.code = pm.cls JOIN results r USING (model_name)"""))
def q_end_to_end_report(spark, sf) -> DataFrame:
    """The stored report and results of a run, and the loaded model's agreement with its stored predictions."""
    base, paths, name = _run(spark, sf)
    report = S.read_reports(spark, base).filter(F.col("class").isin([r["label"] for r in S.read_label_map(spark, paths["label_map"]).collect()])).drop("accuracy")
    results = S.read_results(spark, f"{base}/results").filter(F.col("model_name") == name)
    stored = spark.read.parquet(f"{base}/predictions/{name}")
    again = S.load_model(f"{base}/models/{name}").transform(S.read_doc_vectors(spark, paths["vectors"], "glove", "test"))
    agree = stored.join(again.select("doc_id", "prediction"), "doc_id").agg(F.count(F.lit(1)).alias("n_predicted"), F.count_if(F.col("prediction") == F.col("y_pred")).alias("n_predicted_again"))
    line = results.select("accuracy", F.col("f1").alias("macro_f1")).join(agree)  # one row each
    return report.join(F.broadcast(line)).select("class", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1-score").alias("f1_score"), "support",
                                                 "accuracy", "macro_f1", "n_predicted", "n_predicted_again")


@register("end_to_end_doc_vectors", sql(*RUN_CTES, body="""
SELECT doc_id, CASE WHEN test THEN 'test' ELSE 'train' END AS split, n_known, {cols} FROM dz JOIN sp USING (doc_id)""".format(
    cols=", ".join(f"round(v{d}, 6) AS v{d}" for d in DIMS))))
def q_end_to_end_doc_vectors(spark, sf) -> DataFrame:
    """S8 + K2: the document vectors that a run stores, read back by split."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/runs/{uuid.uuid4().hex}"
    vectors = fx.word_vectors(spark, sf, WORD_VEC_DIM)
    paths = jobs.prepare(spark, fx.corpus(spark, sf), base, {"glove": lambda s: vectors}, frac=1.0, seed="42")
    both = [S.read_doc_vectors(spark, paths["vectors"], "glove", x).select("doc_id", F.lit(x).alias("split"), "n_known", "vec") for x in ("train", "test")]
    return both[0].unionByName(both[1]).select("doc_id", "split", "n_known", *[r6(F.col("vec")[d]).alias(f"v{d}") for d in DIMS])
