"""End-to-end: prepare -> train/evaluate/store -> post-analysis, plus sink/source round trips."""

import tempfile

import pytest
from pyspark.sql import functions as F

from lexis.operators import evaluate as V
from lexis.plans import jobs
from lexis.plans.fixtures import WORD_VEC_DIM, tokens, word_vectors
from lexis.sinks import writers as K
from lexis.sources import stored as S
from lexis.sources.corpus import load_corpus, read_corpus_csv

SF_TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base():
    return tempfile.mkdtemp(prefix="lexis-job-", dir="/tmp")


def _logistic():
    from pyspark.ml.tuning import ParamGridBuilder

    from lexis.operators.train import logistic_estimator
    lr = logistic_estimator(max_iter=10)
    return lr, ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.1]).build()


def test_prepare_run_all_analyse_results(spark, base):
    corpus = load_corpus(spark, SF_TINY)
    vecs = word_vectors(spark, SF_TINY, WORD_VEC_DIM)
    paths = jobs.prepare(spark, corpus, base, {"glove": lambda s: vecs, "word2vec": lambda s: vecs},
                         frac=1.0, target="en", factor=4, overwrite_results=True, overwrite_params=True)
    split = S.read_split(spark, paths["split"])
    n = split.count()
    assert split.filter("split = 'test'").count() == -(-n // 10)
    assert split.select("doc_id").distinct().count() == n
    dv = S.read_doc_vectors(spark, paths["vectors"], "glove")
    assert dv.count() == n

    names = jobs.run_all(spark, base, paths, "svm", _logistic, ["glove", "word2vec"])
    assert names == ["svm-glove", "svm-word2vec"]
    results = S.read_results(spark, f"{base}/results")
    assert {r["model_name"] for r in results.collect()} == set(names)
    params = S.read_versioned(spark, f"{base}/best_params").collect()
    assert all("regParam" in r["params"] for r in params)

    model = S.load_model(f"{base}/models/svm-glove")
    test = jobs._labelled_vectors(spark, paths, "glove", "test")
    assert model.transform(test).count() == test.count()

    # re-running one embedding replaces its row (keyed upsert), the other stays
    jobs.run_all(spark, base, paths, "svm", _logistic, ["glove"])
    assert S.read_results(spark, f"{base}/results").count() == 2

    classes = [r["label"] for r in S.read_label_map(spark, paths["label_map"]).orderBy("code").collect()]
    out = jobs.analyse_results(spark, base, "svm", classes, ["word2vec", "glove", "fasttext", "custom"])
    assert out["by_model"].count() == 1
    assert out["class_metric_pivot"].count() == len(classes)
    roll = out["confusion_rollup"].agg(F.sum("n")).collect()[0][0]
    assert roll == 2 * split.filter("split = 'test'").count()  # every test document is scored
    errors = jobs.analyse_results(spark, base, "svm", classes, ["glove"], run="svm-glove", pair=(classes[0], classes[1]))
    assert {"misclassified_sample", "common_words", "word_distribution", "document_distribution", "pair_predictions",
            "compare_classes", "class_metric_pivot_precision", "class_metric_pivot_recall"} <= set(errors)
    assert errors["misclassified_sample"].count() >= 1


def test_prepare_thresholds_from_the_key_table_and_stored_split(spark):
    base = tempfile.mkdtemp(prefix="lexis-scan-", dir="/tmp")
    source = f"{base}/corpus"
    load_corpus(spark, SF_TINY).withColumn("extra", F.lit(1)).write.parquet(source)
    corpus = spark.read.parquet(source)
    paths = jobs.prepare(spark, corpus, base, {}, frac=0.5, target="en", seed="7")
    split = S.read_split(spark, paths["split"])
    # the same rows as sampling, undersampling and splitting the corpus itself
    from lexis.operators import prep as P
    from lexis.operators.sampling import exact_sample
    sample = exact_sample(corpus.select("doc_id", "text", "label"), 0.5, seed="7")
    want = P.train_test_split(P.undersample(sample, "en", 4, seed="7u"), 0.1, seed="7s")
    assert {(r[0], r[1]) for r in split.select("doc_id", "split").collect()} == {(r[0], r[1]) for r in want.select("doc_id", "split").collect()}
    before = sorted(r["doc_id"] for r in split.collect())
    jobs.prepare(spark, spark.createDataFrame([], corpus.schema), base, {}, overwrite_split=False)
    assert sorted(r["doc_id"] for r in S.read_split(spark, paths["split"]).collect()) == before
    first = jobs.prepare(spark, corpus, f"{base}/b", {}, frac=1.0, target="en", split_first=True)
    n = S.read_split(spark, first["split"]).filter("split = 'test'").count()
    assert n == -(-corpus.count() // 10)


def test_prepare_trains_and_saves_custom_vectors(spark, monkeypatch):
    fit = jobs.train_word_vectors
    monkeypatch.setattr(jobs, "train_word_vectors", lambda df: fit(df, vector_size=80, epochs=1, blocks=2))
    base = tempfile.mkdtemp(prefix="lexis-custom-", dir="/tmp")
    paths = jobs.prepare(spark, load_corpus(spark, SF_TINY), base, {}, frac=1.0, custom_vectors=True)
    vecs = S.read_doc_vectors(spark, paths["vectors"], "custom")
    assert vecs.count() == S.read_split(spark, paths["split"]).count()
    assert vecs.filter("size(vec) <> 80").count() == 0  # beyond the generated-code width


def test_report_and_matrix_files_round_trip(spark, base):
    preds = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 2), (2, 0)], "y_true int, y_pred int")
    conf = V.confusion_long(preds)
    names = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "code int, label string")
    rep = V.classification_report(conf, names)
    d = tempfile.mkdtemp(prefix="lexis-files-", dir="/tmp")
    K.write_report(rep, d, "m-x")
    K.write_conf_matrix(conf, d, "m-x", 3)
    back = S.read_reports(spark, d).collect()
    assert [r["class"] for r in sorted(back, key=lambda r: r["row_order"])] == \
        ["a", "b", "c", None, "macro avg", "weighted avg"]
    acc_row = [r for r in back if r["class"] is None][0]
    assert acc_row["accuracy"] == pytest.approx(0.6)
    m = {(r["y_true"], r["y_pred"]): r["n"] for r in S.read_conf_matrices(spark, d, 3).collect()}
    assert m == {(r["y_true"], r["y_pred"]): r["n"] for r in conf.collect()}


def test_corpus_csv_reader_nulls_and_multiline(spark):
    d = tempfile.mkdtemp(prefix="lexis-csv-", dir="/tmp")
    p = f"{d}/c.csv"
    with open(p, "w", encoding="utf8") as f:
        f.write('product,narrative\nbank,"line one\nline two, with comma and ""quote"""\nNA,text\ncard,\n')
    df = read_corpus_csv(spark, p)
    rows = df.orderBy(F.desc(F.length("narrative"))).collect()  # keys follow content, not file order
    assert len(rows) == 3
    assert rows[0]["narrative"] == 'line one\nline two, with comma and "quote"'
    assert rows[1]["product"] is None and rows[2]["narrative"] is None
    assert df.na.drop().count() == 1


def test_tokens_fixture_reads_only_needed_columns(spark):
    plan = tokens(spark, SF_TINY)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan


def test_versioned_upsert_ignores_uncommitted_snapshot(spark):
    import os

    base = tempfile.mkdtemp(prefix="lexis-ver-", dir="/tmp")
    p = f"{base}/results"
    K.upsert_versioned(spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 2.0)], S.RESULTS_SCHEMA), p)
    K.upsert_versioned(spark.createDataFrame([("b", 9.0, 9.0)], S.RESULTS_SCHEMA), p)
    assert {r["model_name"]: r["accuracy"] for r in S.read_results(spark, p).collect()} == {"a": 1.0, "b": 9.0}
    # a snapshot whose job never committed (no _SUCCESS) is invisible and its number is not used again
    spark.createDataFrame([("zzz", 0.0, 0.0)], S.RESULTS_SCHEMA).write.parquet(f"{p}/version=2")
    os.remove(f"{p}/version=2/_SUCCESS")
    assert S.committed_versions(spark, p) == [1, 0]
    assert "zzz" not in {r["model_name"] for r in S.read_results(spark, p).collect()}
    assert K.upsert_versioned(spark.createDataFrame([("c", 3.0, 3.0)], S.RESULTS_SCHEMA), p) == 3
    assert {r["model_name"] for r in S.read_results(spark, p).collect()} == {"a", "b", "c"}
