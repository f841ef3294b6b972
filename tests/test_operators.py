"""Operators on the small hand-made cases of FIXTURES.md section 4."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from lexis.operators import analysis as X
from lexis.operators import eda as A
from lexis.operators import evaluate as V
from lexis.operators import prep as P
from lexis.operators import sequences as S
from lexis.operators import vectors as E
from lexis.operators.augment import synonym_augment
from lexis.operators.sampling import exact_sample, kth_smallest_key, lowest_k
from lexis.functions.arrays import seeded_key
from lexis.sources.vectors import read_text_vectors


def _tok(spark, docs):
    return spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, tokens array<string>")


def test_mean_vectors_count_repetition_and_skip_unknown(spark):
    vecs = spark.createDataFrame([("a", [1.0, 3.0]), ("b", [3.0, 5.0])], "word string, vec array<float>")
    docs = _tok(spark, [["a", "a", "b", "zzz"], ["zzz"], []])
    out = {r["doc_id"]: r for r in E.doc_vectors_mean(docs, vecs, 2).collect()}
    assert list(out[0]["vec"]) == pytest.approx([5 / 3, 11 / 3])
    assert out[0]["n_known"] == 3
    assert out[1]["vec"] is None and out[2]["vec"] is None
    zeros = {r["doc_id"]: r for r in E.doc_vectors_mean(docs, vecs, 2, empty="zeros").collect()}
    assert list(zeros[1]["vec"]) == [0.0, 0.0]


def test_embedding_matrix_zero_rows(spark):
    vocab = spark.createDataFrame([(1, "a", 2), (2, "q", 1)], "idx int, word string, n long")
    vecs = spark.createDataFrame([("a", [1.0, 3.0])], "word string, vec array<float>")
    m = {r["idx"]: list(r["vec"]) for r in E.embedding_matrix(vocab, vecs, 4, 2).collect()}
    assert m == {0: [0.0, 0.0], 1: [1.0, 3.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}


def test_text_vectors_last_duplicate_and_header(spark):
    d = tempfile.mkdtemp(prefix="lexis-vec-", dir="/tmp")
    p = os.path.join(d, "v.vec")
    with open(p, "w", encoding="utf8") as f:
        f.write("2 3\nthe .1 .2 .3\nof 1 2 3\nthe 9 9 9\n")
    got = {r["word"]: list(r["vec"]) for r in read_text_vectors(spark, p, dim=3).collect()}
    assert got == {"the": [9.0, 9.0, 9.0], "of": [1.0, 2.0, 3.0]}


def test_vocabulary_ties_by_first_appearance(spark):
    docs = _tok(spark, [["b", "a", "b"], ["c", "a"]])
    vocab = S.fit_vocabulary(docs, max_words=3)
    assert [(r["idx"], r["word"]) for r in vocab.orderBy("idx").collect()] == [(1, "b"), (2, "a")]


def test_sequences_pad_front(spark):
    vocab = S.fit_vocabulary(_tok(spark, [["b", "a", "b"], ["c", "a"]]), max_words=3)
    docs = _tok(spark, [["b", "a", "b"], ["c"], ["a", "b", "a", "b", "a"]])
    out = {r["doc_id"]: list(r["ids"]) for r in S.padded_sequences(docs, vocab, 4).collect()}
    assert out == {0: [0, 1, 2, 1], 1: [0, 0, 0, 0], 2: [1, 2, 1, 2]}


def test_sample_and_split_sizes(spark):
    df = spark.range(11).select(F.col("id").alias("doc_id"), F.lit("x").alias("label"))
    assert exact_sample(df, 0.5).count() == 6       # 5.5 rounds half to even
    split = P.train_test_split(df, 0.1)
    assert split.filter("split = 'test'").count() == 2   # ceiling
    assert split.count() == 11


def test_lowest_k_equals_full_sort(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id")).withColumn("k", seeded_key("7", "doc_id"))
    want = [r["doc_id"] for r in df.orderBy("k").limit(321).collect()]
    got = [r["doc_id"] for r in lowest_k(df, "k", 321).orderBy("k").collect()]
    assert got == want
    assert kth_smallest_key(df, "k", 0) is None
    assert lowest_k(df, "k", 10_000).count() == 5000


def test_label_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "label string")
    assert {r["label"]: r["code"] for r in P.label_codes(df).collect()} == {"a": 0, "b": 1, "c": 2}


def test_undersample_ceiling_and_others_untouched(spark):
    rows = [(i, "t") for i in range(9)] + [(100 + i, "o") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, label string")
    u = P.undersample(df, "t", 4)
    counts = {r["label"]: r["count"] for r in u.groupBy("label").count().collect()}
    assert counts == {"t": 3, "o": 5}


def test_histogram_last_edge_inclusive(spark):
    df = spark.createDataFrame([(0,), (5,), (10,)], "n_words int")
    h = {r["bin"]: r["n"] for r in A.length_histogram(df, bins=2).collect()}
    assert h == {0: 1, 1: 2}


def test_cumulative_share_variants(spark):
    df = spark.createDataFrame([(1,), (1,), (5,), (9,)], "n_words int")
    r = A.length_cumulative_share(df, ks=(2,)).collect()[0]
    assert r["share_first_k_lengths"] == 0.75 and r["share_len_le_k"] == 0.5


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "model_name string, accuracy double")
    new = spark.createDataFrame([("b", 9.0)], "model_name string, accuracy double")
    got = {r["model_name"]: r["accuracy"] for r in V.upsert_by_key(old, new).collect()}
    assert got == {"a": 1.0, "b": 9.0}


def test_compare_classes_unequal_lengths(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, "y", 3)], "rank int, word string, n long")
    b = spark.createDataFrame([(1, "z", 7)], "rank int, word string, n long")
    rows = sorted(X.compare_classes(a, b).collect(), key=lambda r: r["rank"])
    assert rows[1]["correct_word"] is None and rows[1]["incorrect_word"] == "y"


def test_attribution_threshold_and_polarity(spark):
    attr = spark.createDataFrame(
        [(1, 0, "a", 1.2, 0, 0), (1, 1, "b", -1.0, 0, 0), (1, 2, "c", 0.9, 0, 0), (1, 3, "d", 0.0, 0, 0)],
        "doc_id long, pos int, word string, weight double, y_true int, y_pred int")
    w = X.attribution_weights(attr, data_prop=1.0, threshold=1.0)
    got = {(r["polarity"], r["weight"]) for r in w.collect()}
    assert got == {("pos", 1.2), ("neg", -1.0)}
    assert X.attribution_weights(attr, data_prop=1.0, correct=False).count() == 0
    top = X.attribution_top_words(w, 1).collect()
    assert {(r["polarity"], r["word"]) for r in top} == {("pos", "a"), ("neg", "b")}


def test_word_class_counts_tf_df(spark):
    toks = spark.createDataFrame([(0, "x", ["a", "a", "b"]), (1, "y", ["a"])],
                                 "doc_id long, label string, tokens array<string>")
    tf = {r["word"]: (r["x"], r["y"], r["total"]) for r in X.word_class_counts(toks, "label", ["x", "y"]).collect()}
    assert tf == {"a": (2, 1, 3), "b": (1, 0, 1)}
    df = {r["word"]: r["total"] for r in X.word_class_counts(toks, "label", ["x", "y"], unique_only=True).collect()}
    assert df == {"a": 2, "b": 1}
    sel = {r["word"]: (r["x"], r["y"]) for r in
           X.word_distribution_for_classes(toks, "label", ["x", "y"], ["y"]).collect()}
    assert sel == {"a": (0, 1), "b": (0, 0)}


def test_synonym_augment_appends_copies(spark):
    toks = spark.createDataFrame([(i, "x", ["The", "cat"]) for i in range(40)],
                                 "doc_id long, label string, tokens array<string>")
    syn = spark.createDataFrame([("The", "the")], "word string, synonym string")
    out = synonym_augment(toks, syn, aug_p=1.0, return_p=0.5)
    copies = out.filter("augmented = 1").collect()
    assert 0 < len(copies) < 40 and all(list(r["tokens"]) == ["the", "cat"] for r in copies)
    assert out.filter("augmented = 0").count() == 40


def test_misclassified_sample_one_per_pair(spark):
    preds = spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(20)], "doc_id long, y_true int, y_pred int")
    toks = spark.createDataFrame([(i, ["w%d" % i]) for i in range(20)], "doc_id long, tokens array<string>")
    out = X.misclassified_sample(preds, toks)
    assert out.count() == 4 and out.select("y_pred", "y_true").distinct().count() == 4


def test_random_fourier_features_approximate_rbf(spark):
    import numpy as np

    from lexis.operators.train import random_fourier_features
    rng = np.random.default_rng(0)
    pts = rng.normal(size=(6, 4)) * 0.5
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(pts)], "id long, v array<double>")
    z = {r["id"]: np.array(r["rff"]) for r in random_fourier_features(df, "v", n_components=4000, gamma=0.5).collect()}
    for i in range(6):
        for j in range(6):
            exact = np.exp(-0.5 * np.sum((pts[i] - pts[j]) ** 2))
            assert abs(float(z[i] @ z[j]) - exact) < 0.06


def test_small_helpers(spark):
    from lexis.operators.joins import bounded_broadcast
    from lexis.operators.partitioning import spread
    from lexis.operators.sampling import approx_sample
    from lexis.operators.train import with_validation_flag
    from lexis.session import recommended_conf

    preds = spark.createDataFrame([(i, i % 3, (i + (i % 2)) % 3) for i in range(30)],
                                  "doc_id long, y_true int, y_pred int")
    assert X.pair_filter(preds, 1, 0).count() == preds.filter("y_pred = 1 and y_true = 0").count()
    assert X.class_filter(preds, []).count() == 30 and X.class_filter(preds, [0]).count() == 10
    counts = {r["label"]: (r["n"], r["is_total"]) for r in
              P.class_counts(spark.createDataFrame([("a",), ("a",), ("b",)], "label string")).collect()}
    assert counts == {"a": (2, False), "b": (1, False), None: (3, True)}
    n = approx_sample(spark.range(20000).select(F.col("id").alias("doc_id")), 0.1).count()
    assert 1700 < n < 2300
    v = with_validation_flag(spark.range(20000).select(F.col("id").alias("doc_id")), "doc_id", 0.1)
    assert 1700 < v.filter("is_val").count() < 2300
    small = spark.range(5)
    assert "Broadcast" in bounded_broadcast(small, 10).join(spark.range(100), "id")._jdf.queryExecution() \
        .executedPlan().toString()
    one = spark.range(1000).coalesce(1)
    assert spread(one, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    large = spark.range(10**12)  # planned at 8 TB: never shuffled just to be spread
    assert spread(large, "id") is large
    conf = recommended_conf(100 << 40, 8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == (25 << 40) // (512 << 20)
    toks = spark.createDataFrame([(0, ["b", "a"])], "doc_id long, tokens array<string>")
    assert sorted((r["word"], r["x"]) for r in X.empty_word_table(toks, ["x"]).collect()) == [("a", 0), ("b", 0)]


def test_results_parts_and_lookup(spark):
    res = spark.createDataFrame([("bert-base-uncased", 0.8, 0.7), ("plain", 0.5, 0.4)],
                                "model_name string, accuracy double, f1 double")
    parts = {r["model_name"]: (r["model"], r["embedding"], r["accuracy"]) for r in V.results_with_parts(res).collect()}
    assert parts == {"bert-base-uncased": ("bert", "base-uncased", 80.0), "plain": ("plain", None, 50.0)}
    assert V.model_accuracy(res, "plain").collect()[0]["accuracy"] == 0.5


def test_salted_vector_join_equals_broadcast(spark):
    docs = _tok(spark, [["the", "the", "a", "zzz"]] * 30 + [["b", "the"], []])
    vecs = spark.createDataFrame([("the", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [5.0, 7.0])],
                                 "word string, vec array<float>")
    small = {r["doc_id"]: (r["n_known"], r["vec"]) for r in E.doc_vectors_mean(docs, vecs, 2).collect()}
    salted = E.doc_vectors_mean(docs, vecs, 2, broadcast_bytes=0, salts=4, hot_sample_frac=1.0)
    assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"]: (r["n_known"], r["vec"]) for r in salted.collect()} == small


def test_lowest_k_at_two_million_rows(spark):
    """Histogram threshold selects exactly the rows of a full sort, with many occupied buckets."""
    df = spark.range(2_000_000).select(F.col("id").alias("doc_id")).withColumn("k", seeded_key("s", "doc_id"))
    k = 150_000
    got = lowest_k(df, "k", k)
    want = df.orderBy("k").limit(k)
    assert got.count() == k
    assert got.select("doc_id").exceptAll(want.select("doc_id")).count() == 0


def test_rff_pipeline_stage_grid_and_persistence(spark):
    import tempfile

    from pyspark.ml import PipelineModel

    from lexis.operators.train import grid_search, svm_rbf_grid, with_features, with_folds
    rows = [(i, float(i % 2), [float((i * 7) % 5) - 2.0 + (i % 2) * 3.0, float((i * 3) % 7) - 3.0])
            for i in range(120)]
    df = with_folds(with_features(spark.createDataFrame(rows, "id long, label double, v array<double>"), "v"), "id")
    pipe, grid = svm_rbf_grid(gammas=(0.5, 2.0), reg_params=(0.01,), n_components=64, max_iter=10)
    cv = grid_search(pipe, grid, df, parallelism=2)
    assert len(cv.avgMetrics) == 2 and max(cv.avgMetrics) > 0.7
    path = tempfile.mkdtemp(prefix="lexis-rff-model-", dir="/tmp") + "/m"
    cv.bestModel.write().overwrite().save(path)
    again = PipelineModel.load(path)
    a = [r["prediction"] for r in cv.bestModel.transform(df).orderBy("id").collect()]
    b = [r["prediction"] for r in again.transform(df).orderBy("id").collect()]
    assert a == b


def test_sampling_operators_on_empty_and_absent_inputs(spark):
    empty = spark.createDataFrame([], "doc_id long, label string")
    assert exact_sample(empty, 0.5).count() == 0
    assert P.train_test_split(empty, 0.1).count() == 0
    df = spark.createDataFrame([(i, "o") for i in range(7)], "doc_id long, label string")
    assert P.undersample(df, "absent", 4).count() == 7          # no target rows: unchanged
    assert exact_sample(df, 0.0).count() == 0
    assert exact_sample(df, 1.0).count() == 7
    assert P.train_test_split(df, 1.0).filter("split = 'test'").count() == 7
