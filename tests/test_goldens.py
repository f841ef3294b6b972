"""Published golden numbers: 15 confusion matrices -> accuracy, macro F1, per-class F1,
"""

import pytest
from pyspark.sql import functions as F

from lexis.operators import evaluate as V

CLASSES = ["credit_card", "credit_reporting", "debt_collection", "mortgages_and_loans", "retail_banking"]

# Published confusion matrices (rows = actual), accuracy and macro F1.
GOLDEN = {
    "svm-word2vec": ([[103, 4, 2, 3, 13], [5, 144, 10, 7, 1], [8, 22, 134, 13, 1], [4, 8, 8, 110, 2], [8, 3, 3, 1, 87]], 0.821, 0.8227),
    "svm-glove": ([[98, 4, 7, 5, 11], [3, 139, 16, 8, 1], [11, 22, 131, 12, 2], [2, 8, 9, 112, 1], [14, 3, 5, 1, 79]], 0.794, 0.7956),
    "svm-fasttext": ([[104, 7, 3, 1, 10], [4, 140, 14, 8, 1], [9, 28, 127, 12, 2], [3, 9, 6, 112, 2], [11, 3, 2, 3, 83]], 0.804, 0.8078),
    "svm-custom": ([[95, 11, 2, 3, 14], [3, 143, 16, 4, 1], [13, 26, 131, 7, 1], [4, 10, 5, 111, 2], [8, 3, 4, 1, 86]], 0.804, 0.8072),
    "xgb-word2vec": ([[93, 8, 6, 7, 11], [4, 139, 15, 8, 1], [11, 26, 129, 9, 3], [1, 8, 9, 113, 1], [8, 4, 4, 4, 82]], 0.7898, 0.7926),
    "xgb-glove": ([[85, 4, 12, 10, 14], [3, 140, 14, 8, 2], [11, 23, 128, 14, 2], [7, 9, 13, 98, 5], [16, 1, 8, 5, 72]], 0.7429, 0.7385),
    "xgb-fasttext": ([[92, 11, 4, 6, 12], [4, 142, 13, 7, 1], [7, 30, 129, 9, 3], [4, 9, 6, 109, 4], [9, 6, 1, 4, 82]], 0.7869, 0.7883),
    "xgb-custom": ([[97, 6, 5, 6, 11], [6, 138, 16, 6, 1], [11, 21, 136, 9, 1], [4, 10, 9, 107, 2], [14, 2, 2, 2, 82]], 0.7955, 0.7968),
    "distilbert-base-uncased": ([[100, 6, 7, 2, 10], [2, 142, 12, 8, 3], [4, 22, 142, 6, 4], [2, 6, 7, 115, 2], [7, 1, 7, 1, 86]], 0.831, 0.8331),
    "bert-base-uncased": ([[98, 7, 3, 6, 11], [2, 137, 13, 9, 6], [8, 23, 130, 12, 5], [1, 4, 4, 119, 4], [17, 1, 4, 1, 79]], 0.7997, 0.7977),
    "bilstm-word2vec": ([[104, 6, 6, 1, 8], [4, 138, 19, 5, 1], [11, 20, 138, 7, 2], [6, 7, 8, 110, 1], [18, 4, 3, 2, 75]], 0.8026, 0.8034),
    "bilstm-glove": ([[98, 4, 5, 3, 15], [8, 140, 11, 7, 1], [11, 16, 139, 8, 4], [5, 6, 8, 110, 3], [15, 1, 2, 3, 81]], 0.8068, 0.804),
    "bilstm-fasttext": ([[104, 8, 2, 3, 8], [9, 133, 13, 11, 1], [10, 23, 134, 9, 2], [13, 8, 2, 108, 1], [14, 2, 2, 2, 82]], 0.7969, 0.7996),
    "bilstm-custom": ([[89, 17, 3, 1, 15], [2, 140, 16, 7, 2], [8, 16, 147, 4, 3], [4, 6, 5, 113, 4], [10, 3, 2, 1, 86]], 0.8168, 0.815),
    "roberta-base": ([[107, 6, 4, 1, 7], [1, 144, 12, 7, 3], [10, 13, 146, 5, 4], [1, 8, 5, 117, 1], [5, 1, 4, 3, 89]], 0.8565, 0.8586),
}
# Published per-class F1 (4 digits) and weighted-average F1.
F1_PER_CLASS = {
    "svm-word2vec": [0.8142, 0.8276, 0.8000, 0.8271, 0.8447, 0.8206],
    "xgb-glove": [0.6883, 0.8140, 0.7252, 0.7341, 0.7310, 0.7422],
    "roberta-base": [0.8594, 0.8496, 0.8367, 0.8830, 0.8641, 0.8564],
    "bilstm-custom": [0.7479, 0.8023, 0.8376, 0.8760, 0.8113, 0.8167],
}
XGB_ROLLUP = [[367, 29, 27, 29, 48], [17, 559, 58, 29, 5], [40, 100, 522, 41, 9],
              [16, 36, 37, 427, 12], [47, 13, 15, 15, 318]]
# Published leaderboards (percent means).
BY_MODEL = {"roberta": (85.65, 85.86), "distilbert": (83.10, 83.31), "bilstm": (80.5775, 80.55),
            "svm": (80.575, 80.8325), "bert": (79.97, 79.77), "xgb": (77.8775, 77.905)}
BY_EMBEDDING = {"base": (85.65, 85.86), "base-uncased": (81.535, 81.54), "custom": (80.5433, 80.6333),
                "word2vec": (80.4467, 80.6233), "fasttext": (79.5933, 79.8567), "glove": (78.1233, 77.9367)}


@pytest.fixture(scope="module")
def conf(spark):
    rows = [(m, i, j, v) for m, (mat, _, _) in GOLDEN.items()
            for i, row in enumerate(mat) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "model_name string, y_true int, y_pred int, n long")


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame(list(enumerate(CLASSES)), "code int, label string")


def test_accuracy_and_macro_f1_match_published(conf):
    got = {r["model_name"]: (r["accuracy"], r["f1"]) for r in V.accuracy_f1(conf, ["model_name"]).collect()}
    for m, (_, acc, f1) in GOLDEN.items():
        assert got[m] == (acc, f1), m


def test_per_class_and_weighted_f1(conf, names):
    rep = V.classification_report(conf, names, ["model_name"]).collect()
    by = {(r["model_name"], r["class"]): r for r in rep}
    for m, vals in F1_PER_CLASS.items():
        for c, v in zip(CLASSES, vals[:5]):
            assert round(by[(m, c)]["f1_score"], 4) == pytest.approx(v, abs=1e-9), (m, c)
        assert round(by[(m, "weighted avg")]["f1_score"], 4) == pytest.approx(vals[5], abs=1e-9)
        assert by[(m, "accuracy")]["support"] == 704
        assert [by[(m, c)]["support"] for c in CLASSES] == [125, 167, 178, 132, 102]


def test_report_matches_published_file_to_last_digit(conf, names):
    """svm-glove credit_card row of the published report file."""
    rep = V.classification_report(conf.filter(F.col("model_name") == "svm-glove"), names).collect()
    cc = [r for r in rep if r["class"] == "credit_card"][0]
    assert cc["precision"] == pytest.approx(0.765625, abs=1e-15)
    assert cc["recall"] == pytest.approx(0.784, abs=1e-15)
    assert cc["f1_score"] == pytest.approx(0.774703557312253, abs=1e-15)


def test_xgb_rollup(conf):
    xgb = conf.filter(F.col("model_name").startswith("xgb-")).withColumn("model", F.lit("xgb"))
    got = {(r["y_true"], r["y_pred"]): r["n"] for r in V.confusion_rollup(xgb, ["model"]).collect()}
    for i, row in enumerate(XGB_ROLLUP):
        for j, v in enumerate(row):
            assert got[(i, j)] == v
    assert sum(got.values()) == 2816


def test_leaderboards(spark):
    results = spark.createDataFrame([(m, a, f) for m, (_, a, f) in GOLDEN.items()],
                                    "model_name string, accuracy double, f1 double")
    bm = {r["model"]: (round(r["accuracy"], 4), round(r["f1"], 4), r["n_runs"])
          for r in V.leaderboard(results, "model").collect()}
    for k, (a, f) in BY_MODEL.items():
        assert bm[k][:2] == pytest.approx((a, f), abs=1e-4), k
    be = {r["embedding"]: (round(r["accuracy"], 4), round(r["f1"], 4))
          for r in V.leaderboard(results, "embedding").collect()}
    for k, (a, f) in BY_EMBEDDING.items():
        assert be[k] == pytest.approx((a, f), abs=1e-4), k
    order = [r["model"] for r in V.leaderboard(results, "model").collect()]
    assert order == ["roberta", "distilbert", "bilstm", "svm", "bert", "xgb"]


def test_zero_division_and_label_union(spark):
    """A class never predicted gets precision 0; a class only predicted gets a zero row."""
    preds = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y_true int, y_pred int")
    conf = V.confusion_long(preds)
    m = {r["cls"]: r for r in V.per_class_metrics(conf).collect()}
    assert m[2]["precision"] == 0.0 and m[2]["f1_score"] == 0.0 and m[2]["support"] == 1
    preds2 = spark.createDataFrame([(0, 0), (0, 3)], "y_true int, y_pred int")
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in V.confusion_long(preds2).collect()}
    assert cells[(3, 0)] == 0 and cells[(3, 3)] == 0 and len(cells) == 4


def test_matrix_files_in_published_layout(spark):
    """S11 + A9 on files written in the published layout (headerless, %.18e floats, one file per run)."""
    import os
    import tempfile

    from lexis.sources.stored import read_conf_matrices
    d = tempfile.mkdtemp(prefix="lexis-golden-files-", dir="/tmp")
    for m, (mat, _, _) in GOLDEN.items():
        with open(os.path.join(d, f"{m}-conf_mat.csv"), "w") as f:
            for row in mat:
                f.write(",".join("%.18e" % v for v in row) + "\n")
    conf = read_conf_matrices(spark, d, len(CLASSES))
    got = {r["model_name"]: (r["accuracy"], r["f1"]) for r in V.accuracy_f1(conf, ["model_name"]).collect()}
    assert got == {m: (acc, f1) for m, (_, acc, f1) in GOLDEN.items()}
    xgb = conf.filter(F.col("model_name").startswith("xgb-")).withColumn("model", F.lit("xgb"))
    roll = {(r["y_true"], r["y_pred"]): r["n"] for r in V.confusion_rollup(xgb, ["model"]).collect()}
    assert roll[(1, 1)] == XGB_ROLLUP[1][1] and sum(roll.values()) == 2816
