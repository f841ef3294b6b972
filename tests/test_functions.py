"""Column functions on hand-made edge rows (FIXTURES.md sections 3 and 4)."""

import pytest
from pyspark.sql import functions as F

from lexis.functions import (argmax, encode_fixed, join_tokens, l2_normalize, one_hot, pad_front,
                             space_word_count, split_model_name, word_tokens)

TOKEN_CASES = [
    ("Paid xx/xx/xxxx to BANK xxx", ["Paid", "BANK"], 5),
    ("foxxbar exx taxi", ["fobar", "taxi"], 3),
    ("XXXX Upper", ["XXXX", "Upper"], 2),
    ("don't o'k '''", ["don't", "o'k", "'''"], 3),
    ("", [], 1),
    ("a bb cc", [], 3),
    ("Éréier naïve 漢字漢字", ["Éréier", "naïve", "漢字漢字"], 3),
    ("snake_case a1b2 3,500.00", ["snake_case", "a1b2", "500"], 3),
    ("cafés", ["cafe"], 1),
    ("x²³ ½¼¾", ["x²³", "½¼¾"], 2),
    ("two  spaces", ["two", "spaces"], 3),
]


def test_tokenizer_and_word_count(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(TOKEN_CASES)], "i int, text string")
    rows = df.select("i", word_tokens("text").alias("tok"), space_word_count("text").alias("n")).collect()
    got = {r["i"]: (list(r["tok"]), r["n"]) for r in rows}
    for i, (_, toks, n) in enumerate(TOKEN_CASES):
        assert got[i] == (toks, n), TOKEN_CASES[i][0]


def test_join_tokens(spark):
    r = spark.createDataFrame([(["a", "bb"],), ([],)], "t array<string>").select(join_tokens("t").alias("s"))
    assert [x["s"] for x in r.collect()] == ["a bb", ""]


def test_pad_front_keeps_last_ids(spark):
    df = spark.createDataFrame([([1, 2, 1],), ([],), ([2, 1, 2, 1, 2],)], "ids array<int>")
    out = [list(r["p"]) for r in df.select(pad_front("ids", 4).alias("p")).collect()]
    assert out == [[0, 1, 2, 1], [0, 0, 0, 0], [1, 2, 1, 2]]


@pytest.mark.parametrize("length,ids,mask", [
    (4, [1, 5, 6, 2], [1, 1, 1, 1]),
    (6, [1, 5, 6, 7, 2, 0], [1, 1, 1, 1, 1, 0]),
])
def test_encode_fixed(spark, length, ids, mask):
    df = spark.createDataFrame([([5, 6, 7],)], "ids array<int>")
    r = df.select(encode_fixed("ids", length, 1, 2).alias("e")).collect()[0]["e"]
    assert list(r["ids"]) == ids and list(r["mask"]) == mask


def test_argmax_first_maximum(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4],), ([0.0, 1.0, 0.0],)], "p array<double>")
    assert [r["a"] for r in df.select(argmax("p").alias("a")).collect()] == [1, 1]


def test_one_hot(spark):
    df = spark.createDataFrame([(0,), (3,)], "c int")
    assert [list(r["o"]) for r in df.select(one_hot("c", 4).alias("o")).collect()] == [[1, 0, 0, 0], [0, 0, 0, 1]]


def test_l2_normalize_zero_row_stays_zero(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    out = [list(r["n"]) for r in df.select(l2_normalize("v").alias("n")).collect()]
    assert out == [[0.6, 0.8], [0.0, 0.0]]


def test_split_model_name(spark):
    df = spark.createDataFrame([("bert-base-uncased",), ("svm-glove",), ("plain",)], "m string")
    m, e = split_model_name("m")
    out = [(r["a"], r["b"]) for r in df.select(m.alias("a"), e.alias("b")).collect()]
    assert out == [("bert", "base-uncased"), ("svm", "glove"), ("plain", None)]


def test_tokenizer_stays_in_codegen(spark):
    """The tokenizer is a JVM expression: no Python UDF / ArrowEvalPython in the plan."""
    df = spark.createDataFrame([("a b",)], "text string").select(word_tokens("text"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_no_python_udf_in_catalogue_plans(spark, sf_dir):
    """Spot-check a few registered queries: built-in expressions only."""
    from lexis.plans.catalog import QUERIES
    for name in ["word_distribution_tf", "padded_sequences", "doc_vectors_mean", "classification_report"]:
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan, name
        assert F is not None
