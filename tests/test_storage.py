"""Sources and sinks: nothing stored or read disappears silently."""

import os

import pytest
from pyspark.sql import functions as F

from lexis.operators import analysis as X
from lexis.operators.sequences import fit_vocabulary
from lexis.session import ensure_checkpoint_dir, recommended_conf
from lexis.sinks import writers as K
from lexis.sources import stored as S
from lexis.sources.corpus import read_corpus_csv
from lexis.sources.vectors import embedding_registry, read_text_vectors


def _results(spark, *names):
    return spark.createDataFrame([(n, 1.0, 1.0) for n in names], S.RESULTS_SCHEMA)


def test_upsert_keeps_rows_beside_a_broken_newer_folder(spark, tmp_path):
    p = str(tmp_path / "results")
    K.upsert_versioned(_results(spark, "a", "c"), p)
    os.makedirs(f"{p}/version=1")
    with open(f"{p}/version=1/part-00000.parquet", "w") as f:
        f.write("junk")
    assert S.committed_versions(spark, p) == [0]
    assert K.upsert_versioned(_results(spark, "b"), p) == 2
    assert {r["model_name"] for r in S.read_results(spark, p).collect()} == {"a", "b", "c"}


def test_reset_empties_an_existing_table(spark, tmp_path):
    base = str(tmp_path)
    K.upsert_versioned(_results(spark, "a"), f"{base}/results")
    K.upsert_versioned(_results(spark, "b"), f"{base}/results")
    K.create_results_tables(spark, base, True, False)
    assert S.read_results(spark, f"{base}/results").count() == 0
    with pytest.raises(FileNotFoundError):
        S.read_versioned(spark, f"{base}/best_params")


def test_fasttext_of_any_dimension_and_empty_vectors(spark, tmp_path):
    p = tmp_path / "small.vec"
    p.write_bytes(b"2 100\n" + b"caf\xc3\xa9 " + b" ".join([b"0.5"] * 100) + b"\n"
                  + "odd� ".encode() + b"\xff" + b" ".join([b"1"] * 100) + b"\n")
    got = {r["word"]: len(r["vec"]) for r in embedding_registry({"fasttext": str(p)})["fasttext"](spark).collect()}
    assert got == {"café": 100, "odd�": 100}
    (tmp_path / "none.vec").write_text("0 300\n")
    with pytest.raises(ValueError):
        embedding_registry({"fasttext": str(tmp_path / "none.vec")})["fasttext"](spark)


def test_text_vectors_split_at_unicode_space(spark, tmp_path):
    (tmp_path / "v.txt").write_text("a 1.0\t2.0 \nb 3 4\n", encoding="utf8")
    assert {r["word"]: r["vec"] for r in read_text_vectors(spark, str(tmp_path / "v.txt")).collect()} == {"a": [1, 2], "b": [3, 4]}


def test_csv_columns_by_header_name(spark, tmp_path):
    (tmp_path / "c.csv").write_text(',extra,narrative,product\n0,x,"two\nlines",credit_card\n1,y,N/A,loan\n1,y,N/A,loan\n')
    df = read_corpus_csv(spark, str(tmp_path / "c.csv"))
    rows = sorted((r["product"], r["narrative"]) for r in df.collect() if r["product"] == "credit_card")
    assert rows == [("credit_card", "two\nlines")]
    assert df.select("doc_id").distinct().count() == 3
    again = read_corpus_csv(spark, str(tmp_path / "c.csv")).repartition(3)
    assert {r["doc_id"] for r in again.collect()} == {r["doc_id"] for r in df.collect()}
    with pytest.raises(ValueError):
        read_corpus_csv(spark, str(tmp_path / "c.csv"), {"label": "absent"})


@pytest.mark.parametrize("doc_id", [1 << 43, (1 << 62) + 1])
def test_first_seen_holds_for_large_keys_and_late_positions(spark, doc_id):
    df = spark.createDataFrame([(doc_id, ["b", "a"]), (doc_id - 1, ["c"])], "doc_id long, tokens array<string>")
    assert [r["word"] for r in fit_vocabulary(df, 10).orderBy("idx").collect()] == ["c", "b", "a"]
    late = spark.createDataFrame([(doc_id, (1 << 20) + 5, "x"), (doc_id, (1 << 20) + 6, "y")], "doc_id long, pos int, word string")
    assert [r["word"] for r in X.top_words(late.withColumn("g", F.lit(1)), ["g"], 5).orderBy("rank").collect()] == ["x", "y"]


def test_checkpoint_folder_is_never_made_up_on_a_cluster():
    class Context:
        master = "yarn"

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: None)})
        sparkContext = Context()

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())


def test_recommended_shuffle_partitions_follow_shuffled_bytes():
    assert int(recommended_conf(100 << 40, 8000)["spark.sql.shuffle.partitions"]) < 100_000


def test_salted_join_plans_without_array_scans(spark):
    from lexis.operators.joins import salted_join
    left = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(20)], "id long, word string")
    right = spark.createDataFrame([("a", 1)], "word string, v int")
    assert salted_join(left, right, "word", ["a"], 4, "id").filter("v = 1").count() == 10
