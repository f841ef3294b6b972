"""The pipeline's stages on a small table: each against brute force on its own input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lexis.llm import queries
from lexis.llm.common import read, written
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = read(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), name))
    return out


def _texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_the_columns_and_follow_their_input(stages):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_duplicates", "decontamination", "token_ids"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes
    assert stages[-1].count() == stages[-2].count()


def test_language_id_only_rejects_unclear_documents(stages):
    kept = {d for d, _ in _texts(stages[1])}
    gone = [t for d, t in _texts(stages[0]) if d not in kept]
    assert len(gone) <= 0.03 * stages[0].count() and dict(_texts(stages[1])).items() <= dict(_texts(stages[0])).items()


def test_line_dedup_stage(stages):
    want = {d: r[0] for d, r in brute.line_dedup(_texts(stages[1])).items() if not r[5]}
    assert dict(_texts(stages[2])) == want
    assert stages[2].filter(F.col("n_chars") != F.length("text")).count() == 0


def test_near_duplicate_stage(stages):
    want = {d for d, (_, group) in brute.jaccard_groups(_texts(stages[2]), 5, 80).items() if d == group}
    assert {d for d, _ in _texts(stages[3])} == want


def test_decontamination_stage(spark, stages):
    items = [(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()]
    want = {d for d, r in brute.contamination(_texts(stages[3]), items).items() if not r[4]}
    assert {d for d, _ in _texts(stages[4])} == want


def test_token_ids_stage(spark, stages):
    texts = dict(_texts(stages[4]))
    for r in stages[5].collect():
        assert r["decoded_sha256"] == brute.sha(texts[r["doc_id"]] or "")
    whole = corpus_pipeline.run(spark, SF)
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in stages[5].collect()}


def test_empty_documents(spark, tmp_path):
    docs = read(spark, SF, "documents").filter("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == read(spark, SF, "documents").columns
        docs = written(docs, "empty")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_rows_without_doc_id_are_judged_like_others(spark):
    docs = read(spark, SF, "documents")
    item = max((r["text"] for r in read(spark, SF, "benchmark").collect()), key=len)
    body = [f"{item}\nnumber {i} of the texts that nobody has given a key but that are as long as others are" for i in range(2)]
    lone = [r["text"] for r in docs.orderBy(F.desc(F.length("text")), "doc_id").limit(1).collect()][0]
    new = spark.createDataFrame([(None, lone + "\n" + lone), (None, "the rather short story of a man who went to the sea in a boat and came back with no fish at all"),
                                 (None, "the rather short story of a man who went to the sea in a boat and came back with no fish at all"), (None, body[0])],
                                docs.select("doc_id", "text").schema)
    rest = {f.name: F.lit(None).cast(f.dataType) for f in docs.schema if f.name not in ("doc_id", "text")}
    every = written(docs.unionByName(new.withColumns(rest).select(docs.columns)), "with-null-keys")
    nulls = lambda df: sorted(r["text"] for r in df.filter("doc_id IS NULL").collect())
    judged = corpus_pipeline.language_id(spark, every, SF)
    assert judged.dtypes == docs.dtypes and len(nulls(judged)) == 4
    lines = written(corpus_pipeline.line_dedup(spark, every, SF), "lines-null")
    assert lines.dtypes == docs.dtypes and len(nulls(lines)) == 2  # a copy of a keyed text and one of two equal texts go whole
    assert sum(t.startswith("the rather short story") for t in nulls(lines)) == 1
    near = nulls(corpus_pipeline.near_duplicates(spark, every, SF))
    assert sum(t.startswith("the rather short story") for t in near) == 1
    clean = nulls(corpus_pipeline.decontamination(spark, every, SF))
    assert body[0] not in clean and len(clean) == 2 + (lone + "\n" + lone in clean)
    same = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).select("doc_id").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, every, SF).filter("doc_id IS NOT NULL").select("doc_id").collect()} == same


def test_rows_with_repeated_ids_keep_their_own_texts(spark):
    """Different texts under one id, a null id beside the largest long, and a column of a name that a stage once used."""
    docs = read(spark, SF, "documents")
    texts = ["the first of two quite different texts that share one key, long enough to be judged by every stage of this pipeline here",
             "eine ganz andere Geschichte von einem Haus am See und den Leuten, die dort im Sommer gewohnt und gekocht haben, vor langer Zeit"]
    new = spark.createDataFrame([(0, texts[0]), (0, texts[1]), (2 ** 63 - 1, texts[0] + " and then some more words that no other text of them all has had"), (None, None)],
                                docs.select("doc_id", "text").schema)
    rest = {f.name: F.lit(None).cast(f.dataType) for f in docs.schema if f.name not in ("doc_id", "text")}
    every = written(docs.filter("doc_id <> 0").unionByName(new.withColumns(rest).select(docs.columns)).withColumn("_left", F.lit("x")), "repeated-ids")
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.near_duplicates, corpus_pipeline.decontamination):
        out = stage(spark, every, SF)
        assert out.dtypes == every.dtypes
        assert sorted(r["text"] for r in out.filter("doc_id = 0").collect()) == sorted(texts)
        assert out.filter(F.col("doc_id") == 2 ** 63 - 1).count() == 1


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
