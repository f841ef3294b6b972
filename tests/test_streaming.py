"""Streaming forms of preparation and word counts equal their batch results."""

import tempfile

from pyspark.sql import functions as F

from lexis.operators import analysis as X
from lexis.plans import fixtures as fx
from lexis.sources.stored import read_versioned
from lexis.streaming.prepare import stream_prepare, stream_word_class_counts

SF = "/root/testdata/sf0.001"
SOURCE = f"{SF}/documents*.parquet"


def test_stream_prepare_matches_batch_tokens(spark):
    out = tempfile.mkdtemp(prefix="lexis-stream-out-", dir="/tmp")
    q = stream_prepare(spark, SOURCE, fx.codes(spark, SF), out)
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    batch = fx.coded_tokens(spark, SF)
    assert got.count() == batch.count()
    diff = got.select("doc_id", "code", "tokens").exceptAll(batch.select("doc_id", "code", "tokens"))
    assert diff.count() == 0
    share = got.filter(F.col("split") == "test").count() / got.count()
    assert 0.02 < share < 0.25


def test_stream_word_counts_match_batch(spark):
    classes = fx.class_names(spark, SF)
    ckpt = tempfile.mkdtemp(prefix="lexis-stream-ckpt-", dir="/tmp")
    out = f"{ckpt}-table"
    q = stream_word_class_counts(spark, SOURCE, classes, out, checkpoint=ckpt)
    q.awaitTermination(120)
    got = read_versioned(spark, out)
    batch = X.word_class_counts(fx.tokens(spark, SF), "label", classes)
    assert got.count() == batch.count()
    assert got.select("word", *classes, "total").exceptAll(batch.select("word", *classes, "total")).count() == 0
