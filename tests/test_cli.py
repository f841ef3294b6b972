"""The command line runs the three jobs end to end on a text vector file."""

import os
import tempfile

from pyspark.sql import functions as F

from lexis.__main__ import main
from lexis.plans.fixtures import word_vectors
from lexis.sources import stored as S

SF = "/root/testdata/sf0.001"


def test_cli_prepare_train_analyse(spark):
    base = tempfile.mkdtemp(prefix="lexis-cli-", dir="/tmp")
    vec_dir = tempfile.mkdtemp(prefix="lexis-cli-vec-", dir="/tmp")
    lines = word_vectors(spark, SF).select(
        F.concat_ws(" ", "word", F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")).alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(os.path.join(vec_dir, "glove"))
    main(["prepare", "--corpus", f"{SF}/documents.parquet", "--base", base, "--frac", "1.0",
          "--target", "en", "--vectors", f"glove={vec_dir}/glove"])
    main(["train", "--base", base, "--model", "logistic", "--embeddings", "glove"])
    main(["analyse", "--base", base, "--model", "logistic", "--embeddings", "glove"])
    res = S.read_results(spark, f"{base}/results").collect()
    assert [r["model_name"] for r in res] == ["logistic-glove"]
    assert spark.read.parquet(f"{base}/analysis/logistic/by_model").count() == 1
