"""Command line for the three jobs (``spark-submit -m lexis ...`` or ``python -m lexis ...``).

    python -m lexis prepare --corpus /data/documents.parquet --base /shared/run1 \\
        [--text-col text --label-col lang --frac 0.075 --target en --factor 4 \\
         --vectors glove=/data/glove.txt fasttext=/data/wiki.vec word2vec=/data/w2v.parquet custom=/models/w2v]
    python -m lexis train --base /shared/run1 --model svm|svm_rbf|xgb|xgb_val|dense|logistic --embeddings glove fasttext
    python -m lexis analyse --base /shared/run1 --model xgb

Paths must be on storage every executor sees.  The session is the one
``spark-submit`` provides; ``--master`` is only for local runs.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _session(master: str | None) -> SparkSession:
    builder = SparkSession.builder.appName("lexis")
    if master:  # local run: no web UI server
        builder = builder.master(master).config("spark.ui.enabled", "false")
    return builder.getOrCreate()


def _estimator(model: str):
    from pyspark.ml.tuning import ParamGridBuilder

    from lexis.operators import train as T
    if model == "svm":
        return T.svm_grid
    if model == "xgb":
        return T.gbt_grid
    if model == "svm_rbf":
        return T.svm_rbf_grid
    if model == "logistic":
        def logistic():
            lr = T.logistic_estimator()
            return lr, ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.01, 0.1]).build()
        return logistic
    if model == "dense":
        return T.dense_grid
    if model == "centroid":
        return T.centroid_grid
    if model == "xgb_val":
        return T.validated_trees
    raise SystemExit(f"unknown model {model!r} (svm, svm_rbf, xgb, xgb_val, dense, centroid, logistic)")


def cmd_prepare(spark: SparkSession, a) -> None:
    from lexis.plans import jobs
    from lexis.sources.vectors import embedding_registry

    if a.corpus.endswith(".csv"):
        # the import step freezes the content-based keys before anything samples them
        from lexis.sources.corpus import read_corpus_csv
        read_corpus_csv(spark, a.corpus, {"text": a.text_col, "label": a.label_col}).write.mode("overwrite").parquet(f"{a.base}/corpus")
        corpus = spark.read.parquet(f"{a.base}/corpus")
    else:
        docs = spark.read.parquet(a.corpus)
        named = {a.id_col: "doc_id", a.text_col: "text", a.label_col: "label"}
        corpus = docs.select(*[F.col(c).alias(named.get(c, c)) for c in docs.columns])
    vectors = dict(v.split("=", 1) for v in (a.vectors or []))
    paths = jobs.prepare(spark, corpus, a.base, embedding_registry(vectors), frac=a.frac, target=a.target,
                         factor=a.factor, test_size=a.test_size, seed=a.seed,
                         overwrite_split=not a.keep_split, overwrite_results=True, overwrite_params=True,
                         split_first=a.split_first, custom_vectors=a.custom_vectors)
    print(json.dumps(paths))


def cmd_train(spark: SparkSession, a) -> None:
    from lexis.plans import jobs
    paths = {"split": f"{a.base}/split", "label_map": f"{a.base}/label_map", "vectors": f"{a.base}/doc_vecs"}
    names = jobs.run_all(spark, a.base, paths, a.model, _estimator(a.model), a.embeddings)
    print(json.dumps(names))


def cmd_analyse(spark: SparkSession, a) -> None:
    from lexis.plans import jobs
    from lexis.sources import stored as S
    classes = [r["label"] for r in S.read_label_map(spark, f"{a.base}/label_map").orderBy("code").collect()]
    out = jobs.analyse_results(spark, a.base, a.model, classes, a.embeddings, run=a.run, pair=tuple(a.pair) if a.pair else None)
    for name, df in out.items():
        df.write.mode("overwrite").parquet(f"{a.base}/analysis/{a.model}/{name}")
        print(name, f"{a.base}/analysis/{a.model}/{name}")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lexis")
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="cmd", required=True)

    pp = sub.add_parser("prepare")
    pp.add_argument("--corpus", required=True)
    pp.add_argument("--base", required=True)
    pp.add_argument("--id-col", default="doc_id")
    pp.add_argument("--text-col", default="text")
    pp.add_argument("--label-col", default="lang")
    pp.add_argument("--frac", type=float, default=0.075)
    pp.add_argument("--target", default=None)
    pp.add_argument("--factor", type=float, default=4)
    pp.add_argument("--test-size", type=float, default=0.1)
    pp.add_argument("--seed", default="42")
    pp.add_argument("--keep-split", action="store_true", help="reuse a stored split (no overwrite)")
    pp.add_argument("--split-first", action="store_true", help="undersample the train rows only, after the split")
    pp.add_argument("--custom-vectors", action="store_true", help="train word vectors on the train rows as embedding custom")
    pp.add_argument("--vectors", nargs="*", help="name=path pairs: word2vec, glove, fasttext, custom")

    pt = sub.add_parser("train")
    pt.add_argument("--base", required=True)
    pt.add_argument("--model", default="svm")
    pt.add_argument("--embeddings", nargs="+", default=["word2vec", "glove", "fasttext", "custom"])

    pa = sub.add_parser("analyse")
    pa.add_argument("--base", required=True)
    pa.add_argument("--model", default="svm")
    pa.add_argument("--embeddings", nargs="+", default=["word2vec", "glove", "fasttext", "custom"])

    pa.add_argument("--run", default=None, help="stored run whose errors are analysed")
    pa.add_argument("--pair", nargs=2, default=None, metavar=("PREDICTED", "TRUE"))

    a = p.parse_args(argv)
    spark = _session(a.master)
    {"prepare": cmd_prepare, "train": cmd_train, "analyse": cmd_analyse}[a.cmd](spark, a)


if __name__ == "__main__":
    main()
