"""The reference's three entry points as Spark jobs.

* ``prepare``      - entry 1: read, drop nulls, sample, code labels, tokenize,
                     undersample, split, document vectors per embedding, empty result tables.
* ``run_all``      - entry 2: per embedding, grid search, predict, evaluate, store.
* ``analyse_results`` - entry 3: leaderboards, class-metric pivots, confusion roll-ups.

Stages hand over through written tables (Parquet in ``base``), which also
cut the lineage: a lost executor recomputes from the last written table,
not from the raw corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexis.operators import analysis as X
from lexis.operators import evaluate as V
from lexis.operators import prep as P
from lexis.operators import train as T
from lexis.operators.cooccurrence import train_word_vectors
from lexis.operators.sampling import exact_sample
from lexis.operators.vectors import doc_vectors_mean
from lexis.session import cut_lineage, written
from lexis.sinks import writers as K
from lexis.sources import stored as S
from lexis.sources.vectors import read_vector_table


def prepare(spark: SparkSession, corpus: DataFrame, base: str,
            embeddings: dict[str, Callable[[SparkSession], DataFrame]],
            frac: float = P.SAMPLE_RATE, target: str | None = None,
            factor: float = P.UNDERSAMPLE_FACTOR, test_size: float = P.TEST_SIZE,
            seed: str = "42", overwrite_split: bool = True, overwrite_emb: dict[str, bool] | None = None,
            overwrite_results: bool = False, overwrite_params: bool = False,
            codes_on_full_table: bool = False, split_first: bool = False,
            custom_vectors: bool = False) -> dict[str, str]:
    """Entry 1 over ``corpus(doc_id, text, label, ...)``; returns the written paths.

    Defaults follow the reference: rows with a null in **any** column go before
    the projection, codes are computed on the sample (option: on the full
    table), undersampling happens before the split (``split_first``: after it,
    on the train rows only).  ``custom_vectors`` trains word vectors on the
    train rows, saves them and adds them as embedding ``custom``.

    The raw corpus is scanned twice, whatever the options: once for a written
    ``doc_id, label`` table, on which every sampling, undersampling and split
    threshold is found, and once for the selected rows.  With
    ``overwrite_split`` off and a stored split, it is not scanned at all.
    """
    paths = {"split": f"{base}/split", "label_map": f"{base}/label_map", "vectors": f"{base}/doc_vecs",
             "keys": f"{base}/keys"}
    if overwrite_split or not S.exists(spark, paths["split"]):
        clean = P.drop_null_rows(corpus).select("doc_id", "text", "label")
        clean.select("doc_id", "label").write.mode("overwrite").parquet(paths["keys"])
        keys = spark.read.parquet(paths["keys"])
        keys_in = exact_sample(keys, frac, seed=seed)
        codes, _ = P.bounded_codes(P.label_codes(keys if codes_on_full_table else keys_in))
        rows = P.attach_codes(exact_sample(clean, frac, seed=seed, basis=keys), codes)
        small = lambda df: P.undersample(df, target, factor, seed=f"{seed}u", basis=keys_in) if target is not None else df
        if split_first:
            # thresholds: the split over the sample, undersampling over its train rows
            split_keys = P.train_test_split(keys_in, test_size, seed=f"{seed}s")
            split = P.train_test_split(rows, test_size, seed=f"{seed}s", basis=keys_in)
            if target is not None:
                kept = P.undersample(split, target, factor, seed=f"{seed}u", basis=split_keys.filter(F.col("split") == "train"))
                split = split.filter(F.col("split") == "test").unionByName(kept.filter(F.col("split") == "train"))
        else:
            split = P.train_test_split(small(rows), test_size, seed=f"{seed}s", basis=small(keys_in))
        K.write_split(P.tokenize(split).select("doc_id", "label", "code", "tokens", "split"), paths["split"], True)
        codes.write.mode("overwrite").parquet(paths["label_map"])

    stored = S.read_split(spark, paths["split"])  # the written table: lineage ends here
    loaders = dict(embeddings)
    if custom_vectors:
        paths["custom"] = f"{base}/models/word2vec-custom"
        train_word_vectors(stored.filter(F.col("split") == "train")).write.mode("overwrite").parquet(paths["custom"])
        loaders["custom"] = lambda s: read_vector_table(s, paths["custom"])
    flags = overwrite_emb if overwrite_emb is not None else {name: True for name in loaders}
    for name, loader in loaders.items():
        if not flags.get(name, False):
            continue
        # the vector file is parsed once; its size decides the join
        loader(spark).write.mode("overwrite").parquet(f"{base}/word_vecs/{name}")
        vecs = doc_vectors_mean(stored, spark.read.parquet(f"{base}/word_vecs/{name}"), empty="zeros", keep=["split"])
        K.write_doc_vectors(vecs, paths["vectors"], name)
    K.create_results_tables(spark, base, overwrite_results, overwrite_params)
    return paths


def _labelled_vectors(spark: SparkSession, paths: dict[str, str], emb_name: str, split: str) -> DataFrame:
    """Every stored document of the split; one without any known word has a zero vector."""
    vecs = S.read_doc_vectors(spark, paths["vectors"], emb_name, split)
    labels = S.read_split(spark, paths["split"], split).select("doc_id", F.col("code").cast("double").alias("label"))
    return T.with_features(vecs.join(labels, "doc_id", "inner"), "vec")


def run_all(spark: SparkSession, base: str, paths: dict[str, str], model_name: str,
            estimator_and_grid: Callable[..., tuple], embeddings: list[str]) -> list[str]:
    """Entry 2: for each embedding, grid search on 3 stratified folds, test predictions, metrics, store.

    Every test document is scored: one without any known word has a zero
    vector (the reference's NaN vectors would stop the fit), so accuracy,
    support and matrix cover the whole split.  ``embeddings`` may hold ``""``
    for a model that works on the tokens themselves (stored under the plain
    model name).  The estimator factory is called with ``n_rows`` and ``dim``
    of the training table where it takes them.
    """
    codes = S.read_label_map(spark, paths["label_map"])
    k = codes.count()
    stored = []
    for emb in embeddings:
        if emb:
            train, test = (_labelled_vectors(spark, paths, emb, x) for x in ("train", "test"))
        else:
            train, test = (S.read_split(spark, paths["split"], x).withColumn("label", F.col("code").cast("double")) for x in ("train", "test"))
        train = written(T.with_validation_flag(P.stratified_folds(train, "label", "doc_id"), "doc_id"), "grid-train")
        made = T.call_factory(estimator_and_grid, train, k)
        if isinstance(made, T.GridSearch):
            model, params = made.search(train, k, T.vector_dim_of(train, "vec"))
        else:
            cv = T.grid_search(*made, train)
            model, params = cv.bestModel, T.best_params(cv)
        preds = T.predict(model, test, "doc_id")
        # the k x k table feeds five sinks: materialise it once in the shared checkpoint folder
        conf = cut_lineage(V.confusion_long(preds))
        results = V.accuracy_f1(conf)
        report = V.classification_report(conf, codes)
        stored.append(K.store_results(spark, base, model_name, emb, model, params, results, report, conf, k))
        preds.write.mode("overwrite").parquet(f"{base}/predictions/{stored[-1]}")
    return stored


def analyse_results(spark: SparkSession, base: str, model: str, classes: list[str],
                  embeddings: list[str], metrics: tuple[str, ...] = ("f1-score", "precision", "recall"),
                  run: str | None = None, pair: tuple[str, str] | None = None) -> dict[str, DataFrame]:
    """Entry 3 over the stored results: leaderboards, class-metric pivots, confusion roll-up.

    With ``run`` (a stored run name) also the error analysis of its
    predictions: one misclassified document per class pair, top words per
    pair, word tables by class (term and document frequency) and, for
    ``pair = (predicted, true)``, its predictions and side-by-side top words.
    """
    results = S.read_results(spark, f"{base}/results")
    reports = S.read_reports(spark, base)
    conf = S.read_conf_matrices(spark, base, len(classes))
    out = {"by_model": V.leaderboard(results, "model"), "by_embedding": V.leaderboard(results, "embedding")}
    for metric in metrics:
        long = S.report_metric(reports, metric, classes).withColumnRenamed(metric, "m")
        name = "class_metric_pivot" if metric == "f1-score" else f"class_metric_pivot_{metric}"
        out[name] = V.class_metric_pivot(long, model, "m", embeddings, classes)
    out["confusion_rollup"] = V.confusion_rollup(conf.withColumn("model", F.split("model_name", "-", 2)[0])
                                                 .filter(F.col("model") == model), ["model"])
    if run:
        split = S.read_split(spark, f"{base}/split")
        preds = spark.read.parquet(f"{base}/predictions/{run}")
        out["misclassified_sample"] = X.misclassified_sample(preds, split)
        words = X.explode_tokens(split.select("doc_id", "tokens").join(preds, "doc_id"), ["doc_id", "y_pred", "y_true"])
        out["common_words"] = X.top_words(words, ["y_pred", "y_true"], 15)
        out["word_distribution"] = X.word_class_counts(split, "label", classes)
        out["document_distribution"] = X.word_class_counts(split, "label", classes, unique_only=True)
        if pair:
            code = {c: i for i, c in enumerate(classes)}
            out["pair_predictions"] = X.pair_filter(preds, code[pair[0]], code[pair[1]])
            top = out["common_words"]
            at = lambda p, t: top.filter((F.col("y_pred") == code[p]) & (F.col("y_true") == code[t]))
            out["compare_classes"] = X.compare_classes(at(*pair), at(pair[1], pair[1]))
    return out
