"""Deterministic inputs derived from the driver's tables, in Spark and in DuckDB SQL.

The reference's later stages consume model outputs (predictions, word
vectors, attributions) that cannot be reproduced here.  Each of them is
replaced by a seeded-md5 function of the driver's ``documents`` table, so
it grows with the data and the same expression can be written in SQL.
Every Spark builder below has a SQL twin (``*_SQL``) used by the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexis.functions.arrays import hex_int, seeded_key, unit_interval
from lexis.functions.text import word_tokens
from lexis.operators.analysis import explode_words
from lexis.operators.prep import MAX_CLASSES, bounded_codes, label_codes
from lexis.sources.corpus import load_corpus, read_table

# Run names follow the reference's result files; error rates are ours.
RUNS = [
    ("svm-word2vec", 0.18), ("svm-glove", 0.21), ("svm-fasttext", 0.20), ("svm-custom", 0.19),
    ("xgb-word2vec", 0.22), ("xgb-glove", 0.26), ("xgb-fasttext", 0.23), ("xgb-custom", 0.21),
    ("bert-base-uncased", 0.20), ("roberta-base", 0.14),
]
EMBEDDINGS = ["word2vec", "glove", "fasttext", "custom"]
# the classes of the driver's documents.lang (used only to spell oracle SQL columns)
CORPUS_CLASSES = ["de", "en", "es", "fr"]
WORD_VEC_DIM = 8
ANALYSED_RUN = "xgb-glove"


# ---------------------------------------------------------------- corpus
def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_corpus(spark, sf_dir)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, label, tokens`` for the whole corpus."""
    return corpus(spark, sf_dir).select("doc_id", "label", word_tokens("text").alias("tokens"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``label, code`` over every labelled document, collected once with a hard bound of
    ``MAX_CLASSES`` rows (so joins may broadcast it).

    Only the ``doc_id`` and ``lang`` columns are read - never the text: at
    scale the text column is nearly all of the bytes, and the label map must
    not cost a pass over it.  (Codes therefore do not depend on which texts
    """
    docs = read_table(spark, sf_dir, "documents")
    labelled = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    table, bounded = bounded_codes(label_codes(labelled.select(F.col("lang").alias("label"))))
    if not bounded:
        raise ValueError(f"more than {MAX_CLASSES} classes: not a classification label")
    return table


def class_names(spark: SparkSession, sf_dir: str, table: DataFrame | None = None) -> list[str]:
    """Sorted class names (k values, bounded)."""
    table = codes(spark, sf_dir) if table is None else table
    return [r["label"] for r in sorted(table.collect(), key=lambda r: r["code"])]


def coded_tokens(spark: SparkSession, sf_dir: str, table: DataFrame | None = None) -> DataFrame:
    table = codes(spark, sf_dir) if table is None else table
    return tokens(spark, sf_dir).join(F.broadcast(table), "label", "inner")


CORPUS_SQL = r"""
corpus AS (
  SELECT doc_id, text, lang AS label FROM documents
  WHERE doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL),
tok AS (
  SELECT doc_id, label,
         list_filter(regexp_extract_all(regexp_replace(text, 'x{2,}', '', 'g'), '[''\p{L}\p{N}_]+'),
                     lambda t: length(t) >= 3) AS tokens
  FROM corpus),
codes AS (
  SELECT label, (dense_rank() OVER (ORDER BY label) - 1)::INTEGER AS code
  FROM (SELECT DISTINCT lang AS label FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL)),
coded AS (SELECT t.doc_id, t.label, c.code, t.tokens FROM tok t JOIN codes c USING (label)),
words AS (
  SELECT doc_id, label, unnest(tokens) AS word, (generate_subscripts(tokens, 1) - 1)::INTEGER AS pos
  FROM tok)"""


def sql(*ctes: str, body: str) -> str:
    """Assemble ``WITH <ctes> <body>``."""
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n" + body


# ----------------------------------------------------------- predictions
# a second round of runs: two re-runs with new results and one new run (upsert inputs)
RERUNS = [("svm-glove", 0.12), ("xgb-custom", 0.15), ("distilbert-base-uncased", 0.16)]


def predictions(spark: SparkSession, sf_dir: str, runs=None) -> DataFrame:
    """``model_name, doc_id, y_true, y_pred`` for every run in ``runs`` (default ``RUNS``).

    ``y_true`` is the class code; a seeded fraction ``rate`` of documents
    gets a wrong class.  One scan of ``doc_id, lang`` (no text is read);
    the runs are generated with ``explode`` - no cross join.
    """
    runs = RUNS if runs is None else runs
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label")).na.drop()
    cds, bounded = bounded_codes(label_codes(docs.select("label")))
    if not bounded:
        raise ValueError(f"more than {MAX_CLASSES} classes: not a classification label")
    k = cds.count()  # driver-built table: no job
    coded = docs.join(F.broadcast(cds), "label", "inner")
    run_arr = F.array(*[F.struct(F.lit(n).alias("model_name"), F.lit(float(r)).alias("rate"))
                        for n, r in runs])
    rows = coded.select("doc_id", F.col("code").alias("y_true"), F.explode(run_arr).alias("r"))
    key = seeded_key(F.col("r.model_name"), "doc_id")
    wrong = unit_interval(key) < F.col("r.rate")
    shift = F.lit(1) + hex_int(key, 9, 2) % F.lit(max(k - 1, 1))
    y_pred = F.when(wrong & F.lit(k > 1), (F.col("y_true") + shift) % F.lit(k)).otherwise(F.col("y_true"))
    return rows.select(F.col("r.model_name").alias("model_name"), "doc_id", "y_true",
                       y_pred.cast("int").alias("y_pred"))


def predictions_sql(runs=None, out: str = "preds") -> str:
    """SQL twin of ``predictions``; CTE names are prefixed with ``out``."""
    runs = RUNS if runs is None else runs
    values = ", ".join(f"('{n}', {r})" for n, r in runs)
    return r"""
OUT_docs AS (SELECT doc_id, lang AS label FROM documents
          WHERE doc_id IS NOT NULL AND lang IS NOT NULL),
OUT_codes AS (SELECT label, (dense_rank() OVER (ORDER BY label) - 1)::INTEGER AS code
           FROM (SELECT DISTINCT label FROM OUT_docs)),
OUT_k AS (SELECT count(*) AS k FROM OUT_codes),
OUT_runs AS (SELECT model_name, rate::DOUBLE AS rate FROM (VALUES RUNS_VALUES) AS t(model_name, rate)),
OUT_keyed AS (
  SELECT r.model_name, d.doc_id, c.code AS y_true, r.rate, md5(r.model_name || '-' || d.doc_id) AS key
  FROM OUT_docs d JOIN OUT_codes c USING (label) CROSS JOIN OUT_runs r),
OUT AS (
  SELECT model_name, doc_id, y_true,
         (CASE WHEN ('0x' || substr(key, 1, 8))::BIGINT::DOUBLE / 4294967296.0 < rate
                    AND (SELECT k FROM OUT_k) > 1
               THEN (y_true + 1 + ('0x' || substr(key, 9, 2))::BIGINT % greatest((SELECT k FROM OUT_k) - 1, 1))
                    % (SELECT k FROM OUT_k)
               ELSE y_true END)::INTEGER AS y_pred
  FROM OUT_keyed)""".replace("RUNS_VALUES", values).replace("OUT", out)


PREDICTIONS_SQL = predictions_sql()


# ----------------------------------------------------------- word vectors
def word_vectors(spark: SparkSession, sf_dir: str, dim: int = WORD_VEC_DIM) -> DataFrame:
    """``word, vec array<float>``: integer vectors for the corpus words whose md5 starts even.

    Integer components make document means exact in any summation order;
    the odd half of the vocabulary is absent, exercising misses.
    """
    words = explode_words(tokens(spark, sf_dir), []).distinct()
    words = words.filter(hex_int(F.md5("word"), 1, 1) % 2 == 0)
    comp = lambda i: (hex_int(F.md5(F.concat(F.col("word"), F.lit("-"), i.cast("string"))), 1, 2)
                      % 17 - 8).cast("float")
    return words.select("word", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), comp).alias("vec"))


WORD_VECTORS_SQL = r"""
vectors AS (
  SELECT word, list_transform(range(DIM),
           lambda i: ((('0x' || substr(md5(word || '-' || i), 1, 2))::INTEGER % 17) - 8)::FLOAT) AS vec
  FROM (SELECT DISTINCT word FROM words)
  WHERE ('0x' || substr(md5(word), 1, 1))::INTEGER % 2 = 0)""".replace("DIM", str(WORD_VEC_DIM))


# ----------------------------------------------------------- class weights
def class_weight_rows(spark: SparkSession, sf_dir: str, dim: int = WORD_VEC_DIM) -> list[list[float]]:
    """Linear-model weights (k x dim integers from md5(class, dim)), ordered by code.

    k x dim is bounded by the class count, so it is collected and inlined.
    """
    cds = codes(spark, sf_dir)
    w = lambda d: (hex_int(F.md5(F.concat(F.lit("w-"), F.col("code").cast("string"),
                                          F.lit("-"), F.lit(str(d)))), 1, 2) % 9 - 4).cast("double")
    rows = cds.select("code", *[w(d).alias(f"w{d}") for d in range(dim)]).orderBy("code").collect()
    return [[float(r[f"w{d}"]) for d in range(dim)] for r in rows]


WEIGHTS_SQL = r"""
weights AS (
  SELECT code, d, (('0x' || substr(md5('w-' || code || '-' || d), 1, 2))::INTEGER % 9 - 4)::DOUBLE AS w
  FROM codes CROSS JOIN range(DIM) AS t(d))""".replace("DIM", str(WORD_VEC_DIM))


# ----------------------------------------------------------- attributions
def attributions(spark: SparkSession, sf_dir: str, run: str = ANALYSED_RUN) -> DataFrame:
    """``doc_id, pos, word, weight, y_true, y_pred``: a weight in [-2, 2] per token,
    a function of the word and the predicted class (stands in for an explainer)."""
    preds = predictions(spark, sf_dir).filter(F.col("model_name") == run).drop("model_name")
    ex = explode_words(tokens(spark, sf_dir), ["doc_id"], with_pos=True)
    j = ex.join(preds, "doc_id", "inner")
    h = hex_int(F.md5(F.concat(F.col("word"), F.lit("-"), F.col("y_pred").cast("string"))), 1, 4)
    return j.select("doc_id", "pos", "word", ((h % 401 - 200) / 100.0).alias("weight"), "y_true", "y_pred")


ATTRIBUTIONS_SQL = r"""
attr AS (
  SELECT w.doc_id, w.pos, w.word,
         ((('0x' || substr(md5(w.word || '-' || p.y_pred), 1, 4))::INTEGER % 401) - 200)::DOUBLE / 100.0 AS weight,
         p.y_true, p.y_pred
  FROM words w JOIN preds p ON p.doc_id = w.doc_id AND p.model_name = 'RUN')""".replace("RUN", ANALYSED_RUN)


# ----------------------------------------------------------- synonyms
def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``word, synonym``: a capitalised corpus word maps to its lower-case form when
    that form is itself a corpus word (one row per word; stands in for WordNet)."""
    words = explode_words(tokens(spark, sf_dir), []).distinct()
    lower = words.select(F.col("word").alias("synonym"))
    cand = words.select("word", F.lower("word").alias("synonym")).filter(F.col("word") != F.col("synonym"))
    return cand.join(lower, "synonym", "left_semi").select("word", "synonym")


SYNONYMS_SQL = r"""
vocab AS (SELECT DISTINCT word FROM words),
synonyms AS (
  SELECT v.word, lower(v.word) AS synonym FROM vocab v
  WHERE v.word <> lower(v.word) AND lower(v.word) IN (SELECT word FROM vocab))"""
