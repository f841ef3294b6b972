"""Registered queries: one Spark job per operator group, each with a DuckDB SQL twin.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> SQL``
(tables ``documents``, ``labels``, ``embeddings`` ... are views in DuckDB).
Every query reads the driver's tables (or data Spark derives from them)
over the whole table.  Computed columns carry the same alias on both sides;
doubles are rounded to 6 digits on both sides; arrays are rendered as
comma-joined strings or long rows so both engines print them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexis.functions.text import BLANKS, TREEBANK_RULES, join_tokens, treebank_tokens, word_tokens
from lexis.operators import analysis as X
from lexis.operators import eda as A
from lexis.operators import evaluate as V
from lexis.operators import prep as P
from lexis.operators import sequences as S
from lexis.operators import vectors as E
from lexis.operators.augment import synonym_augment
from lexis.operators.sampling import exact_sample
from lexis.operators.scoring import fit_centroids, linear_scores, softmax, token_contributions
from lexis.plans import fixtures as fx
from lexis.plans.fixtures import (ATTRIBUTIONS_SQL, CORPUS_CLASSES, CORPUS_SQL, EMBEDDINGS,
                                  PREDICTIONS_SQL, SYNONYMS_SQL, WEIGHTS_SQL, WORD_VEC_DIM,
                                  WORD_VECTORS_SQL, sql)
from lexis.session import written
from lexis.sources.corpus import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Fixed parameters of the reference's jobs.
SAMPLE_SEED = "42"
UNDERSAMPLE_SEED = "42u"
SPLIT_SEED = "42s"
UNDERSAMPLE_TARGET = "en"
MAX_WORDS = S.MAX_WORDS
MAX_LEN = S.MAX_LEN
ENCODE_LENGTH = S.ENCODE_LENGTH
TOP_N_WORDS = 15
ATTR_TOP_N = 30
CMP_PRED, CMP_TRUE = "en", "de"
SELECTED_CLASSES = ["de", "fr"]
SLICE_START, SLICE_END = 20, 40
PIVOT_MODEL, PIVOT_METRIC = "xgb", "f1_score"
LOOKUP_RUN = "xgb-glove"


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def ints_str(c) -> F.Column:
    """array<int> -> '1,2,3' (same text in DuckDB's array_to_string)."""
    return F.array_join(F.transform(F.col(c) if isinstance(c, str) else c, lambda x: x.cast("string")), ",")


def _classes_sql(expr: str, agg: str = "count(*)") -> str:
    return ", ".join(f"{agg} FILTER (WHERE {expr} = '{c}') AS {c}" for c in CORPUS_CLASSES)


# =============================================================== explore
LENS_SQL = "lens AS (SELECT len(string_split(text, ' '))::INTEGER AS x FROM corpus)"


@register("corpus_shape", sql(CORPUS_SQL, body="SELECT count(*) AS n_rows, 3::INTEGER AS n_cols FROM corpus"))
def q_corpus_shape(spark, sf):
    return A.corpus_shape(fx.corpus(spark, sf))


@register("class_share", sql(CORPUS_SQL, body="""
SELECT label, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share
FROM corpus GROUP BY label"""))
def q_class_share(spark, sf):
    return A.class_share(fx.corpus(spark, sf)).select("label", "n", r6("share").alias("share"))


@register("text_length_stats", sql(CORPUS_SQL, LENS_SQL, body="""
SELECT max(x) AS max_len, min(x) AS min_len, round(avg(x), 6) AS mean_len FROM lens"""))
def q_text_length_stats(spark, sf):
    s = A.length_stats(A.with_word_count(fx.corpus(spark, sf)))
    return s.select("max_len", "min_len", r6("mean_len").alias("mean_len"))


@register("length_histogram", sql(CORPUS_SQL, LENS_SQL, """
st AS (SELECT min(x)::BIGINT AS mn, max(x)::BIGINT AS mx FROM lens)""", """
b AS (SELECT (CASE WHEN st.mx > st.mn THEN least((x - st.mn) * 1000 // (st.mx - st.mn), 999)
                   ELSE 500 END)::INTEGER AS bin FROM lens, st)""", """
cnt AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)""", """
grid AS (SELECT range::INTEGER AS bin FROM range(1000))""", body="""
SELECT g.bin,
       round(CASE WHEN st.mx > st.mn THEN g.bin::DOUBLE * ((st.mx - st.mn)::DOUBLE / 1000) + st.mn::DOUBLE
                  ELSE g.bin::DOUBLE * (1.0::DOUBLE / 1000) + (st.mn::DOUBLE - 0.5) END, 6) AS bin_lo,
       round(CASE WHEN st.mx > st.mn THEN (g.bin + 1)::DOUBLE * ((st.mx - st.mn)::DOUBLE / 1000) + st.mn::DOUBLE
                  ELSE (g.bin + 1)::DOUBLE * (1.0::DOUBLE / 1000) + (st.mn::DOUBLE - 0.5) END, 6) AS bin_hi,
       coalesce(c.n, 0) AS n
FROM grid g CROSS JOIN st LEFT JOIN cnt c USING (bin)"""))
def q_length_histogram(spark, sf):
    h = A.length_histogram(A.with_word_count(fx.corpus(spark, sf)))
    return h.select("bin", r6("bin_lo").alias("bin_lo"), r6("bin_hi").alias("bin_hi"), "n")


@register("length_frequency", sql(CORPUS_SQL, LENS_SQL, """
cnt AS (SELECT x AS len, count(*) AS n FROM lens GROUP BY x)""", body="""
SELECT len, n, round(n::DOUBLE / sum(n) OVER (), 6) AS share,
       round((sum(n) OVER (ORDER BY len ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE
             / sum(n) OVER (), 6) AS cum_share
FROM cnt"""))
def q_length_frequency(spark, sf):
    f = A.length_frequency(A.with_word_count(fx.corpus(spark, sf)))
    return f.select("len", "n", r6("share").alias("share"), r6("cum_share").alias("cum_share"))


@register("length_cumulative_share", sql(CORPUS_SQL, LENS_SQL, """
cnt AS (SELECT x AS len, count(*) AS n FROM lens GROUP BY x)""", """
ranked AS (SELECT len, n, row_number() OVER (ORDER BY len) AS r FROM cnt)""", """
ks AS (SELECT k FROM (VALUES (100), (300)) AS t(k))""", body="""
SELECT k::INTEGER AS k,
       round(coalesce((SELECT sum(n) FROM ranked WHERE r <= ks.k), 0)::DOUBLE / (SELECT sum(n) FROM cnt), 6)
         AS share_first_k_lengths,
       round(coalesce((SELECT sum(n) FROM cnt WHERE len <= ks.k), 0)::DOUBLE / (SELECT sum(n) FROM cnt), 6)
         AS share_len_le_k
FROM ks"""))
def q_length_cumulative_share(spark, sf):
    c = A.length_cumulative_share(A.with_word_count(fx.corpus(spark, sf)))
    return c.select("k", r6("share_first_k_lengths").alias("share_first_k_lengths"),
                    r6("share_len_le_k").alias("share_len_le_k"))


@register("sample_vocabulary", sql(CORPUS_SQL, """
samp AS (SELECT * FROM corpus
         QUALIFY row_number() OVER (ORDER BY md5('42-' || doc_id))
                 <= (SELECT round_even(0.025::DOUBLE * count(*), 0) FROM corpus))""", body=r"""
SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^ \t\n\x0B\f\r\p{L}\p{N}_]')) AS word FROM samp"""))
def q_sample_vocabulary(spark, sf):
    return A.sample_vocabulary(fx.corpus(spark, sf), seed=SAMPLE_SEED)


def _treebank_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    out = "' ' || text || ' '"
    for pattern, replacement in TREEBANK_RULES:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(replacement.replace('$', chr(92)))}, 'g')"
    return f"list_filter(regexp_split_to_array({out}, {quoted(BLANKS)}), lambda t: t <> '')"


@register("sample_vocabulary_treebank", sql(CORPUS_SQL, """
samp AS (SELECT * FROM corpus
         QUALIFY row_number() OVER (ORDER BY md5('42-' || doc_id))
                 <= (SELECT round_even(0.025::DOUBLE * count(*), 0) FROM corpus))""", body=f"SELECT DISTINCT unnest({_treebank_sql()}) AS word FROM samp"))
def q_sample_vocabulary_treebank(spark, sf):
    """T6 with the contraction-aware tokenizer."""
    return A.sample_vocabulary(fx.corpus(spark, sf), seed=SAMPLE_SEED, tokenizer=treebank_tokens)


@register("treebank_token_counts", sql(CORPUS_SQL, f"t AS (SELECT doc_id, {_treebank_sql()} AS t FROM corpus)", body="""
SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM t"""))
def q_treebank_token_counts(spark, sf):
    """The contraction-aware tokens of every document, as count and digest."""
    docs = fx.corpus(spark, sf).select("doc_id", treebank_tokens("text").alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


# =============================================================== prepare
SAMPLE_SQL = """
samp AS (SELECT * FROM corpus
         QUALIFY row_number() OVER (ORDER BY md5('42-' || doc_id))
                 <= (SELECT round_even(0.075::DOUBLE * count(*), 0) FROM corpus))"""

UNDER_SQL = """
tgt AS (SELECT doc_id FROM corpus WHERE label = 'en'
        QUALIFY row_number() OVER (ORDER BY md5('42u-' || doc_id))
                <= (SELECT ceil(count(*) / 4.0) FROM corpus WHERE label = 'en')),
under AS (SELECT * FROM corpus WHERE label <> 'en' OR doc_id IN (SELECT doc_id FROM tgt))"""


@register("drop_null_rows", """
SELECT d.doc_id, d.lang AS label, l.quality, l.toxic
FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE d.doc_id IS NOT NULL AND d.text IS NOT NULL AND d.lang IS NOT NULL
  AND l.quality IS NOT NULL AND l.toxic IS NOT NULL""")
def q_drop_null_rows(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("label"))
    joined = docs.join(read_table(spark, sf, "labels"), "doc_id", "left")
    return P.drop_null_rows(joined).select("doc_id", "label", "quality", "toxic")


def _keys(spark, sf) -> DataFrame:
    """``doc_id, label`` of the corpus, written: thresholds are found on it, the text is scanned once for the selection."""
    return written(fx.corpus(spark, sf).select("doc_id", "label"), "keys")


@register("exact_sample", sql(CORPUS_SQL, SAMPLE_SQL, body="SELECT doc_id, label FROM samp"))
def q_exact_sample(spark, sf):
    return exact_sample(fx.corpus(spark, sf), P.SAMPLE_RATE, seed=SAMPLE_SEED, basis=_keys(spark, sf)).select("doc_id", "label")


@register("label_codes", sql(CORPUS_SQL, SAMPLE_SQL, body="""
SELECT label, (dense_rank() OVER (ORDER BY label) - 1)::INTEGER AS code FROM (SELECT DISTINCT label FROM samp)"""))
def q_label_codes(spark, sf):
    sampled = exact_sample(fx.corpus(spark, sf), P.SAMPLE_RATE, seed=SAMPLE_SEED)
    return P.label_codes(sampled)


@register("one_hot_labels", sql(CORPUS_SQL, "nk AS (SELECT count(*) AS k FROM codes)", body="""
SELECT doc_id, code,
       array_to_string(list_concat(list_resize([]::INTEGER[], code, 0), [1],
                                   list_resize([]::INTEGER[], nk.k - code - 1, 0)), ',') AS onehot
FROM coded, nk"""))
def q_one_hot_labels(spark, sf):
    table = fx.codes(spark, sf)
    coded = fx.coded_tokens(spark, sf, table)
    k = table.count()
    return P.with_one_hot(coded, k).select("doc_id", "code", ints_str("onehot").alias("onehot"))


@register("undersample_class", sql(CORPUS_SQL, UNDER_SQL, body="SELECT doc_id, label FROM under"))
def q_undersample_class(spark, sf):
    u = P.undersample(fx.corpus(spark, sf), UNDERSAMPLE_TARGET, P.UNDERSAMPLE_FACTOR, seed=UNDERSAMPLE_SEED, basis=_keys(spark, sf))
    return u.select("doc_id", "label")


@register("train_test_split", sql(CORPUS_SQL, UNDER_SQL, body="""
SELECT doc_id, label,
       CASE WHEN row_number() OVER (ORDER BY md5('42s-' || doc_id))
                 <= (SELECT ceil(0.1::DOUBLE * count(*)) FROM under) THEN 'test' ELSE 'train' END AS split
FROM under"""))
def q_train_test_split(spark, sf):
    keys = _keys(spark, sf)
    small = lambda df: P.undersample(df, UNDERSAMPLE_TARGET, P.UNDERSAMPLE_FACTOR, seed=UNDERSAMPLE_SEED, basis=keys)
    return P.train_test_split(small(fx.corpus(spark, sf)), P.TEST_SIZE, seed=SPLIT_SEED, basis=small(keys)).select("doc_id", "label", "split")


@register("class_counts", sql(CORPUS_SQL, UNDER_SQL, body="""
SELECT label, count(*) AS n, grouping(label) = 1 AS is_total FROM under GROUP BY ROLLUP (label)"""))
def q_class_counts(spark, sf):
    u = P.undersample(fx.corpus(spark, sf), UNDERSAMPLE_TARGET, P.UNDERSAMPLE_FACTOR, seed=UNDERSAMPLE_SEED)
    return P.class_counts(u)


@register("tokenize_documents", sql(CORPUS_SQL, body="""
SELECT doc_id, len(tokens)::INTEGER AS n_tokens, array_to_string(tokens, ' ') AS tokens_text FROM tok"""))
def q_tokenize_documents(spark, sf):
    t = fx.tokens(spark, sf)
    return t.select("doc_id", F.size("tokens").alias("n_tokens"), join_tokens("tokens").alias("tokens_text"))


@register("synonym_augment", sql(CORPUS_SQL, SYNONYMS_SQL, """
chosen AS (SELECT doc_id, label, tokens FROM tok
           WHERE ('0x' || substr(md5('42-row-' || doc_id), 1, 8))::BIGINT::DOUBLE / 4294967296.0 < 0.5)""", """
rep AS (SELECT w.doc_id, w.pos,
               CASE WHEN s.synonym IS NOT NULL
                         AND ('0x' || substr(md5('42-word-' || w.doc_id || '-' || w.pos), 1, 8))::BIGINT::DOUBLE
                             / 4294967296.0 < 0.5
                    THEN s.synonym ELSE w.word END AS w
        FROM words w JOIN chosen c USING (doc_id) LEFT JOIN synonyms s USING (word))""", """
agg AS (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS t FROM rep GROUP BY doc_id)""", body="""
SELECT doc_id, 0 AS augmented, label, array_to_string(tokens, ' ') AS tokens_text FROM tok
UNION ALL
SELECT c.doc_id, 1 AS augmented, c.label, coalesce(a.t, '') AS tokens_text
FROM chosen c LEFT JOIN agg a USING (doc_id)"""))
def q_synonym_augment(spark, sf):
    out = synonym_augment(fx.tokens(spark, sf), fx.synonyms(spark, sf), 0.5, 0.5, seed="42")
    return out.select("doc_id", "augmented", "label", join_tokens("tokens").alias("tokens_text"))


# =============================================================== sequences
VOCAB_SQL = """
sp AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42s-' || doc_id))
                      <= (SELECT ceil(0.1::DOUBLE * count(*)) FROM corpus) AS is_test FROM corpus),
vc AS (SELECT w.word, count(*) AS n, min(w.doc_id::HUGEINT * 2147483648 + w.pos) AS fs
       FROM words w JOIN sp USING (doc_id) WHERE NOT sp.is_test GROUP BY w.word),
vocab AS (SELECT (row_number() OVER (ORDER BY n DESC, fs))::INTEGER AS idx, word, n FROM vc
          QUALIFY row_number() OVER (ORDER BY n DESC, fs) <= 9999)"""


def _train_vocab(spark, sf) -> DataFrame:
    split = P.train_test_split(fx.corpus(spark, sf), P.TEST_SIZE, seed=SPLIT_SEED, basis=_keys(spark, sf))
    train = split.filter(F.col("split") == "train").select("doc_id", "text")
    return S.fit_vocabulary(train.select("doc_id", word_tokens("text").alias("tokens")), MAX_WORDS)


@register("vocabulary_index", sql(CORPUS_SQL, VOCAB_SQL, body="SELECT idx, word, n FROM vocab"))
def q_vocabulary_index(spark, sf):
    return _train_vocab(spark, sf)


@register("padded_sequences", sql(CORPUS_SQL, VOCAB_SQL, """
seq AS (SELECT w.doc_id, list(v.idx ORDER BY w.pos) AS ids FROM words w JOIN vocab v USING (word)
        GROUP BY w.doc_id)""", """
kept AS (SELECT c.doc_id, coalesce(s.ids, []::INTEGER[]) AS ids FROM corpus c LEFT JOIN seq s USING (doc_id))""",
    body="""
SELECT doc_id,
       array_to_string(list_concat(list_resize([]::INTEGER[], greatest(300 - len(ids), 0), 0),
                                   CASE WHEN len(ids) > 300 THEN list_slice(ids, len(ids) - 299, len(ids))
                                        ELSE ids END), ',') AS ids
FROM kept"""))
def q_padded_sequences(spark, sf):
    seqs = S.padded_sequences(fx.tokens(spark, sf), _train_vocab(spark, sf), MAX_LEN)
    return seqs.select("doc_id", ints_str("ids").alias("ids"))


@register("encoded_with_mask", sql(CORPUS_SQL, VOCAB_SQL, """
eseq AS (SELECT w.doc_id, list(coalesce(v.idx + 3, 3) ORDER BY w.pos) AS ids
         FROM words w LEFT JOIN vocab v USING (word) GROUP BY w.doc_id)""", """
nk AS (SELECT count(*) AS k FROM codes)""", """
framed AS (SELECT c.doc_id, c.code,
                  list_concat([1], list_slice(coalesce(e.ids, []::INTEGER[]), 1, 98), [2]) AS f
           FROM coded c LEFT JOIN eseq e USING (doc_id))""", body="""
SELECT doc_id,
       array_to_string(list_resize(f, 100, 0), ',') AS ids,
       array_to_string(list_resize(list_resize([]::INTEGER[], len(f), 1), 100, 0), ',') AS mask,
       array_to_string(list_concat(list_resize([]::INTEGER[], code, 0), [1],
                                   list_resize([]::INTEGER[], nk.k - code - 1, 0)), ',') AS onehot
FROM framed, nk"""))
def q_encoded_with_mask(spark, sf):
    table = fx.codes(spark, sf)
    coded = fx.coded_tokens(spark, sf, table)
    k = table.count()
    enc = S.encoded_with_mask(coded, _train_vocab(spark, sf), ENCODE_LENGTH, keep=["code"])
    return P.with_one_hot(enc, k).select(
        "doc_id", ints_str("ids").alias("ids"), ints_str("mask").alias("mask"),
        ints_str("onehot").alias("onehot"))


# =============================================================== vectors
DIMS = range(WORD_VEC_DIM)
DOCVEC_SQL = """
dv AS (SELECT w.doc_id, count(v.vec) AS n_known, {sums}
       FROM words w LEFT JOIN vectors v USING (word) GROUP BY w.doc_id)""".format(
    sums=", ".join(f"sum(v.vec[{d + 1}]::DOUBLE) AS s{d}" for d in DIMS))
DOCVEC_FULL_SQL = """
docvec AS (SELECT c.doc_id, coalesce(dv.n_known, 0) AS n_known, {means}
           FROM corpus c LEFT JOIN dv USING (doc_id))""".format(
    means=", ".join(f"CASE WHEN dv.n_known > 0 THEN dv.s{d} / dv.n_known END AS v{d}" for d in DIMS))


def _docvecs(spark, sf) -> DataFrame:
    return E.doc_vectors_mean(fx.tokens(spark, sf), fx.word_vectors(spark, sf), WORD_VEC_DIM)


@register("doc_vectors_mean", sql(CORPUS_SQL, WORD_VECTORS_SQL, DOCVEC_SQL, DOCVEC_FULL_SQL, body="""
SELECT doc_id, n_known, {cols} FROM docvec""".format(cols=", ".join(f"round(v{d}, 6) AS v{d}" for d in DIMS))))
def q_doc_vectors_mean(spark, sf):
    dv = _docvecs(spark, sf)
    return dv.select("doc_id", "n_known", *[r6(F.col("vec")[d]).alias(f"v{d}") for d in DIMS])


WIDE_DIM = 300


@register("doc_vectors_wide", sql(CORPUS_SQL, WORD_VECTORS_SQL.replace(f"range({WORD_VEC_DIM})", f"range({WIDE_DIM})"), f"""
pairs AS (SELECT doc_id, word, count(*) AS n FROM words GROUP BY doc_id, word),
parts AS (SELECT p.doc_id, p.n, unnest(v.vec) AS x, generate_subscripts(v.vec, 1) AS d FROM pairs p JOIN vectors v USING (word)),
sums AS (SELECT doc_id, d, sum(n * x)::BIGINT AS s FROM parts GROUP BY doc_id, d),
lists AS (SELECT doc_id, md5(string_agg(s::VARCHAR, ',' ORDER BY d)) AS sums_md5 FROM sums GROUP BY doc_id),
known AS (SELECT p.doc_id, sum(p.n)::BIGINT AS n_known FROM pairs p JOIN vectors v USING (word) GROUP BY p.doc_id)""", body="""
SELECT doc_id, coalesce(n_known, 0) AS n_known, sums_md5 FROM corpus LEFT JOIN known USING (doc_id) LEFT JOIN lists USING (doc_id)"""))
def q_doc_vectors_wide(spark, sf):
    """E2 at the size of real embeddings: mean times count of each of 300 integer components, as a digest."""
    dv = E.doc_vectors_blocked(fx.tokens(spark, sf), fx.word_vectors(spark, sf, WIDE_DIM), WIDE_DIM)
    sums = F.transform("vec", lambda x: F.round(x * F.col("n_known")).cast("long").cast("string"))
    return dv.select("doc_id", "n_known", F.md5(F.array_join(sums, ",")).alias("sums_md5"))


@register("embedding_matrix", sql(CORPUS_SQL, VOCAB_SQL, WORD_VECTORS_SQL, body="""
SELECT g.idx, v.word, {cols}
FROM (SELECT range::INTEGER AS idx FROM range(10000)) g
LEFT JOIN vocab v USING (idx) LEFT JOIN vectors w USING (word)""".format(
    cols=", ".join(f"coalesce(w.vec[{d + 1}]::DOUBLE, 0.0) AS v{d}" for d in DIMS))))
def q_embedding_matrix(spark, sf):
    m = E.embedding_matrix(_train_vocab(spark, sf), fx.word_vectors(spark, sf), MAX_WORDS, WORD_VEC_DIM)
    return m.select("idx", "word", *[F.col("vec")[d].alias(f"v{d}") for d in DIMS])


@register("embedding_coverage", sql(CORPUS_SQL, WORD_VECTORS_SQL, """
wc AS (SELECT word, count(*) AS n FROM words GROUP BY word)""", body="""
SELECT count(*) AS n_words, count(v.word) AS n_words_covered, sum(n)::BIGINT AS n_tokens,
       sum(CASE WHEN v.word IS NOT NULL THEN n ELSE 0 END)::BIGINT AS n_tokens_covered,
       round(count(v.word)::DOUBLE / count(*), 6) AS word_coverage,
       round(sum(CASE WHEN v.word IS NOT NULL THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS token_coverage
FROM wc LEFT JOIN vectors v USING (word)"""))
def q_embedding_coverage(spark, sf):
    c = E.embedding_coverage(fx.tokens(spark, sf), fx.word_vectors(spark, sf))
    return c.select("n_words", "n_words_covered", "n_tokens", "n_tokens_covered",
                    r6("word_coverage").alias("word_coverage"), r6("token_coverage").alias("token_coverage"))


@register("l2_normalize", """
WITH e AS (
  SELECT vec_id, embedding,
         sqrt(list_reduce(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE), lambda a, b: a + b)) AS norm
  FROM embeddings),
u AS (SELECT vec_id, norm, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1)::INTEGER AS dim
      FROM e)
SELECT vec_id, dim, round(CASE WHEN norm > 0 THEN x / norm ELSE 0.0 END, 6) AS value FROM u""")
def q_l2_normalize(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    n = E.normalize_rows(emb, "embedding", "vec_l2")
    return n.select("vec_id", F.posexplode("vec_l2").alias("dim", "value")).select(
        "vec_id", "dim", r6("value").alias("value"))


# =============================================================== evaluate
CONF_SQL = """
lab AS (SELECT DISTINCT model_name, y FROM (SELECT model_name, y_true AS y FROM preds
                                            UNION ALL SELECT model_name, y_pred FROM preds)),
cnt AS (SELECT model_name, y_true, y_pred, count(*) AS n FROM preds GROUP BY ALL),
conf AS (SELECT a.model_name, a.y AS y_true, b.y AS y_pred, coalesce(c.n, 0) AS n
         FROM lab a JOIN lab b USING (model_name)
         LEFT JOIN cnt c ON c.model_name = a.model_name AND c.y_true = a.y AND c.y_pred = b.y)"""
METRICS_SQL = """
st AS (SELECT model_name, cls, sum(tp) AS tp, sum(sup) AS support, sum(prd) AS predicted FROM (
         SELECT model_name, y_true AS cls, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp, n AS sup, 0 AS prd
         FROM conf
         UNION ALL SELECT model_name, y_pred AS cls, 0 AS tp, 0 AS sup, n AS prd FROM conf) GROUP BY ALL),
pm AS (SELECT model_name, cls, support::BIGINT AS support,
              CASE WHEN predicted = 0 THEN 0.0 ELSE tp::DOUBLE / predicted::DOUBLE END AS precision,
              CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support::DOUBLE END AS recall,
              CASE WHEN support + predicted = 0 THEN 0.0
                   ELSE (2 * tp)::DOUBLE / (support + predicted)::DOUBLE END AS f1_score
       FROM st),
acc AS (SELECT model_name, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE AS accuracy
        FROM conf GROUP BY ALL),
results AS (SELECT a.model_name, round_even(a.accuracy, 4) AS accuracy, round_even(avg(pm.f1_score), 4) AS f1
            FROM acc a JOIN pm USING (model_name) GROUP BY a.model_name, a.accuracy)"""
REPORT_SQL = """
report AS (
  SELECT pm.model_name, c.label AS class, pm.precision, pm.recall, pm.f1_score, pm.support,
         pm.cls::INTEGER AS row_order
  FROM pm LEFT JOIN codes c ON c.code = pm.cls
  UNION ALL
  SELECT pm.model_name, 'accuracy', NULL, NULL, any_value(a.accuracy), sum(pm.support)::BIGINT, count(*)::INTEGER
  FROM pm JOIN acc a USING (model_name) GROUP BY pm.model_name
  UNION ALL
  SELECT model_name, 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support)::BIGINT,
         (count(*) + 1)::INTEGER FROM pm GROUP BY model_name
  UNION ALL
  SELECT model_name, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
         sum(f1_score * support) / sum(support), sum(support)::BIGINT, (count(*) + 2)::INTEGER
  FROM pm GROUP BY model_name)"""
EVAL_CTES = (CORPUS_SQL, PREDICTIONS_SQL, CONF_SQL, METRICS_SQL)


def _conf(spark, sf, runs=None) -> DataFrame:
    return V.confusion_long(fx.predictions(spark, sf, runs), ["model_name"])


def _names(spark, sf) -> DataFrame:
    return fx.codes(spark, sf)


def _results(spark, sf, runs=None) -> DataFrame:
    return V.accuracy_f1(_conf(spark, sf, runs), ["model_name"])


def _reports(spark, sf) -> DataFrame:
    return V.classification_report(_conf(spark, sf), _names(spark, sf), ["model_name"])


@register("confusion_matrix", sql(*EVAL_CTES, body="SELECT model_name, y_true, y_pred, n FROM conf"))
def q_confusion_matrix(spark, sf):
    return _conf(spark, sf)


@register("accuracy_macro_f1", sql(*EVAL_CTES, body="SELECT model_name, accuracy, f1 FROM results"))
def q_accuracy_macro_f1(spark, sf):
    return _results(spark, sf)


@register("classification_report", sql(*EVAL_CTES, REPORT_SQL, body="""
SELECT model_name, class, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1_score, 6) AS f1_score, support, row_order FROM report"""))
def q_classification_report(spark, sf):
    r = _reports(spark, sf)
    return r.select("model_name", "class", r6("precision").alias("precision"), r6("recall").alias("recall"),
                    r6("f1_score").alias("f1_score"), "support", "row_order")


@register("confusion_matrix_dense", sql(*EVAL_CTES, body="""
SELECT conf.model_name, ta.label AS actual, {cols}
FROM conf JOIN codes ta ON ta.code = conf.y_true JOIN codes pa ON pa.code = conf.y_pred
GROUP BY conf.model_name, ta.label""".format(
    cols=", ".join(f"coalesce(sum(n) FILTER (WHERE pa.label = '{c}'), 0)::BIGINT AS {c}" for c in CORPUS_CLASSES))))
def q_confusion_matrix_dense(spark, sf):
    names = _names(spark, sf)
    return V.confusion_dense(_conf(spark, sf), names, fx.class_names(spark, sf, names), ["model_name"])


@register("confusion_rollup", sql(*EVAL_CTES, body="""
SELECT split_part(model_name, '-', 1) AS model, y_true, y_pred, sum(n)::BIGINT AS n FROM conf GROUP BY ALL"""))
def q_confusion_rollup(spark, sf):
    conf = _conf(spark, sf).withColumn("model", F.split("model_name", "-", 2)[0])
    return V.confusion_rollup(conf, ["model"])


EMB_SQL = "CASE WHEN strpos(model_name, '-') > 0 THEN substr(model_name, strpos(model_name, '-') + 1) END"


@register("leaderboard_by_model", sql(*EVAL_CTES, body="""
SELECT split_part(model_name, '-', 1) AS model, round(avg(accuracy * 100.0), 6) AS accuracy,
       round(avg(f1 * 100.0), 6) AS f1, count(*) AS n_runs FROM results GROUP BY ALL"""))
def q_leaderboard_by_model(spark, sf):
    lb = V.leaderboard(_results(spark, sf), "model")
    return lb.select("model", r6("accuracy").alias("accuracy"), r6("f1").alias("f1"), "n_runs")


@register("leaderboard_by_embedding", sql(*EVAL_CTES, body=f"""
SELECT {EMB_SQL} AS embedding, round(avg(accuracy * 100.0), 6) AS accuracy,
       round(avg(f1 * 100.0), 6) AS f1, count(*) AS n_runs FROM results GROUP BY ALL"""))
def q_leaderboard_by_embedding(spark, sf):
    lb = V.leaderboard(_results(spark, sf), "embedding")
    return lb.select("embedding", r6("accuracy").alias("accuracy"), r6("f1").alias("f1"), "n_runs")


@register("class_metric_pivot", sql(*EVAL_CTES, REPORT_SQL, f"""
rep AS (SELECT split_part(model_name, '-', 1) AS model, {EMB_SQL} AS emb, class, f1_score
        FROM report WHERE class IN ({", ".join(f"'{c}'" for c in CORPUS_CLASSES)}))""", """
wide AS (SELECT class, {cols} FROM rep WHERE model = 'xgb' GROUP BY class)""".format(
    cols=", ".join(f"any_value(f1_score) FILTER (WHERE emb = '{e}') AS {e}" for e in EMBEDDINGS)), body="""
SELECT class, {cols}, round(least({mins}) - 0.15, 6) AS axis_floor FROM wide""".format(
    cols=", ".join(f"round({e}, 6) AS {e}" for e in EMBEDDINGS),
    mins=", ".join(f"min({e}) OVER ()" for e in EMBEDDINGS))))
def q_class_metric_pivot(spark, sf):
    classes = fx.class_names(spark, sf)
    p = V.class_metric_pivot(_reports(spark, sf), PIVOT_MODEL, PIVOT_METRIC, EMBEDDINGS, classes)
    return p.select("class", *[r6(e).alias(e) for e in EMBEDDINGS], r6("axis_floor").alias("axis_floor"))


@register("model_accuracy_lookup", sql(*EVAL_CTES, body=f"""
SELECT model_name, accuracy FROM results WHERE model_name = '{LOOKUP_RUN}'"""))
def q_model_accuracy_lookup(spark, sf):
    return V.model_accuracy(_results(spark, sf), LOOKUP_RUN)


def _rerun_sql() -> str:
    """Results of the re-runs (``RERUNS``) under CTE ``results2``."""
    p2 = fx.predictions_sql(fx.RERUNS, out="preds2")
    conf2 = CONF_SQL.replace("preds", "preds2").replace("lab ", "lab2 ").replace("lab a", "lab2 a") \
        .replace("lab b", "lab2 b").replace("cnt ", "cnt2 ").replace("cnt c", "cnt2 c").replace("conf AS", "conf2 AS")
    m2 = (METRICS_SQL.replace("FROM conf", "FROM conf2").replace("st AS", "st2 AS").replace("FROM st)", "FROM st2)")
          .replace("pm AS", "pm2 AS").replace("JOIN pm ", "JOIN pm2 pm ").replace("acc AS", "acc2 AS")
          .replace("FROM acc a", "FROM acc2 a").replace("results AS", "results2 AS"))
    return ",\n".join([p2.strip(), conf2.strip(), m2.strip()])


PARAMS_EXPR_SQL = ("'{''C'': ' || (['0.1', '1.0', '10.0', '20.0'])[1 + (floor(accuracy * 1000)::INTEGER % 4)]"
                   " || ', ''kernel'': ''rbf''}'")


def _params(results: DataFrame) -> DataFrame:
    grid = F.array(*[F.lit(c) for c in ["0.1", "1.0", "10.0", "20.0"]])
    pick = F.element_at(grid, (F.floor(F.col("accuracy") * 1000).cast("int") % 4 + 1))
    return results.select("model_name", F.concat(F.lit("{'C': "), pick, F.lit(", 'kernel': 'rbf'}")).alias("params"))


# =============================================================== errors
RUN_PREDS_SQL = f"pr AS (SELECT doc_id, y_true, y_pred FROM preds WHERE model_name = '{fx.ANALYSED_RUN}')"


def _run_preds(spark, sf) -> DataFrame:
    run = [r for r in fx.RUNS if r[0] == fx.ANALYSED_RUN]  # only this run is generated
    return fx.predictions(spark, sf, run).drop("model_name")


def _decode_pair(df: DataFrame, names: DataFrame) -> DataFrame:
    n = F.broadcast(names)
    return (df.join(n.select(F.col("code").alias("y_pred"), F.col("label").alias("pred_class")), "y_pred", "left")
            .join(n.select(F.col("code").alias("y_true"), F.col("label").alias("true_class")), "y_true", "left"))


@register("misclassified_sample", sql(CORPUS_SQL, PREDICTIONS_SQL, RUN_PREDS_SQL, """
pick AS (SELECT y_pred, y_true, arg_min(doc_id, md5('42-' || doc_id)) AS doc_id FROM pr GROUP BY ALL)""", body="""
SELECT pn.label AS pred_class, tn.label AS true_class, p.doc_id, array_to_string(t.tokens, ' ') AS text
FROM pick p JOIN tok t USING (doc_id) JOIN codes pn ON pn.code = p.y_pred JOIN codes tn ON tn.code = p.y_true"""))
def q_misclassified_sample(spark, sf):
    ms = X.misclassified_sample(_run_preds(spark, sf), fx.tokens(spark, sf), seed="42")
    return _decode_pair(ms, _names(spark, sf)).select("pred_class", "true_class", "doc_id", "text")


TOPWORDS_SQL = """
wc AS (SELECT p.y_pred, p.y_true, w.word, count(*) AS n, min(w.doc_id::HUGEINT * 2147483648 + w.pos) AS fs
       FROM words w JOIN pr p USING (doc_id) GROUP BY ALL),
top AS (SELECT y_pred, y_true, (row_number() OVER (PARTITION BY y_pred, y_true ORDER BY n DESC, fs))::INTEGER AS rank,
               word, n FROM wc
        QUALIFY row_number() OVER (PARTITION BY y_pred, y_true ORDER BY n DESC, fs) <= 15)"""


def _top_words(spark, sf, preds: DataFrame | None = None) -> DataFrame:
    # join the predictions per document (one row each), then explode the tokens
    docs = fx.tokens(spark, sf).join(_run_preds(spark, sf) if preds is None else preds, "doc_id")
    ex = X.explode_tokens(docs, ["doc_id", "y_pred", "y_true"])
    return X.top_words(ex, ["y_pred", "y_true"], TOP_N_WORDS)


@register("common_words", sql(CORPUS_SQL, PREDICTIONS_SQL, RUN_PREDS_SQL, TOPWORDS_SQL, body="""
SELECT pn.label AS pred_class, tn.label AS true_class, t.rank, t.word, t.n
FROM top t JOIN codes pn ON pn.code = t.y_pred JOIN codes tn ON tn.code = t.y_true"""))
def q_common_words(spark, sf):
    return _decode_pair(_top_words(spark, sf), _names(spark, sf)).select(
        "pred_class", "true_class", "rank", "word", "n")


@register("compare_classes", sql(CORPUS_SQL, PREDICTIONS_SQL, RUN_PREDS_SQL, TOPWORDS_SQL, f"""
named AS (SELECT pn.label AS pred_class, tn.label AS true_class, t.rank, t.word, t.n
          FROM top t JOIN codes pn ON pn.code = t.y_pred JOIN codes tn ON tn.code = t.y_true)""", f"""
inc AS (SELECT rank, word, n FROM named WHERE pred_class = '{CMP_PRED}' AND true_class = '{CMP_TRUE}')""", f"""
cor AS (SELECT rank, word, n FROM named WHERE pred_class = '{CMP_TRUE}' AND true_class = '{CMP_TRUE}')""", body="""
SELECT coalesce(inc.rank, cor.rank) AS rank, inc.word AS incorrect_word, inc.n AS incorrect_n,
       cor.word AS correct_word, cor.n AS correct_n
FROM inc FULL OUTER JOIN cor ON inc.rank = cor.rank"""))
def q_compare_classes(spark, sf):
    # the two pairs are picked from the predictions, so only their documents are tokenized
    names = _names(spark, sf)
    code = {r["label"]: r["code"] for r in names.collect()}  # k rows
    preds = _run_preds(spark, sf).filter((F.col("y_true") == code.get(CMP_TRUE, -1)) & F.col("y_pred").isin(code.get(CMP_PRED, -1), code.get(CMP_TRUE, -1)))
    named = _decode_pair(_top_words(spark, sf, preds), names)
    inc = named.filter((F.col("pred_class") == CMP_PRED) & (F.col("true_class") == CMP_TRUE))
    cor = named.filter((F.col("pred_class") == CMP_TRUE) & (F.col("true_class") == CMP_TRUE))
    return X.compare_classes(inc, cor)


WDIST_TF_SQL = f"""
tf AS (SELECT word, {_classes_sql("label")}, count(*) AS total FROM words GROUP BY word)"""


@register("word_distribution_tf", sql(CORPUS_SQL, WDIST_TF_SQL, body="SELECT * FROM tf"))
def q_word_distribution_tf(spark, sf):
    classes = fx.class_names(spark, sf)
    return X.word_class_counts(fx.tokens(spark, sf), "label", classes)


@register("word_distribution_df", sql(CORPUS_SQL, """
dw AS (SELECT DISTINCT doc_id, label, word FROM words)""", body=f"""
SELECT word, {_classes_sql("label")}, count(*) AS total FROM dw GROUP BY word"""))
def q_word_distribution_df(spark, sf):
    classes = fx.class_names(spark, sf)
    return X.word_class_counts(fx.tokens(spark, sf), "label", classes, unique_only=True)


@register("word_distribution_classes", sql(CORPUS_SQL, f"""
sel AS (SELECT word, {_classes_sql("label")}, count(*) AS total FROM words
        WHERE label IN ({", ".join(f"'{c}'" for c in SELECTED_CLASSES)}) GROUP BY word)""", body="""
SELECT v.word, {cols}, coalesce(s.total, 0) AS total
FROM (SELECT DISTINCT word FROM words) v LEFT JOIN sel s USING (word)""".format(
    cols=", ".join(f"coalesce(s.{c}, 0) AS {c}" for c in CORPUS_CLASSES))))
def q_word_distribution_classes(spark, sf):
    classes = fx.class_names(spark, sf)
    return X.word_distribution_for_classes(fx.tokens(spark, sf), "label", classes, SELECTED_CLASSES)


@register("word_rank_slice", sql(CORPUS_SQL, WDIST_TF_SQL, body=f"""
SELECT (row_number() OVER (ORDER BY total DESC, word))::INTEGER AS rank, * FROM tf
QUALIFY row_number() OVER (ORDER BY total DESC, word) > {SLICE_START}
    AND row_number() OVER (ORDER BY total DESC, word) <= {SLICE_END}"""))
def q_word_rank_slice(spark, sf):
    classes = fx.class_names(spark, sf)
    tf = X.word_class_counts(fx.tokens(spark, sf), "label", classes)
    return X.rank_slice(tf, [F.desc("total"), F.asc("word")], SLICE_START, SLICE_END)


ATTR_W_SQL = """
att AS (SELECT a.*, ('0x' || substr(md5('42-' || a.doc_id), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u,
               ('0x' || substr(md5('42-display-' || a.doc_id), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS ud
        FROM attr a),
aw AS (SELECT y_pred, CASE WHEN weight > 0 THEN 'pos' ELSE 'neg' END AS polarity, doc_id, pos, word, weight,
              ud < 10.0::DOUBLE / (SELECT count(*) FROM preds WHERE model_name = 'xgb-glove') AS is_display
       FROM att WHERE u < 0.05 AND abs(weight) >= 1.0 AND weight <> 0)"""


def _attr_weights(spark, sf) -> DataFrame:
    # display rate = n_samples / number of documents of the run (a doc_id-only scan)
    n_docs = _run_preds(spark, sf).count()
    return X.attribution_weights(fx.attributions(spark, sf), data_prop=0.05, threshold=1.0,
                                 correct=None, n_samples=10, seed="42", n_docs=n_docs)


@register("attribution_weights", sql(CORPUS_SQL, PREDICTIONS_SQL, ATTRIBUTIONS_SQL, ATTR_W_SQL, body="""
SELECT c.label AS pred_class, aw.polarity, aw.doc_id, aw.pos, aw.word, aw.weight, aw.is_display
FROM aw JOIN codes c ON c.code = aw.y_pred"""))
def q_attribution_weights(spark, sf):
    w = _attr_weights(spark, sf)
    names = F.broadcast(_names(spark, sf).select(F.col("code").alias("y_pred"), F.col("label").alias("pred_class")))
    return w.join(names, "y_pred").select("pred_class", "polarity", "doc_id", "pos", "word", "weight", "is_display")


@register("attribution_top_words", sql(CORPUS_SQL, PREDICTIONS_SQL, ATTRIBUTIONS_SQL, ATTR_W_SQL, body=f"""
SELECT c.label AS pred_class, t.polarity, t.rank, t.word, t.weight, t.doc_id, t.pos
FROM (SELECT y_pred, polarity,
             (row_number() OVER (PARTITION BY y_pred, polarity ORDER BY abs(weight) DESC, doc_id, pos))::INTEGER
               AS rank, word, weight, doc_id, pos
      FROM aw
      QUALIFY row_number() OVER (PARTITION BY y_pred, polarity ORDER BY abs(weight) DESC, doc_id, pos)
              <= {ATTR_TOP_N}) t
JOIN codes c ON c.code = t.y_pred"""))
def q_attribution_top_words(spark, sf):
    top = X.attribution_top_words(_attr_weights(spark, sf), ATTR_TOP_N)
    names = F.broadcast(_names(spark, sf).select(F.col("code").alias("y_pred"), F.col("label").alias("pred_class")))
    return top.join(names, "y_pred").select("pred_class", "polarity", "rank", "word", "weight", "doc_id", "pos")


# ------------------------------------------------- attributions of a fitted model
CENTROID_SQL = """
cen AS (SELECT c.code, {means} FROM docvec JOIN coded c USING (doc_id) WHERE n_known > 0 GROUP BY c.code),
cs AS (SELECT d.doc_id, cen.code, {dot} - ({norm}) / 2 AS score FROM docvec d, cen WHERE n_known > 0),
best AS (SELECT doc_id, code AS y_pred, score FROM cs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code) = 1),
tw AS (SELECT w.doc_id, w.pos, w.word, ({tokdot}) / d.n_known AS weight, c.code AS y_true, b.y_pred, b.score, -({norm}) / 2 AS intercept
       FROM words w JOIN vectors v USING (word) JOIN docvec d USING (doc_id) JOIN coded c USING (doc_id) JOIN best b USING (doc_id) JOIN cen ON cen.code = b.y_pred)""".format(
    means=", ".join(f"avg(v{d}) AS m{d}" for d in DIMS), dot=" + ".join(f"d.v{d} * cen.m{d}" for d in DIMS),
    norm=" + ".join(f"cen.m{d} * cen.m{d}" for d in DIMS), tokdot=" + ".join(f"v.vec[{d + 1}]::DOUBLE * cen.m{d}" for d in DIMS))
FITTED_THRESHOLD = 0.01


def _fitted_contributions(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Token contributions under coefficients fitted on the document vectors, stored as a table and read back."""
    coded = fx.coded_tokens(spark, sf)
    vectors = written(fx.word_vectors(spark, sf), "word-vectors")
    docs = E.doc_vectors_mean(coded, vectors, WORD_VEC_DIM, keep=["code"])
    coefficients = written(fit_centroids(docs), "coefficients")
    return token_contributions(coded, vectors, coefficients), coefficients


FITTED_CTES = (CORPUS_SQL, WORD_VECTORS_SQL, DOCVEC_SQL, DOCVEC_FULL_SQL, CENTROID_SQL)


@register("fitted_attribution_scores", sql(*FITTED_CTES, body="""
SELECT doc_id, y_true, y_pred, count(*) AS n_tokens, round(any_value(score), 6) AS score, round(any_value(score), 6) AS contributions FROM tw GROUP BY doc_id, y_true, y_pred"""))
def q_fitted_attribution_scores(spark, sf):
    """The token contributions and the intercept of every document sum to the score of its predicted class."""
    tokens, coefficients = _fitted_contributions(spark, sf)
    intercept = coefficients.filter("position = -1").select(F.col("class").alias("y_pred"), F.col("coefficient").alias("b"))
    sums = tokens.groupBy("doc_id", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n_tokens"), F.max("score").alias("score"), F.sum("weight").alias("w"))
    return sums.join(F.broadcast(intercept), "y_pred").select("doc_id", "y_true", "y_pred", "n_tokens", r6("score").alias("score"), r6(F.col("w") + F.col("b")).alias("contributions"))


def _fitted_mode(correct: bool):
    sign = "=" if correct else "<>"

    @register(f"fitted_attributions_{'correct' if correct else 'incorrect'}", sql(*FITTED_CTES, body=f"""
SELECT doc_id, pos, word, y_true, y_pred, CASE WHEN weight > 0 THEN 'pos' ELSE 'neg' END AS polarity, round(weight, 6) AS weight
FROM tw WHERE ('0x' || substr(md5('42-' || doc_id), 1, 8))::BIGINT::DOUBLE / 4294967296.0 < 0.05 AND abs(weight) >= {FITTED_THRESHOLD} AND y_pred {sign} y_true"""))
    def run(spark, sf):
        """X9 + X10 for correctly / incorrectly classified documents: weights of a fitted linear model."""
        tokens, _ = _fitted_contributions(spark, sf)
        out = X.attribution_weights(tokens, data_prop=0.05, threshold=FITTED_THRESHOLD, correct=correct, n_docs=1)
        return out.select("doc_id", "pos", "word", "y_true", "y_pred", "polarity", r6("weight").alias("weight"))

    return run


q_fitted_attributions_correct, q_fitted_attributions_incorrect = _fitted_mode(True), _fitted_mode(False)


# =============================================================== scoring
SCORES_SQL = """
wide AS (SELECT code, {ws} FROM weights GROUP BY code)""".format(
    ws=", ".join(f"any_value(w) FILTER (WHERE d = {d}) AS w{d}" for d in DIMS)) + """,
sc AS (SELECT dv.doc_id, dv.n_known, wide.code, {expr} AS score
       FROM docvec dv CROSS JOIN wide WHERE dv.n_known > 0)""".format(
    expr=" + ".join(f"v{d} * w{d}" for d in DIMS)) + """,
best AS (SELECT doc_id, code AS y_pred, score FROM sc
         QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, code) = 1)"""


def _scored(spark, sf) -> DataFrame:
    weights = fx.class_weight_rows(spark, sf)
    return linear_scores(_docvecs(spark, sf), weights)


@register("linear_scores", sql(CORPUS_SQL, WORD_VECTORS_SQL, DOCVEC_SQL, DOCVEC_FULL_SQL, WEIGHTS_SQL, SCORES_SQL,
                               body="""
SELECT b.doc_id, b.y_pred::INTEGER AS y_pred, round(b.score, 6) + 0.0 AS best_score FROM best b"""))
def q_linear_scores(spark, sf):
    """Documents with at least one known word (a null vector has no score)."""
    s = _scored(spark, sf).filter(F.col("n_known") > 0)
    return s.select("doc_id", "y_pred", (r6(F.array_max("scores")) + F.lit(0.0)).alias("best_score"))


@register("argmax_decode", sql(CORPUS_SQL, WORD_VECTORS_SQL, DOCVEC_SQL, DOCVEC_FULL_SQL, WEIGHTS_SQL, SCORES_SQL,
                               """
mx AS (SELECT doc_id, max(score) AS m FROM sc GROUP BY doc_id)""", """
pr AS (SELECT sc.doc_id, sc.code, exp(sc.score - mx.m) / sum(exp(sc.score - mx.m)) OVER (PARTITION BY sc.doc_id) AS p
       FROM sc JOIN mx USING (doc_id))""", """
bp AS (SELECT doc_id, code, p FROM pr QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, code) = 1)""",
                               body="""
SELECT bp.doc_id, bp.code::INTEGER AS y_pred, round(bp.p, 6) AS p_max FROM bp"""))
def q_argmax_decode(spark, sf):
    s = _scored(spark, sf).filter(F.col("n_known") > 0).withColumn("probs", softmax("scores"))
    from lexis.operators.scoring import argmax_decode
    d = argmax_decode(s.drop("y_pred"), "probs")
    return d.select("doc_id", "y_pred", r6(F.array_max("probs")).alias("p_max"))


# =============================================================== more single operators
@register("word_table_empty", sql(CORPUS_SQL, body="""
SELECT word, {zeros} FROM (SELECT DISTINCT word FROM words)""".format(
    zeros=", ".join(f"0::BIGINT AS {c}" for c in CORPUS_CLASSES))))
def q_word_table_empty(spark, sf):
    """The vocabulary with a zero column per class."""
    return X.empty_word_table(fx.tokens(spark, sf), fx.class_names(spark, sf))


@register("pair_predictions", sql(CORPUS_SQL, PREDICTIONS_SQL, RUN_PREDS_SQL, body=f"""
SELECT doc_id, y_true, y_pred FROM pr
WHERE y_pred = (SELECT code FROM codes WHERE label = '{CMP_PRED}')
  AND y_true = (SELECT code FROM codes WHERE label = '{CMP_TRUE}')"""))
def q_pair_predictions(spark, sf):
    """Predictions of one (predicted, true) class pair."""
    code = {r["label"]: r["code"] for r in _names(spark, sf).collect()}
    return X.pair_filter(_run_preds(spark, sf), code[CMP_PRED], code[CMP_TRUE]).select("doc_id", "y_true", "y_pred")


@register("report_layout", sql(*EVAL_CTES, REPORT_SQL, body="""
SELECT CASE WHEN class <> 'accuracy' THEN class END AS class,
       CASE WHEN class <> 'accuracy' THEN round(precision, 6) END AS precision,
       CASE WHEN class <> 'accuracy' THEN round(recall, 6) END AS recall,
       CASE WHEN class <> 'accuracy' THEN round(f1_score, 6) END AS "f1-score",
       CASE WHEN class <> 'accuracy' THEN support::DOUBLE END AS support,
       CASE WHEN class = 'accuracy' THEN round(f1_score, 6) END AS accuracy
FROM report WHERE model_name = 'svm-word2vec'"""))
def q_report_layout(spark, sf):
    """K4: one run's report in the stored file layout (accuracy row carries only ``accuracy``)."""
    from lexis.sinks.writers import report_file_layout
    conf = _conf(spark, sf).filter(F.col("model_name") == "svm-word2vec").drop("model_name")
    lay = report_file_layout(V.classification_report(conf, _names(spark, sf)))
    return lay.select("class", *[r6(F.col(f"`{c}`")).alias(c) for c in ["precision", "recall", "f1-score"]],
                      "support", r6("accuracy").alias("accuracy"))


@register("approximate_sample", sql(CORPUS_SQL, body="""
SELECT doc_id, label FROM corpus
WHERE ('0x' || substr(md5('42-' || doc_id), 1, 8))::BIGINT::DOUBLE / 4294967296.0 < 0.075"""))
def q_approximate_sample(spark, sf):
    """P4 (approximate form): seeded md5 filter, no job, no shuffle."""
    from lexis.operators.sampling import approx_sample
    return approx_sample(fx.corpus(spark, sf), P.SAMPLE_RATE, seed=SAMPLE_SEED).select("doc_id", "label")
