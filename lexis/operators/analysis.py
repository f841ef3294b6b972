"""Error analysis: word distributions, top words, misclassified samples, attributions.

(X1-X11, A7, O1-O4.)  Word tables are one ``explode -> groupBy`` with a
conditional count per class column and a single shuffle on the word (partial aggregation map-side, so a hot
word such as "the" costs one row per map task, not one per occurrence).
Top-n per group uses ``row_number() <= n``, which Spark plans with a
partial ``WindowGroupLimit`` before the shuffle: a dominant group sends at
most n rows per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexis.functions.arrays import hex_int, seeded_key, unit_interval
from lexis.functions.text import join_tokens

# first-appearance order key: doc_id * 2**31 + position, as a decimal (array positions stay below 2**31)
POS_RANGE = 1 << 31


def explode_words(df: DataFrame, keep: list[str], tokens_col: str = "tokens",
                  with_pos: bool = False) -> DataFrame:
    """``keep..., [pos,] word`` - one row per token occurrence.

    Uses the *outer* generator plus a ``word IS NOT NULL`` filter: a plain
    ``explode`` makes Catalyst infer ``size(tokens) > 0`` and push it below
    the projection (and below a repartition), which evaluates the regex
    tokenizer a second time per document.
    """
    if with_pos:
        gen = F.posexplode_outer(tokens_col).alias("pos", "word")
    else:
        gen = F.explode_outer(tokens_col).alias("word")
    return df.select(*keep, gen).filter(F.col("word").isNotNull())


def explode_tokens(df: DataFrame, keep: list[str], tokens_col: str = "tokens") -> DataFrame:
    """``keep..., pos, word`` - one row per token occurrence."""
    return explode_words(df, keep, tokens_col, with_pos=True)


def first_seen_key(doc_col: str = "doc_id", pos_col: str = "pos"):
    """Single decimal ordering key (doc order, then position) for every bigint key - keeps aggregates on HashAggregate."""
    return (F.col(doc_col).cast("decimal(20,0)") * F.lit(POS_RANGE).cast("decimal(10,0)")
            + F.col(pos_col).cast("decimal(10,0)"))


def vocabulary(tokens: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Distinct words (sorted when displayed)."""
    return explode_words(tokens, [], tokens_col).distinct()


def empty_word_table(tokens: DataFrame, classes: list[str], tokens_col: str = "tokens") -> DataFrame:
    """Every vocabulary word with a zero column per class (filled by X5-X7)."""
    zeros = [F.lit(0).cast("long").alias(c) for c in classes]
    return vocabulary(tokens, tokens_col).select("word", *zeros)


def word_class_counts(tokens: DataFrame, class_col: str, classes: list[str],
                      unique_only: bool = False, tokens_col: str = "tokens",
                      doc_col: str = "doc_id") -> DataFrame:
    """``word, <class>..., total`` - term (or document) frequency per class.

    ``classes`` are the pivot values, passed explicitly (no distinct job, fixed
    column order); classes without a word get 0.
    """
    if unique_only:
        # a document's tokens live in one row: de-duplicate there (no shuffle)
        tokens = tokens.withColumn(tokens_col, F.array_distinct(tokens_col))
    words = explode_words(tokens, [doc_col, class_col], tokens_col)
    # one hash aggregate with a conditional count per class (Spark's pivot would
    # plan a second aggregation to re-shape (word, class) rows)
    per_class = [F.count(F.when(F.col(class_col) == F.lit(c), 1)).alias(c) for c in classes]
    wide = words.groupBy("word").agg(*per_class)
    total = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    return wide.withColumn("total", total.cast("long"))


def word_distribution_for_classes(tokens: DataFrame, class_col: str, classes: list[str],
                                  selected: list[str], unique_only: bool = False,
                                  tokens_col: str = "tokens") -> DataFrame:
    """Counts over documents of ``selected`` classes only; every vocabulary word and
    every class column stays (zeros elsewhere).

    One aggregation over all words (so the whole vocabulary is present) whose
    class counts only see the selected classes - no second pass, no join.
    """
    if unique_only:
        tokens = tokens.withColumn(tokens_col, F.array_distinct(tokens_col))
    words = explode_words(tokens, ["doc_id", class_col], tokens_col)
    chosen = set(selected) if selected else set(classes)
    per_class = [(F.count(F.when(F.col(class_col) == F.lit(c), 1)) if c in chosen
                  else F.lit(0).cast("long")).alias(c) for c in classes]
    wide = words.groupBy("word").agg(*per_class)
    total = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    return wide.withColumn("total", total.cast("long")).select("word", *classes, "total")


def rank_slice(df: DataFrame, order_cols: list, start: int, end: int) -> DataFrame:
    """O3: rows ``[start, end)`` of a total order, with a 1-based ``rank``.

    Plans as a bounded TakeOrderedAndProject (``end`` rows) - never a
    global window over the whole table.
    """
    top = df.orderBy(*order_cols).limit(end)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order_cols)))
    return ranked.filter(F.col("rank") > start)


def top_words(exploded: DataFrame, group_cols: list[str], n: int,
              doc_col: str = "doc_id") -> DataFrame:
    """A7 + O2 per group: ``group..., rank, word, n`` - most frequent first, ties by first appearance."""
    counts = exploded.groupBy(*group_cols, "word").agg(
        F.count(F.lit(1)).alias("n"), F.min(first_seen_key(doc_col)).alias("first_seen"))
    w = Window.partitionBy(*group_cols).orderBy(F.desc("n"), F.asc("first_seen"))
    return (counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .select(*group_cols, F.col("rank").cast("int").alias("rank"), "word", "n"))


def pair_filter(preds: DataFrame, pred_code: int, true_code: int,
                pred_col: str = "y_pred", true_col: str = "y_true") -> DataFrame:
    """Rows predicted as ``pred_code`` whose true class is ``true_code``."""
    return preds.filter((F.col(pred_col) == F.lit(pred_code)) & (F.col(true_col) == F.lit(true_code)))


def class_filter(df: DataFrame, codes: list[int], col: str = "y_true") -> DataFrame:
    """Keep rows of the listed classes; an empty list keeps everything."""
    return df.filter(F.col(col).isin(codes)) if codes else df


def misclassified_sample(preds: DataFrame, tokens: DataFrame, seed: str = "42",
                         pred_col: str = "y_pred", true_col: str = "y_true",
                         doc_col: str = "doc_id") -> DataFrame:
    """X1 for every (predicted, true) pair at once: one seeded-random document each.

    A plain aggregate over k*k groups - no window.  ``mins`` has at most one
    row per (predicted, true) pair, i.e. k*k rows: bounded, so it is broadcast.
    An absent pair simply has no row (the reference raises).
    """
    # hash aggregation on a 60-bit numeric prefix of the md5 key; the few rows
    # holding a group's minimal prefix are then resolved on the full key (exact)
    keyed = preds.withColumn("_k", seeded_key(seed, doc_col)).withColumn("_p", hex_int(F.col("_k"), 1, 15))
    mins = keyed.groupBy(pred_col, true_col).agg(F.min("_p").alias("_p"))
    tied = keyed.join(F.broadcast(mins), [pred_col, true_col, "_p"], "left_semi")
    pick = tied.groupBy(pred_col, true_col).agg(F.min_by(doc_col, "_k").alias(doc_col))
    # at most k*k picked documents: broadcast onto the corpus, so only they are tokenized and nothing is shuffled
    return (tokens.select(doc_col, "tokens").join(F.broadcast(pick), doc_col, "inner")
            .select(pred_col, true_col, doc_col, join_tokens("tokens").alias("text")))


def compare_classes(incorrect: DataFrame, correct: DataFrame) -> DataFrame:
    """Top words of two selections side by side, full outer join on rank.

    Inputs are ``rank, word, n`` tables; the shorter side gets nulls.
    """
    a = incorrect.select("rank", F.col("word").alias("incorrect_word"), F.col("n").alias("incorrect_n"))
    b = correct.select("rank", F.col("word").alias("correct_word"), F.col("n").alias("correct_n"))
    return a.join(b, "rank", "full_outer")


def attribution_weights(attr: DataFrame, data_prop: float = 0.05, threshold: float = 1.0,
                        correct: bool | None = None, n_samples: int = 10, seed: str = "42",
                        n_docs: int | None = None) -> DataFrame:
    """X9 + X10: filtered word attributions in long form.

    ``attr`` has ``doc_id, pos, word, weight, y_true, y_pred``.  Documents
    are sampled with probability ``data_prop`` (seeded md5 - no RNG state),
    optionally restricted to correct (True) / incorrect (False) predictions,
    and weights with ``|w| >= threshold`` are labelled ``pos``/``neg``.
    The reference groups them into per-class lists; a list per class is an
    unbounded group, so the result stays long, keyed by ``y_pred, polarity``.
    ``is_display`` marks the ~``n_samples`` documents kept for display; pass
    ``n_docs`` (the number of documents scored) to avoid counting ``attr``.
    """
    doc_key = seeded_key(seed, "doc_id")
    out = attr.filter(unit_interval(doc_key) < F.lit(data_prop))
    if correct is True:
        out = out.filter(F.col("y_pred") == F.col("y_true"))
    elif correct is False:
        out = out.filter(F.col("y_pred") != F.col("y_true"))
    out = out.filter(F.abs("weight") >= F.lit(threshold)).filter(F.col("weight") != 0)
    out = out.withColumn("polarity", F.when(F.col("weight") > 0, "pos").otherwise("neg"))
    if n_docs is None:
        n_docs = attr.select("doc_id").distinct().count()
    rate = n_samples / n_docs if n_docs else 0.0
    display = unit_interval(seeded_key(f"{seed}-display", "doc_id")) < F.lit(rate)
    return out.withColumn("is_display", display)


def attribution_top_words(weights: DataFrame, n: int = 30) -> DataFrame:
    """Strongest ``n`` words per (predicted class, polarity).

    Positive: largest weights first; negative: most negative first.
    """
    w = Window.partitionBy("y_pred", "polarity").orderBy(
        F.desc(F.abs("weight")), F.asc("doc_id"), F.asc("pos"))
    return (weights.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .select("y_pred", "polarity", F.col("rank").cast("int").alias("rank"), "word", "weight",
                    "doc_id", "pos"))
