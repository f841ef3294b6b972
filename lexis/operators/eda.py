"""Exploration operators: shape, class shares, text-length distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexis.functions.text import space_word_count, word_punct_tokens
from lexis.operators.sampling import exact_sample
from lexis.session import written

HISTOGRAM_BINS = 1000
CUMULATIVE_KS = (100, 300)
VOCAB_SAMPLE_RATE = 0.025


def corpus_shape(df: DataFrame) -> DataFrame:
    """A1: one row ``n_rows, n_cols``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_cols", F.lit(len(df.columns)).cast("int"))


def class_share(df: DataFrame, label_col: str = "label") -> DataFrame:
    """A2: ``label, n, share`` (normalised value counts), largest first.

    The grand total is a window over the k class rows, not over the data.
    """
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return (counts.withColumn("share", F.col("n") / total)
            .orderBy(F.desc("n"), F.asc(label_col)))


def with_word_count(df: DataFrame, text_col: str = "text", out_col: str = "n_words") -> DataFrame:
    """T5 over a table."""
    return df.withColumn(out_col, space_word_count(text_col))


def length_stats(df: DataFrame, len_col: str = "n_words") -> DataFrame:
    """A3: ``max_len, min_len, mean_len``."""
    return df.agg(F.max(len_col).alias("max_len"), F.min(len_col).alias("min_len"),
                  F.avg(len_col).alias("mean_len"))


def length_histogram(df: DataFrame, len_col: str = "n_words",
                     bins: int = HISTOGRAM_BINS) -> DataFrame:
    """A4: equal-width histogram with the last edge inclusive; all ``bins`` rows, zeros kept.

    The bin of ``x`` is the floor of ``(x - min) * bins / (max - min)``; a zero
    range puts everything in the middle bin (NumPy's +-0.5 range).  The data
    is read once, into a written table of the distinct lengths.
    """
    spark = df.sparkSession
    lengths = written(df.groupBy(F.col(len_col).alias("len")).agg(F.count(F.lit(1)).alias("n")), "lengths")
    stats = lengths.agg(F.min("len").alias("mn"), F.max("len").alias("mx")).collect()[0]
    if stats["mn"] is None:
        return spark.range(0).select(F.col("id").cast("int").alias("bin"),
                                     F.lit(0.0).alias("bin_lo"), F.lit(0.0).alias("bin_hi"),
                                     F.lit(0).cast("long").alias("n"))
    mn, mx = int(stats["mn"]), int(stats["mx"])
    x = F.col("len").cast("long")
    if mx > mn:
        b = F.least(F.floor((x - F.lit(mn)) * F.lit(bins) / F.lit(mx - mn)),
                    F.lit(bins - 1)).cast("int")
        first, width = float(mn), (mx - mn) / bins
    else:
        b = F.lit(bins // 2)
        first, width = mn - 0.5, 1.0 / bins
    counts = lengths.select(b.alias("bin"), "n").groupBy("bin").agg(F.sum("n").alias("n"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    edge = lambda i: i.cast("double") * F.lit(width) + F.lit(first)
    return (grid.join(F.broadcast(counts), "bin", "left")
            .select("bin", edge(F.col("bin")).alias("bin_lo"), edge(F.col("bin") + 1).alias("bin_hi"),
                    F.coalesce(F.col("n"), F.lit(0).cast("long")).alias("n")))


def length_frequency(df: DataFrame, len_col: str = "n_words") -> DataFrame:
    """A5: ``len, n, share, cum_share`` ordered by length.

    Aggregates to one row per distinct length first; the running sum is a
    window over those (bounded by the longest text), never over documents.
    """
    counts = df.groupBy(F.col(len_col).alias("len")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    running = F.sum("n").over(Window.orderBy("len").rowsBetween(Window.unboundedPreceding, 0))
    return (counts.withColumn("share", F.col("n") / total)
            .withColumn("cum_share", running / total).orderBy("len"))


def length_cumulative_share(df: DataFrame, len_col: str = "n_words",
                            ks: tuple[int, ...] = CUMULATIVE_KS) -> DataFrame:
    """Per ``k``: share of texts among the first ``k`` distinct lengths, and of length <= k.

    The reference's ``value_counts().sort_index()[:k]`` is positional (the
    first k distinct lengths); the comment reads it as ``length <= k``.
    Both are reported, named apart.
    """
    counts = written(df.groupBy(F.col(len_col).alias("len")).agg(F.count(F.lit(1)).alias("n")), "lengths")
    # the first max(ks) distinct lengths, once (a bounded top-n): the k-th of each k comes from it
    first = [r["len"] for r in counts.select("len").orderBy("len").limit(max(ks)).collect()]
    parts = []
    for k in ks:
        kth = int(first[min(k, len(first)) - 1]) if first else -1
        parts.append(counts.agg(
            F.lit(k).cast("int").alias("k"),
            (F.sum(F.when(F.col("len") <= F.lit(kth), F.col("n")).otherwise(0))
             / F.sum("n")).alias("share_first_k_lengths"),
            (F.sum(F.when(F.col("len") <= F.lit(k), F.col("n")).otherwise(0))
             / F.sum("n")).alias("share_len_le_k")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sample_vocabulary(df: DataFrame, text_col: str = "text", frac: float = VOCAB_SAMPLE_RATE,
                      seed: str = "42", tokenizer=word_punct_tokens) -> DataFrame:
    """Distinct tokens of an exact ``frac`` sample of the texts (``tokenizer``: ``word_punct_tokens`` or ``treebank_tokens``).

    The reference joins the sampled texts into one string before
    tokenizing; here each text is tokenized where it lies and the sets are
    unioned by ``distinct`` (one shuffle of distinct words).
    """
    sampled = exact_sample(df, frac, seed=seed)
    words = sampled.select(F.explode_outer(tokenizer(text_col)).alias("word"))
    return words.filter(F.col("word").isNotNull()).distinct()
