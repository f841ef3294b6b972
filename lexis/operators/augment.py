"""Synonym augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexis.functions.arrays import seeded_key, unit_interval
from lexis.operators.joins import bounded_broadcast_bytes, hot_keys, salted_join


def one_synonym_per_word(synonyms: DataFrame, seed: str = "42") -> DataFrame:
    """Reduce a ``word, synonym`` table to one seeded-random synonym per word (``min_by``)."""
    key = seeded_key(seed, "word", "synonym")
    return synonyms.groupBy("word").agg(F.min_by("synonym", key).alias("synonym"))


def synonym_augment(tokens: DataFrame, synonyms: DataFrame, aug_p: float = 0.5,
                    return_p: float = 0.5, seed: str = "42", doc_col: str = "doc_id",
                    tokens_col: str = "tokens") -> DataFrame:
    """Append augmented copies of a seeded ``return_p`` share of the documents.

    In a copy, each token that has a synonym is replaced with probability
    ``aug_p``; other tokens stay (the intended behaviour - the reference
    reads a global document and drops unchosen words, SURVEY trap 6).
    Output = input with ``augmented = 0`` plus the copies with ``augmented = 1``.
    Per token: one join to the synonym table; per copy: one aggregation
    bounded by the document's length.
    """
    syn, small = bounded_broadcast_bytes(one_synonym_per_word(synonyms, seed), 96)
    other = [c for c in tokens.columns if c not in (doc_col, tokens_col)]
    chosen = tokens.filter(unit_interval(seeded_key(f"{seed}-row", doc_col)) < F.lit(return_p))
    ex = chosen.select(doc_col, *other, F.posexplode_outer(tokens_col).alias("pos", "word"))
    if small:
        j = ex.join(syn, "word", "left")
    else:  # sort-merge on the word: salt the frequent words (see ``salted_join``)
        hot = hot_keys(ex.filter(F.col("word").isNotNull()), "word", seed_col=doc_col)
        j = salted_join(ex, syn, "word", hot, 32, spread_col=doc_col, how="left")
    flip = unit_interval(seeded_key(f"{seed}-word", doc_col, "pos")) < F.lit(aug_p)
    w = F.when(F.col("synonym").isNotNull() & flip, F.col("synonym")).otherwise(F.col("word"))
    entry = F.when(F.col("pos").isNotNull(), F.struct(F.col("pos"), w.alias("w")))
    copies = (j.groupBy(doc_col, *other).agg(F.array_sort(F.collect_list(entry)).alias("_p"))
              .select(doc_col, *other, F.transform("_p", lambda p: p["w"]).alias(tokens_col),
                      F.lit(1).alias("augmented")))
    return tokens.withColumn("augmented", F.lit(0)).unionByName(copies)
