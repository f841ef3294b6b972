"""Vocabulary and integer sequences.

The vocabulary is capped at ``max_words`` (the reference's 10,000), so it
is a proven-small table: it is produced by a bounded top-n
(TakeOrderedAndProject) and sent to the tasks as a dictionary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from lexis.functions.text import encode_fixed, pad_front
from lexis.operators.analysis import explode_words, first_seen_key

# Fixed defaults of the reference's sequence model.
MAX_WORDS = 10_000
MAX_LEN = 300
ENCODE_LENGTH = 100
# special ids of the fixed-length encoding: padding, start, end, unknown
PAD_ID, START_ID, END_ID, UNK_ID = 0, 1, 2, 3
WORD_ID_OFFSET = 3


def fit_vocabulary(tokens: DataFrame, max_words: int = MAX_WORDS,
                   tokens_col: str = "tokens", doc_col: str = "doc_id") -> DataFrame:
    """``idx, word, n`` for the ``max_words - 1`` most frequent words (idx 1..).

    Ties are broken by first appearance (document order, then position),
    case is kept.  Counting is one hash aggregate on the word; the ranking
    runs over the capped top-n only.
    """
    counts = (explode_words(tokens, [doc_col], tokens_col, with_pos=True)
              .groupBy("word").agg(F.count(F.lit(1)).alias("n"),
                                   F.min(first_seen_key(doc_col)).alias("first_seen")))
    top = counts.orderBy(F.desc("n"), F.asc("first_seen")).limit(max(max_words - 1, 0))
    w = Window.orderBy(F.desc("n"), F.asc("first_seen"))
    return top.select(F.row_number().over(w).cast("int").alias("idx"), "word", "n")


def token_ids(tokens: DataFrame, vocab: DataFrame, tokens_col: str = "tokens",
              doc_col: str = "doc_id", offset: int = 0, unknown_id: int | None = None,
              keep: list[str] | None = None, max_words: int = MAX_WORDS) -> DataFrame:
    """``doc_id, ids`` - vocabulary ids in token order; unknown words dropped
    (or mapped to ``unknown_id``).  Documents without any known word, or without
    tokens, keep an empty array; null tokens have no id.

    One map stage and no shuffle: the token lists of an Arrow batch are looked
    up as one flat array in the dictionary and rebuilt.  Only ids below
    ``max_words`` are used (the reference's ``num_words`` rule); idx is unique,
    so the dictionary sent to the tasks has at most ``max_words - 1`` words.
    ``keep``: per-document columns carried through.
    """
    keep = list(keep or [])
    rows = vocab.filter((F.col("idx") < F.lit(max_words)) & F.col("word").isNotNull()).select("word", "idx").collect()
    words, numbers = [r["word"] for r in rows], [r["idx"] + offset for r in rows]
    given = tokens.select(doc_col, *keep, F.col(tokens_col).alias("_tokens"))
    schema = StructType([*[given.schema[c] for c in (doc_col, *keep)], StructField("ids", ArrayType(IntegerType()))])

    def run(batches):
        known, ident = pa.array(words, pa.string()), pa.array(numbers, pa.int32())
        for batch in batches:
            lists = batch.column("_tokens")
            flat = lists.flatten()
            ids = ident.take(pc.index_in(flat, value_set=known, skip_nulls=True))
            if unknown_id is not None:
                ids = pc.if_else(pc.and_(flat.is_valid(), ids.is_null()), pa.scalar(unknown_id, pa.int32()), ids)
            has = np.r_[0, np.cumsum(ids.is_valid().to_numpy(zero_copy_only=False))]
            edge = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]
            made = pa.ListArray.from_arrays(pa.array(has[edge], pa.int32()), ids.drop_null())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (doc_col, *keep)], made], names=[doc_col, *keep, "ids"])

    return given.mapInArrow(run, schema)


def padded_sequences(tokens: DataFrame, vocab: DataFrame, maxlen: int = MAX_LEN,
                     tokens_col: str = "tokens", doc_col: str = "doc_id") -> DataFrame:
    """T8 + T9: ids padded / truncated at the front to exactly ``maxlen``."""
    ids = token_ids(tokens, vocab, tokens_col, doc_col)
    return ids.select(doc_col, pad_front("ids", maxlen).alias("ids"))


def encoded_with_mask(tokens: DataFrame, vocab: DataFrame, length: int = ENCODE_LENGTH,
                      tokens_col: str = "tokens", doc_col: str = "doc_id",
                      keep: list[str] | None = None) -> DataFrame:
    """T10 re-aimed on the word vocabulary: ``[start] ids [end]`` padded at the end, plus mask.

    Word ids are shifted past the special ids; words outside the capped
    vocabulary become the unknown id.
    """
    keep = list(keep or [])
    # every word becomes an id, so only the first words that fit can appear: cut before the generator
    head = tokens.select(doc_col, *keep, F.slice(tokens_col, 1, max(length - 2, 1)).alias(tokens_col))
    ids = token_ids(head, vocab, tokens_col, doc_col, offset=WORD_ID_OFFSET, unknown_id=UNK_ID, keep=keep)
    enc = encode_fixed("ids", length, START_ID, END_ID, PAD_ID)
    return ids.select(doc_col, *keep, enc.alias("enc")).select(doc_col, *keep, "enc.ids", "enc.mask")
