"""Language identification by compression with per-language zstandard dictionaries.

For each label a raw-content dictionary is cut from a bounded sample of its
learning texts.  A whole text is compressed with every dictionary, in even
blocks of at most ``BLOCK_BYTES`` that each start from the dictionary alone;
the label whose blocks sum to the fewest bytes wins.  ``score`` is the margin
of the sums, ``(second - best) / second``, and a text whose margin is below
``min_margin`` is marked as rejected.  What a dictionary saves is bounded for
each block, so the margin of a text does not shrink with its length.

Defined cases: null text or a text without a letter gives ``und`` with score
0, rejected; equal sizes go to the label with more learning rows, then to the
first in order, with score 0; one learned label only gives score 1; nothing
learned gives ``und`` for every row.  Rows with null label are not learned
from.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexis.llm.common import documents

UND = "und"
SAMPLE_ROWS = 768
"""Learning rows per label that a dictionary is cut from (those of smallest hashed key)."""
SAMPLE_CHARS = 300
"""Characters taken from each sampled row, at a hashed place of its text; the product bounds a dictionary."""
MAX_LABELS = 500
"""More distinct labels than this are refused, so that what reaches the driver is bounded."""
LEVEL = 6
WINDOW_LOG = 20
SOURCE_HINT = 4096
"""Typical text size that the compressor's tables are laid out for."""
BLOCK_BYTES = 4096
"""Most bytes that are compressed from one fresh dictionary; longer texts are the sum of their blocks."""
MIN_MARGIN = 0.002


@dataclass(frozen=True)
class Dictionaries:
    """Labels, most learning rows first, with their raw dictionary content."""

    labels: tuple[str, ...]
    contents: tuple[bytes, ...]


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
          sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Dictionaries:
    """Cut one dictionary per label from the sampled rows of ``labelled``."""
    rows = labelled.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.col(label_col).alias("l")).filter("l IS NOT NULL AND t IS NOT NULL")
    sizes = rows.groupBy("l").count().limit(MAX_LABELS + 1).collect()
    if len(sizes) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    order = [r["l"] for r in sorted(sizes, key=lambda r: (-r["count"], r["l"]))]
    # A hashed key cuts the rows to a few times the sample before anything is
    # ranked, so neither texts nor ranks of a large label are ever gathered.
    rate: Column = F.lit(1.0)
    for r in sizes:
        rate = F.when(F.col("l") == r["l"], F.lit(min(1.0, (4.0 * sample_rows + 64) / r["count"]))).otherwise(rate)
    key = F.pmod(F.xxhash64("k"), F.lit(1 << 30))
    # a piece starts anywhere in its text, and a piece that repeats counts once
    start = (F.pmod(F.xxhash64("k", F.lit("piece")), F.greatest(F.length("t") - sample_chars, F.lit(0)) + 1) + 1).cast("int")
    ranked = (rows.withColumn("h", key).filter(F.col("h") < rate * (1 << 30))
              .select("l", "h", "k", F.substring("t", start, F.lit(sample_chars)).alias("t"))
              .groupBy("l", "t").agg(F.min(F.struct("h", "k")).alias("p")).select("l", "p.h", "p.k", "t")
              .withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "k", "t")))
              .filter(F.col("r") <= sample_rows))
    texts: dict[str, list[str]] = {label: [] for label in order}
    for row in ranked.orderBy("l", F.desc("r")).collect():
        texts[row["l"]].append(row["t"].lower())
    return Dictionaries(tuple(order), tuple("\n".join(texts[label]).encode() for label in order))


def blocks(raw: bytes) -> list[bytes]:
    """All of ``raw`` in even blocks of at most ``BLOCK_BYTES``."""
    n = max(1, -(-len(raw) // BLOCK_BYTES))
    cuts = [len(raw) * i // n for i in range(n + 1)]
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def _classifier(dictionaries: Dictionaries):
    packers = []
    for content in dictionaries.contents:
        parameters = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=SOURCE_HINT, dict_size=len(content), window_log=WINDOW_LOG,
            write_content_size=0, write_checksum=0, write_dict_id=0)
        if len(content) < 8:  # too short for a dictionary
            packers.append(zstandard.ZstdCompressor(compression_params=parameters).compress)
            continue
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(compression_params=parameters)
        packers.append(zstandard.ZstdCompressor(dict_data=data, compression_params=parameters).compress)

    def classify(text: str | None) -> tuple[str, float]:
        if not text or not packers or not any(map(str.isalpha, text)):
            return UND, 0.0
        parts = blocks(text.lower().encode())
        sizes = [sum(len(pack(part)) for part in parts) for pack in packers]
        best = min(sizes)
        at = sizes.index(best)
        if len(sizes) == 1:
            return dictionaries.labels[0], 1.0
        second = min(sizes[:at] + sizes[at + 1:])
        return dictionaries.labels[at], (second - best) / second

    return classify


def identify(df: DataFrame, dictionaries: Dictionaries, min_margin: float = MIN_MARGIN,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for every row."""
    shared = df.sparkSession.sparkContext.broadcast(dictionaries)  # at most MAX_LABELS bounded dictionaries

    def run(batches):
        classify = _classifier(shared.value)
        for batch in batches:
            found = [classify(text.as_py()) for text in batch.column("text")]
            labels, scores = [x[0] for x in found], np.array([x[1] for x in found], float)
            rejected = [label == UND or score < min_margin for label, score in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"])

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(id_col: str = "doc_id") -> Column:
    """The quarter of the rows that is never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2
