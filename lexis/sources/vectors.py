"""Word-vector sources (S2-S6): text vector files, vector tables, trained models, registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _file_order():
    """Position of a line in its input: (file, split start, row id within the split)."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                    F.monotonically_increasing_id())


# A private-use pair that stands for genuine U+FFFD while undecodable bytes are removed.
_KEPT_MARK = "\uF8FE\uF8FF"
# Unicode white space as the reference's split sees it.
_SPACE = "(?U)[\\s\\x1C-\\x1F]+"


def read_text_vectors(spark: SparkSession, path: str, dim: int | None = None,
                      drop_undecodable: bool = False) -> DataFrame:
    """Whitespace-separated ``word f1 ... fd`` lines -> ``word, vec array<float>``.

    * the first field is the word, the rest are floats; fields are split at
      Unicode white space;
    * a word seen twice keeps its **last** vector (file order), via
      ``max_by(vec, <file position>)`` - one aggregate on the word;
    * a ``count dim`` header (two whole numbers as the first line of a file) is
      dropped, so files of any dimension can be read;
    * ``dim``: keep only vectors of that length; ``None`` keeps every length;
    * ``drop_undecodable``: drop bytes that are not UTF-8 (the reference opens
      the file with errors='ignore'); a genuine U+FFFD stays.

    The file is split across tasks like any text source; nothing is read on
    the driver.
    """
    raw = spark.read.text(path).select("value", _file_order().alias("_ord"), F.col("_metadata.file_block_start").alias("_start"),
                                       F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_row"))
    header = (F.col("_start") == 0) & (F.col("_row") == 0) & F.col("value").rlike("^\\s*\\d+\\s+\\d+\\s*$")
    raw = raw.filter(~header)
    line = F.col("value")
    if drop_undecodable:
        marked = F.make_valid_utf8(F.replace(line, F.lit("\uFFFD"), F.lit(_KEPT_MARK)))
        line = F.replace(F.replace(marked, F.lit("\uFFFD"), F.lit("")), F.lit(_KEPT_MARK), F.lit("\uFFFD"))
    parts = F.filter(F.split(line, _SPACE), lambda x: x != "")
    parsed = raw.select(
        F.get(parts, 0).alias("word"),
        F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
                    lambda x: x.cast("float")).alias("vec"),
        "_ord",
    ).filter(F.col("word").isNotNull() & (F.col("word") != ""))
    if dim is not None:
        parsed = parsed.filter(F.size("vec") == dim)
    return parsed.groupBy("word").agg(F.max_by("vec", "_ord").alias("vec"))


def read_vector_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet ``word, vec`` table (binary word2vec files are converted to this once)."""
    return spark.read.parquet(path).select("word", F.col("vec").cast("array<float>").alias("vec"))


def read_word2vec_model(path: str) -> DataFrame:
    """Vectors of a saved ``Word2VecModel``."""
    from pyspark.ml.feature import Word2VecModel
    from pyspark.ml.functions import vector_to_array
    return Word2VecModel.load(path).getVectors().select(
        "word", vector_to_array("vector", "float32").alias("vec"))


def _filled(df: DataFrame, name: str, path: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"embedding {name}: no vector in {path}")
    return df


def embedding_registry(paths: dict[str, str], fasttext_dim: int | None = None
                       ) -> dict[str, Callable[[SparkSession], DataFrame]]:
    """Embedding name -> loader, in the reference's order (word2vec, glove, fasttext, custom).

    Only the names present in ``paths`` are registered.  ``fasttext_dim`` may
    pin the dimension; by default every dimension is read.  A loader that finds
    no vector raises.
    """
    loaders: dict[str, Callable[[SparkSession], DataFrame]] = {}
    if "word2vec" in paths:
        loaders["word2vec"] = lambda s: _filled(read_vector_table(s, paths["word2vec"]), "word2vec", paths["word2vec"])
    if "glove" in paths:
        loaders["glove"] = lambda s: _filled(read_text_vectors(s, paths["glove"]), "glove", paths["glove"])
    if "fasttext" in paths:
        loaders["fasttext"] = lambda s: _filled(read_text_vectors(s, paths["fasttext"], dim=fasttext_dim, drop_undecodable=True),
                                                "fasttext", paths["fasttext"])
    if "custom" in paths:
        loaders["custom"] = lambda s: _filled(read_word2vec_model(paths["custom"]), "custom", paths["custom"])
    return loaders
