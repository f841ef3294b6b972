"""Registered queries of the dealt operators: ``op<N>_<name>`` over the whole tables.

Each query runs its operator with production parameters and derives the
columns of its result contract; ``ORACLE`` holds the equivalent SQL where SQL
can express the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexis.llm import bpe, decontam, infill, langid, licenses, lines, lm, ngram_join, oracles, pair_index, pii, quality, suffix, whitening
from lexis.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return register


def rank_file() -> str:
    """The public byte-level tokenizer's rank file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op1_line_dedup", oracles.LINE_DEDUP)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.deduplicated(read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_judged", "n_exact", "n_near", "only_copies",
                       F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query("op2_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    learned = langid.learn(docs.filter(~langid.held_out()))
    return langid.identify(docs, learned).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query("op3_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(read(spark, sf_dir, "documents"), rank_file())


@query("op4_cross_entropy_difference", oracles.CROSS_ENTROPY)
def cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the texts labelled good and not toxic."""
    target = read(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")
    scored = lm.cross_entropy_difference(read(spark, sf_dir, "documents"), target)
    return scored.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("loss_target", "loss_background", "score")])


@query("op5_quality_divergence", oracles.QUALITY)
def quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


@query("op8_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per text: paragraphs, licence paragraphs, unknown ones, families and the highest probability."""
    found = licenses.license_scan(read(spark, sf_dir, "documents"))
    families = F.transform("paragraphs", lambda p: p["family"])
    return found.select("doc_id", "n_paragraphs", F.size("paragraphs").cast("long").alias("n_license"),
                        F.size(F.filter(families, lambda f: f == licenses.UNKNOWN)).cast("long").alias("n_unknown"),
                        F.array_join(F.array_sort(F.array_distinct(F.filter(families, lambda f: f != licenses.UNKNOWN))), ",").alias("families"),
                        F.round(F.array_max(F.transform("paragraphs", lambda p: p["probability"])), 4).alias("probability"))


@query("op9_benchmark_decontamination", oracles.DECONTAMINATION)
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", decontam.hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


@query("op10_suffix_dedup", oracles.SUFFIX)
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(read(spark, sf_dir, "documents"))


@query("op6_ngram_jaccard_join", oracles.JACCARD)
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ngram_join.join_groups(read(spark, sf_dir, "documents"), n=3, threshold=90)
    return groups.select("doc_id", F.col("n_grams").alias("n_shingles"), "component_id")


@query("op11_fill_in_middle", oracles.FILL_IN_MIDDLE)
def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arranged texts, and the texts rebuilt from what was arranged, as digests."""
    back = infill.restored(infill.fill_in_middle(read(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


def merge_file() -> str:
    """The public byte-level tokenizer's file with merges and added tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op12_pair_index_bpe")
def pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_index.round_trip_digests(read(spark, sf_dir, "documents"), merge_file())


@query("op13_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))
