"""Preparation operators: label codes, tokenizing, undersampling, splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexis.functions.arrays import hex_int, one_hot, seeded_key
from lexis.functions.text import word_tokens
from lexis.operators.joins import bounded_broadcast
from lexis.operators.sampling import BUCKET_HEX, kth_smallest_key

# Fixed defaults of the reference's preparation job.
SAMPLE_RATE = 0.075
TEST_SIZE = 0.1
UNDERSAMPLE_FACTOR = 4
MAX_CLASSES = 10_000


def drop_null_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with a null in any (or any of ``subset``) column."""
    return df.na.drop("any", subset=subset)


def label_codes(df: DataFrame, label_col: str = "label") -> DataFrame:
    """P5: ``label, code`` with codes 0..k-1 in lexicographic label order.

    The window runs over the distinct labels only (k rows).
    """
    labels = df.select(label_col).where(F.col(label_col).isNotNull()).distinct()
    return labels.withColumn(
        "code", (F.dense_rank().over(Window.orderBy(label_col)) - 1).cast("int"))


def bounded_codes(codes: DataFrame, max_classes: int = MAX_CLASSES) -> tuple[DataFrame, bool]:
    """Materialise a label map on the driver when it provably has at most ``max_classes`` rows.

    Returns ``(codes, bounded)``: a small driver-built table that is safe to
    broadcast, or the original (lazy) table when the bound is exceeded, in
    which case joins are left to the planner.
    """
    rows = codes.select("label", "code").limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        return codes, False
    return codes.sparkSession.createDataFrame(rows, "label string, code int"), True


def attach_codes(df: DataFrame, codes: DataFrame, label_col: str = "label",
                 code_col: str = "code") -> DataFrame:
    """P5/P6 lookup: add the code of ``label_col`` through a bounded broadcast join."""
    return df.join(bounded_broadcast(codes.withColumnRenamed("code", code_col), MAX_CLASSES),
                   label_col, "inner")


def decode(df: DataFrame, codes: DataFrame, code_col: str, name_col: str,
           label_col: str = "label") -> DataFrame:
    """Code -> name through a bounded broadcast join (left: unknown codes stay null)."""
    lookup = codes.select(F.col("code").alias(code_col), F.col(label_col).alias(name_col))
    return df.join(bounded_broadcast(lookup, MAX_CLASSES), code_col, "left")


def with_one_hot(df: DataFrame, k: int, code_col: str = "code",
                 out_col: str = "onehot") -> DataFrame:
    """One-hot label arrays of length ``k``."""
    return df.withColumn(out_col, one_hot(code_col, k))


def tokenize(df: DataFrame, text_col: str = "text", out_col: str = "tokens") -> DataFrame:
    """T1-T3 over a table: adds ``tokens array<string>``."""
    return df.withColumn(out_col, word_tokens(text_col))


def undersample(df: DataFrame, target: str, factor: float = UNDERSAMPLE_FACTOR,
                label_col: str = "label", seed: str = "42", id_col: str = "doc_id",
                basis: DataFrame | None = None) -> DataFrame:
    """Keep ``ceil(n_target / factor)`` seeded-random rows of class ``target``.

    Other classes pass untouched.  The dominant class (a third or more of all
    rows) is never gathered into one window partition: the exact k-th key is
    found from a bounded histogram (over ``basis``, a narrow table with the
    same keys and labels, where given) and the selection is one filter.
    """
    key = seeded_key(seed, id_col)
    is_target = F.col(label_col).eqNullSafe(F.lit(target))
    keyed = (df if basis is None else basis).filter(is_target).withColumn("_ukey", key)
    t = kth_smallest_key(keyed, "_ukey", k_of_n=lambda n: F.ceil(n / F.lit(float(factor))))
    return df.filter(~is_target if t is None else (~is_target | (key <= F.lit(t))))


def class_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """P10: rows per class plus a total row (label null) via ``rollup``."""
    return df.rollup(label_col).agg(F.count(F.lit(1)).alias("n"),
                                    (F.grouping(label_col) == 1).alias("is_total"))


def train_test_split(df: DataFrame, test_size: float = TEST_SIZE, seed: str = "42",
                     id_col: str = "doc_id", basis: DataFrame | None = None) -> DataFrame:
    """Unstratified seeded split; ``ceil(n * test_size)`` rows get ``split = 'test'``.

    ``basis``: a narrow table with the same keys that the threshold is found on.
    """
    key = seeded_key(seed, id_col)
    keyed = (df if basis is None else basis).withColumn("_skey", key)
    t = kth_smallest_key(keyed, "_skey", k_of_n=lambda n: F.ceil(n * F.lit(float(test_size))))
    is_test = F.lit(False) if t is None else (key <= F.lit(t))
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


def stratified_folds(df: DataFrame, label_col: str = "label", id_col: str = "doc_id", n_folds: int = 3, seed: str = "42",
                     fold_col: str = "fold") -> DataFrame:
    """M3: exact stratified folds: the rows of a class are dealt in turn, in seeded md5 order of ``id_col``.

    The fold sizes of a class differ by at most one.  A row's place in its
    class is the count of the class's rows in smaller key buckets (a running
    sum over at most 16**BUCKET_HEX counts a class) plus its rank within its own
    bucket, so a dominant class is ranked by as many tasks as there are
    partitions.  Equal keys (repeated or null ids) are dealt in any order;
    null labels form a class of their own.
    """
    key = seeded_key(f"{seed}-fold", id_col)
    keyed = df.withColumn("_fold_key", key).withColumn("_fold_bucket", hex_int(F.col("_fold_key"), 1, BUCKET_HEX))
    counts = keyed.groupBy(F.col(label_col).alias("_fold_label"), F.col("_fold_bucket").alias("_fold_at")).count()
    earlier = Window.partitionBy("_fold_label").orderBy("_fold_at").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_fold_label", "_fold_at", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_fold_before"))
    inside = Window.partitionBy(label_col, "_fold_bucket").orderBy("_fold_key", id_col)
    ranked = keyed.withColumn("_fold_rank", F.row_number().over(inside) - 1)
    joined = ranked.join(before, F.col(label_col).eqNullSafe(F.col("_fold_label")) & (F.col("_fold_bucket") == F.col("_fold_at")), "inner")
    return joined.select(*df.columns, ((F.col("_fold_before") + F.col("_fold_rank")) % n_folds).cast("int").alias(fold_col))
