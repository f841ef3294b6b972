"""Exact, reproducible sampling without a one-task sort.

The reference samples with an unseeded RNG.  Here every row gets a seeded
md5 key and "a random sample of k rows" becomes "the k rows with the
smallest keys".  Sorting the whole table to find them would pull k rows
(possibly 10 % of 100 TB) through one task, so instead:

1. histogram the keys by their first ``BUCKET_HEX`` hex digits (at most
   16**5 = 1,048,576 buckets; partial aggregation map-side, tiny shuffle);
2. a running sum over that bounded histogram finds the bucket holding the
   k-th key and how many keys of it are needed;
3. the k-th key itself comes from sorting only that bucket (~n / 2**20 rows);
4. the sample is ``key <= kth_key``: a plain filter, no shuffle, no window.

Keys are md5 strings, so the whole procedure is exact and gives the same
rows as ``ORDER BY key LIMIT k`` in any engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexis.functions.arrays import hex_int, seeded_key, unit_interval

BUCKET_HEX = 5


def kth_smallest_key(df: DataFrame, key: str, k: int | None = None,
                     k_of_n: Callable[[Column], Column] | None = None) -> str | None:
    """The k-th smallest value of string column ``key`` (1-based), or None if k <= 0.

    ``k`` is either given, or computed from the row count ``n`` by the column
    function ``k_of_n`` inside the same job (e.g. ``lambda n: F.ceil(n * 0.1)``),
    so the row count costs no extra pass.  Two jobs in total: the bounded
    histogram (with its running sum and total), then one sort of the
    boundary bucket.  Returns the largest key when k exceeds the row count.
    """
    if k is not None and k <= 0:
        return None
    bucket = hex_int(F.col(key), 1, BUCKET_HEX).alias("b")
    hist = df.select(bucket).groupBy("b").count()
    # the histogram has at most 16**BUCKET_HEX rows: bounded single-task windows
    everything = Window.partitionBy()
    running = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    hist = (hist.withColumn("cum", F.sum("count").over(running))
            .withColumn("n", F.sum("count").over(everything)))
    want = F.lit(k) if k is not None else k_of_n(F.col("n")).cast("long")
    hist = hist.withColumn("k", want)
    hit = (hist.filter((F.col("cum") >= F.col("k")) | (F.col("cum") == F.col("n")))
           .orderBy("b").limit(1).collect())
    if not hit or hit[0]["k"] is None or hit[0]["k"] <= 0:
        return None
    b, cum, cnt, kk = hit[0]["b"], hit[0]["cum"], hit[0]["count"], hit[0]["k"]
    need = int(min(kk, cum) - (cum - cnt))
    inside = (df.filter(hex_int(F.col(key), 1, BUCKET_HEX) == F.lit(b))
              .select(key).orderBy(key).limit(need))
    return inside.agg(F.max(key).alias("m")).collect()[0]["m"]


def lowest_k(df: DataFrame, key: str, k: int) -> DataFrame:
    """Rows of ``df`` with the ``k`` smallest values of ``key`` (keys must be unique)."""
    t = kth_smallest_key(df, key, k)
    if t is None:
        return df.limit(0)
    return df.filter(F.col(key) <= F.lit(t))


def exact_sample(df: DataFrame, frac: float, seed: int | str = 42, id_col: str = "doc_id",
                 basis: DataFrame | None = None) -> DataFrame:
    """Exactly ``round(frac * n)`` rows (half to even), chosen by a seeded md5 order of ``id_col``.

    ``basis``: a narrow table with the same keys (no text) that the threshold
    is found on; ``df`` is then only filtered, never scanned for it.
    """
    keyed = (df if basis is None else basis).withColumn("_key", seeded_key(seed, id_col))
    t = kth_smallest_key(keyed, "_key", k_of_n=lambda n: F.bround(n * F.lit(float(frac)), 0))
    if t is None:
        return df.limit(0)
    return df.filter(seeded_key(seed, id_col) <= F.lit(t))


def approx_sample(df: DataFrame, frac: float, seed: int | str = 42,
                  id_col: str = "doc_id") -> DataFrame:
    """P4 (approximate): keep rows whose seeded md5 maps below ``frac``; one filter, no job."""
    return df.filter(unit_interval(seeded_key(seed, id_col)) < F.lit(frac))
