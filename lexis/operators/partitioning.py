"""Partitioning helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame

# A scan task beyond this share of the input's bytes is worth a shuffle of the text.
WIDE_ENOUGH_BYTES = 64 << 20


def spread(df: DataFrame, key: str | None = None, min_partitions: int | None = None) -> DataFrame:
    """Spread a small input that sits in few scan tasks; leave every other input alone.

    A corpus stored as one Parquet row group is scanned by one task, so
    everything up to the first shuffle (regex tokenizing, explode, partial
    aggregation) would run on one core.  Only an input whose planned size
    could fill fewer than ``min_partitions`` (default: the cluster's
    parallelism) tasks of ``WIDE_ENOUGH_BYTES`` is hash-partitioned by ``key``
    (rows stay grouped by document, so later per-document aggregations can
    reuse the partitioning).  A large input is read in wide splits anyway and
    is never shuffled for this.  The decision uses the plan's size estimate: no
    job, no memory of earlier calls.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if planned_bytes(df) >= target * WIDE_ENOUGH_BYTES:
        return df
    return df.repartition(target, key) if key else df.repartition(target)


def planned_bytes(df: DataFrame) -> int:
    """The plan's size estimate; no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
