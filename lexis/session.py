"""Session helpers: building a session for tests/bench and lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "lexis",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Local session with AQE on and the UI off (tests, bench, examples).

    On a cluster, use the session the platform hands you; nothing in the
    library depends on these settings except ``spark.checkpoint.dir``.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LEXIS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def recommended_conf(input_bytes: int, total_cores: int, partition_bytes: int = 256 << 20,
                     shuffled_share: float = 0.25) -> dict[str, str]:
    """Settings sized for a job over ``input_bytes`` on ``total_cores`` executor cores.

    Scan splits of ``partition_bytes`` (128-256 MB fit executor memory with
    room for the text->token expansion).  Shuffle partitions follow the bytes
    a stage *shuffles* (``shuffled_share`` of the input; word tables are
    combined map-side), at twice the split size and at least 2 waves of tasks:
    map tasks x shuffle partitions blocks are made per exchange, so the number
    starts low and AQE splits what is skewed.
    """
    shuffle = max(2 * total_cores, int(input_bytes * shuffled_share) // (2 * partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(int(shuffle)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins.  Only when it is unset on a local
    master (tests) a fresh scratch folder is created and registered; on any
    other master executors could not read such a folder, so this raises.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lexis-ckpt-", dir="/tmp")
        spark.conf.set(CHECKPOINT_CONF, path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the shared checkpoint folder (reliable checkpoint).

    Survives executor loss: the data sits in the shared folder, not in
    executor memory or on a machine-local disk.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, computed once; it outlives any executor."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/lexis/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Collect the driver's garbage: Spark then deletes the shuffle files that no plan refers to any more."""
    spark.sparkContext._jvm.System.gc()


def discard(table: DataFrame) -> None:
    """Delete the files of a ``written`` table that nothing will read again.

    The driver's garbage is collected too: Spark drops the shuffle files behind
    the table once no plan refers to them.
    """
    jvm = table.sparkSession.sparkContext._jvm
    files = table.inputFiles()
    if files:
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0])).getParent()
        if folder.getParent().getName() != "lexis":
            raise ValueError(f"not a written table: {folder}")
        folder.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    drop_shuffles(table.sparkSession)
