"""Connected components of a link table, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexis.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every linked node; the component is its smallest node.

    Labels start at the smallest neighbour; every round takes the smallest
    label around each node and then the label of that label (pointer
    jumping), until nothing changes.  Every round is written to the shared
    folder; only a count reaches the driver.
    """
    one = links.select(F.col(a).alias("s"), F.col(b).alias("t")).filter("s <> t")
    edges = written(one.union(one.select("t", "s")).distinct(), "edges")
    labels = written(edges.groupBy("s").agg(F.least(F.min("t"), F.first("s")).alias("c")).withColumnRenamed("s", "node"), "labels")
    while True:
        around = edges.join(labels, F.col("t") == F.col("node")).groupBy("s").agg(F.min("c").alias("m"))
        nearer = labels.join(around, F.col("node") == F.col("s")).select("node", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        up = labels.select(F.col("node").alias("p"), F.col("c").alias("pc"))
        jumped = written(nearer.join(up, F.col("c") == F.col("p"), "left").select("node", "old", F.least("c", F.coalesce("pc", "c")).alias("c")), "labels")
        changed = jumped.filter("old <> c").limit(1).count()
        labels = jumped.select("node", "c")
        if not changed:
            return labels.withColumnRenamed("c", "component")
