"""Components of rows that share keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_key_components(rows: DataFrame, rounds: int = 50) -> DataFrame:
    """``node`` and the smallest node of its component (``label``), for rows (node, key) linked by equal keys.

    Labels go from nodes to their keys and back, so a key that many rows share costs a row for each
    and not for each pair. Each round is checkpointed, and labels also jump to their own labels.
    """
    spark = rows.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            import tempfile

            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = "file://" + tempfile.mkdtemp(prefix="lodeweave-")
        spark.sparkContext.setCheckpointDir(where)
    links = rows.select("node", "key").distinct().checkpoint()
    labels = links.select("node").distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        at_key = links.join(labels, "node").groupBy("key").agg(F.min("label").alias("label"))
        near = links.join(at_key, "key").groupBy("node").agg(F.min("label").alias("label"))
        jumped = near.join(near.select(F.col("node").alias("label"), F.col("label").alias("further")), "label").select("node", F.least("label", "further").alias("label"))
        jumped = jumped.checkpoint()
        changed = jumped.join(labels.withColumnRenamed("label", "before"), "node").where("label <> before").isEmpty()
        labels = jumped
        if changed:
            break
    return labels
