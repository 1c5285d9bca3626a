"""Session defaults shared by the entry points, the bench and the tests."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "lodeweave", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with the engine's defaults; on a cluster the submitter's own settings win.

    Adaptive execution coalesces small shuffle partitions and splits skewed ones, so the partition
    count here only has to suit one machine.
    """
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
    } | conf
    builder = SparkSession.builder.appName(app).master(f"local[{cpus}]")
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
