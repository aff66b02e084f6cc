"""Session factory with the settings the engine is tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "strataloom", cores: str | int = "*", shuffle: int | None = None, shared: str | None = None) -> SparkSession:
    """A session with AQE, UTC and Arrow; on a cluster the master and sizes come from spark-submit.

    shared: the folder that all executors share, unless spark-submit names it in spark.checkpoint.dir.
    """
    b = SparkSession.builder.appName(app)
    if "SPARK_MASTER" not in os.environ:
        b = b.master(f"local[{cores}]")
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shared:
        conf["spark.checkpoint.dir"] = shared
    if shuffle:
        conf["spark.sql.shuffle.partitions"] = str(shuffle)
    return b.config(map=conf).getOrCreate()
