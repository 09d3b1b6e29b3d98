"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """The cluster's checkpoint folder; in local mode, where none is set, one of this machine, set as such from then on; None elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not found and spark.sparkContext.master.startswith("local"):
        found = tempfile.mkdtemp(prefix="logloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/") if found else None
