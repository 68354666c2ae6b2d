"""Shared storage for cut lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of its own only where none is set and all tasks run in this process (tests, notebooks)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not re.match(r"local(\[[^,]*\])?$", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quadrat-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()
