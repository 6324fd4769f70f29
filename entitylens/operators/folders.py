"""The folder that all machines share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Only a local session, as in tests, may do without: it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        found = spark.conf.get("entitylens.folder", None) or tempfile.mkdtemp(prefix="entitylens-")
        spark.conf.set("entitylens.folder", found)
    return found.rstrip("/")
