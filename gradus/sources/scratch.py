"""A place that the driver and all executors see, for tables that are written to be read again."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

from gradus.sources import files


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone at exit
        files.delete(spark, path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; in a local session without it, below a local one. Removed when the driver ends."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        where = f"file://{tempfile.gettempdir()}"
    path = f"{where.rstrip('/')}/library/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path
