"""Where intermediate tables are kept."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for a new table under ``spark.checkpoint.dir``; where that is unset, and in local mode only, on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.conf.get("spark.master", "")
        if master.partition("[")[0] != "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {master!r})")
        shared = tempfile.mkdtemp(prefix="wardbook-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
        shared = f"file://{shared}"
    return f"{shared}/{name}-{uuid.uuid4().hex}"
