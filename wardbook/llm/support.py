"""What the operators share: reading tables, tables in the shared folder, joins by a key list of a checked size."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 1 << 18
"""A list of single keys is broadcast up to this many rows (some 4 MB), and shuffled beyond."""
BATCH_BYTES = 1 << 21
"""Bytes of a batch of rows on its way to Python, after which the next begins."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, one of this process, and then only in local mode.

    On a cluster every executor would write to a disk of its own, so there the setting has to be made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master.partition("[")[0] != "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {master!r})")
        folder = tempfile.mkdtemp(prefix="wardbook-checkpoints-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        folder = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(frame: DataFrame, options: dict | None = None) -> DataFrame:
    """``frame`` as a table in the shared folder: its lineage is cut, and it survives lost executors; ``options`` are the file writer's."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/wardbook/{uuid.uuid4().hex}"
    frame.write.options(**(options or {})).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Send rows to Python in batches of ``BATCH_BYTES``, here and in what the session runs later; a limit that the session sets is kept.

    By Spark's own limits, 10,000 rows or 64 MB, all texts of a task go in one batch,
    which the executor and its Python worker then hold several times over.
    """
    if not spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, to size partitions by."""
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def parts_for(size: float, each: float) -> int:
    return max(1, math.ceil(size / each))


def keyed(frame: DataFrame, keys: DataFrame, how: str, rows: int | None = None) -> DataFrame:
    """``left_semi`` or ``left_anti`` join on the columns of ``keys``, a written table.

    The keys are counted: up to ``BROADCAST_ROWS`` they are broadcast, so that
    the texts of ``frame`` stay where they are; a longer list is shuffled.
    """
    count = keys.count() if rows is None else rows
    side = F.broadcast(keys) if count <= BROADCAST_ROWS else keys.hint("merge")
    return frame.join(side, keys.columns, how)


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its times, as whole numbers."""
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(times, at) if len(at) else times
