"""A sheet as numbered parts in one guaranteed order, with a manifest of what is in them.

A data source of Spark's own kind: each task writes its part under a name of
its attempt and tells the driver how many rows are in it; only when all tasks are done does the
driver write the manifest, last. A part is in the sheet if the manifest names it. So a
task that ran twice is counted once, and a sheet without a manifest is not finished.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import csv
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from wardbook.sinks.reports import sheet

MANIFEST = "manifest.json"
NAME = "numbered_sheet"


def store_of(path: str) -> tuple[FileSystem, str]:
    """The file system of a path or URI, reached from driver and tasks alike."""
    if "://" in path or path.startswith("/"):
        return FileSystem.from_uri(path)
    raise ValueError(f"the folder must be an absolute path or a URI, got {path!r}")


@dataclass
class PartWritten(WriterCommitMessage):
    """What a task tells of its part; a part without rows has no file."""

    part: int
    name: str | None
    rows: int
    sha256: str | None


class NumberedParts(DataSourceArrowWriter):
    """Writes one CSV file a partition; partitions of a sorted frame are in its order."""

    def __init__(self, path: str, columns: list[str], overwrite: bool):
        store, folder = store_of(path)
        known = store.get_file_info(folder).type != FileType.NotFound
        if known and not overwrite and store.get_file_info(FileSelector(folder)):
            raise ValueError(f"{path} is not empty; write with mode 'overwrite' to replace it")
        store.create_dir(folder, recursive=True)
        self.path, self.columns = path, columns

    def write(self, iterator: Iterator[pa.RecordBatch]) -> PartWritten:
        context = TaskContext.get()
        return self.write_part(iterator, context.partitionId(), context.taskAttemptId())

    def write_part(self, batches: Iterator[pa.RecordBatch], part: int, attempt: int) -> PartWritten:
        store, folder = store_of(self.path)
        name, rows = f"part-{part:06d}-{attempt}.csv", 0
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = csv.CSVWriter(store.open_output_stream(f"{folder}/{name}"), batch.schema)
            out.write_batch(batch)
            rows += batch.num_rows
        if out is None:
            return PartWritten(part, None, 0, None)
        out.close()
        digest = hashlib.sha256()
        with store.open_input_stream(f"{folder}/{name}") as written:
            while block := written.read(1 << 20):
                digest.update(block)
        return PartWritten(part, name, rows, digest.hexdigest())

    def commit(self, messages: list[PartWritten | None]) -> None:
        """Write the manifest, and then drop files of attempts and of earlier sheets that it does not name."""
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.part)
        store, folder = store_of(self.path)
        first, listed = 0, []
        for number, m in enumerate(parts):
            listed.append({"part": number, "file": m.name, "first_row": first, "rows": m.rows, "sha256": m.sha256})
            first += m.rows
        manifest = {"columns": self.columns, "rows": first, "parts": listed}
        with store.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps(manifest, indent=1).encode())
        self._clear({m.name for m in parts} | {MANIFEST})

    def abort(self, messages: list[PartWritten | None]) -> None:
        """Drop this job's parts; a finished sheet that it was to replace stays as it is."""
        store, folder = store_of(self.path)
        for message in messages:
            if message and message.name and store.get_file_info(f"{folder}/{message.name}").type == FileType.File:
                store.delete_file(f"{folder}/{message.name}")

    def _clear(self, keep: set[str]) -> None:
        store, folder = store_of(self.path)
        for found in store.get_file_info(FileSelector(folder)):
            if found.type == FileType.File and found.base_name not in keep and found.extension == "csv":
                store.delete_file(found.path)


class NumberedSheet(DataSource):
    """``df.write.format("numbered_sheet").mode(...).save(path)``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> NumberedParts:
        return NumberedParts(self.options["path"], schema.names, overwrite)


def write_numbered(report: str, frame: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write the report's sheet as numbered CSV parts in the report's order, with a manifest."""
    frame.sparkSession.dataSource.register(NumberedSheet)
    sheet(report, frame).write.format(NAME).mode("overwrite" if overwrite else "append").save(path)


def manifest_of(path: str) -> dict:
    store, folder = store_of(path)
    with store.open_input_stream(f"{folder}/{MANIFEST}") as found:
        return json.loads(found.read())


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """A finished sheet's rows as texts, only of parts that its manifest names."""
    manifest = manifest_of(path)
    schema = ", ".join(f"`{name}` string" for name in manifest["columns"])
    if not manifest["parts"]:
        return spark.createDataFrame([], schema)
    files = [f"{path.rstrip('/')}/{part['file']}" for part in manifest["parts"]]
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
    return reader.csv(files)
