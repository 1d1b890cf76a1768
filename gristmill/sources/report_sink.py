"""Reports as a Python data source that writes in two phases: all of them are there or none is.

A task writes each report to a file of its own in a folder of its attempt. When all tasks are done, the driver moves the run's
folder to its place and then replaces the manifest, which names the attempts that count; readers go by the manifest. A
failed run leaves the manifest and the reports of the run before as they were.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .paged import _place

NAME = "report_sink"


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    reports: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.run = path, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> _Written:
        system, root = _place(self.path)
        folder, n = f"task-{uuid.uuid4().hex}", 0
        for n, row in enumerate(rows, 1):
            if row["name"] is None or row["report"] is None:
                raise ValueError("a report needs a name and a text")
            if n == 1:
                system.create_dir(f"{root}/_{self.run}/{folder}")
            ident = hashlib.sha256(row["name"].encode()).hexdigest()
            with system.open_output_stream(f"{root}/_{self.run}/{folder}/{ident}.json") as out:
                out.write(json.dumps({"name": row["name"], "report": row["report"]}).encode())
        return _Written(folder, n)

    def commit(self, messages: list[_Written | None]) -> None:
        system, root = _place(self.path)
        done = [m for m in messages if m is not None and m.reports]
        system.create_dir(root)
        if done:
            system.move(f"{root}/_{self.run}", f"{root}/run-{self.run}")
        manifest = {"run": f"run-{self.run}", "tasks": [m.folder for m in done], "reports": sum(m.reports for m in done)}
        with system.open_output_stream(f"{root}/_{self.run}.json") as out:
            out.write(json.dumps(manifest).encode())
        system.move(f"{root}/_{self.run}.json", f"{root}/manifest.json")

    def abort(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        system, root = _place(self.path)
        if system.get_file_info(f"{root}/_{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_{self.run}")


class ReportSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if not {"name", "report"} <= set(schema.names):
            raise ValueError("reports have the columns name and report")
        return _Writer(self.options["path"])


def write_reports(reports: DataFrame, path: str) -> None:
    """Writes (name, report) as the folder's present reports, one for each row."""
    reports.sparkSession.dataSource.register(ReportSink)
    reports.select(F.col("name").cast("string").alias("name"), F.col("report").cast("string").alias("report")).write.format(NAME).mode("append").save(path)


def manifest(path: str) -> dict | None:
    """What the last whole run wrote; None before the first."""
    from pyarrow import fs

    system, root = _place(path)
    if system.get_file_info(f"{root}/manifest.json").type != fs.FileType.File:
        return None
    with system.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(name, report) of the last whole run."""
    found, kind = manifest(path), "name string, report string"
    if found is None or not found["tasks"]:
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).json([f"{path}/{found['run']}/{t}" for t in found["tasks"]])


def expect_reports(reports: DataFrame, path: str) -> None:
    """Holds reports against those of the folder. Without any they are written, and the expectation fails all the same, so
    that nobody takes a first run for a passed one."""
    if manifest(path) is None:
        write_reports(reports, path)
        raise AssertionError(f"no reports in {path} yet: written now, run again")
    count = lambda df, name: df.groupBy("name", "report").agg(F.count(F.lit(1)).alias(name))
    both = count(reports.select("name", "report"), "got").join(count(read_reports(reports.sparkSession, path), "want"), ["name", "report"], "full")
    odd = both.where(~F.col("got").eqNullSafe(F.col("want"))).select("name").distinct().orderBy("name").limit(5).collect()
    if odd:
        raise AssertionError(f"reports differ from {path}, first of {', '.join(r.name for r in odd)}")
