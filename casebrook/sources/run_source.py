"""Recorded runs as a data source: ``spark.read.format("casebrook_runs")``.

Options: the root folder as path, and ``table``. The commit log names the files of
the runs as last committed; with ``spark.sql.python.filterPushdown.enabled``
conditions on ``run_id`` leave only the files of the runs they allow, and other
conditions on text and whole numbers reach the Parquet reader. A schema given to
the reader (``.schema(...)``) is the list of columns that are read.

The folder has to be one that ``pyarrow.fs`` opens from every machine: mounted, or
an object store. ``RunStore.read`` has no such limit and stays inside the JVM; this
source is for callers that know the folder and have no ``RunStore``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.pandas.types import to_arrow_schema

from casebrook.sources.commits import LOG, commit_names, replay
from casebrook.sources.runs import TABLES

FORMAT = "casebrook_runs"
ROWS_PER_BATCH = 1024  # a summary or an assessment is a text
_WHOLE = (T.StringType, T.IntegerType, T.LongType)  # the same order in both readers
_CONDITIONS: dict[type, Callable[[ds.Expression, Filter], ds.Expression]] = {
    EqualTo: lambda column, f: column == f.value,
    In: lambda column, f: column.isin([v for v in f.value if v is not None]),
    GreaterThan: lambda column, f: column > f.value,
    GreaterThanOrEqual: lambda column, f: column >= f.value,
    LessThan: lambda column, f: column < f.value,
    LessThanOrEqual: lambda column, f: column <= f.value,
    IsNotNull: lambda column, f: column.is_valid(),
}


def open_root(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root[len("file:") :].strip("/")
    if "://" in root:
        system, path = fs.FileSystem.from_uri(root)
        return system, path.rstrip("/")
    return fs.LocalFileSystem(), root.rstrip("/")


@dataclass
class RunFile(InputPartition):
    """One file of one run."""

    path: str
    run_id: str


class RunReader(DataSourceReader):
    def __init__(self, root: str, table: str, schema: T.StructType) -> None:
        self.root, self.table, self.schema = root, table, schema
        self.run_ids: set[str] | None = None
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 - the interface's name
        own = {f.name: type(f.dataType) for f in TABLES[self.table]}
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name == "run_id" and isinstance(f, (EqualTo, In)):
                allowed = set(f.value) if isinstance(f, In) else {f.value}
                self.run_ids = allowed if self.run_ids is None else self.run_ids & allowed
                continue
            if name != "run_id" and type(f) in _CONDITIONS and own.get(name) in _WHOLE:
                self.filters.append(f)
            yield f  # Spark tests it once more

    def partitions(self) -> list[RunFile]:
        system, root = open_root(self.root)
        log = fs.FileSelector(f"{root}/{LOG}", allow_not_found=True)
        commits = []
        for name in commit_names(info.base_name for info in system.get_file_info(log)):
            with system.open_input_stream(f"{root}/{LOG}/{name}") as stream:
                commits.append(json.loads(stream.read()))
        files = []
        for (table, run_id), snapshot in sorted(replay(commits).items()):
            if table != self.table or (self.run_ids is not None and run_id not in self.run_ids):
                continue
            folder = f"{root}/{table}/snapshot={snapshot}/run_id={run_id}"
            for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if info.is_file and info.base_name.endswith(".parquet"):
                    files.append(RunFile(info.path, run_id))
        return files

    def read(self, partition: RunFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file is left
            return
        system, _ = open_root(self.root)
        wanted = to_arrow_schema(self.schema)
        stored = [name for name in wanted.names if name != "run_id"]
        condition = None
        for f in self.filters:
            one = _CONDITIONS[type(f)](ds.field(f.attribute[0]), f)
            condition = one if condition is None else condition & one
        # the path names the run; it is not read out of folder names again
        file = ds.dataset(partition.path, filesystem=system, format="parquet", partitioning=None)
        for batch in file.to_batches(
            columns=stored, filter=condition, batch_size=ROWS_PER_BATCH, use_threads=False
        ):
            columns = [
                pa.array([partition.run_id] * batch.num_rows, type=field.type)
                if field.name == "run_id"
                else batch.column(field.name).cast(field.type)
                for field in wanted
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=wanted)


class RunTables(DataSource):
    """The tables of a ``RunStore``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _table(self) -> str:
        table = self.options.get("table", "runs")
        if table not in TABLES:
            raise ValueError(f"no such table of runs: {table!r}")
        return table

    def schema(self) -> T.StructType:
        return TABLES[self._table()]

    def reader(self, schema: T.StructType) -> RunReader:
        return RunReader(self.options["path"], self._table(), schema)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with conditions pushed down."""
    spark.dataSource.register(RunTables)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
