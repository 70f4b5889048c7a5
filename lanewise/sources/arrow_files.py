"""Arrow IPC files as a data source and sink of the cluster: tasks read and write record batches, and none goes through the driver.

    spark.dataSource.register(ArrowFiles)
    df.write.format("lanewise_arrow").mode("append").save(folder)
    spark.read.format("lanewise_arrow").option("columns", "a,b").load(folder)

A write leaves one file a task and, once all tasks are done, one commit that names them; files that no commit names (of a task that was
lost, tried twice, or of a write that failed) are never read. A folder without commits is read whole, as files of other programs. The
folder is a path, or a URI of a store that pyarrow opens, that the driver and all executors share.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from lanewise.operators.errors import NotPortable
from lanewise.session import ship

from .arrow_io import check_frame, landed

#: Bytes of a file that one task reads, and rows of a written batch.
SPLIT, BATCH = 64 << 20, 1 << 16
COMMITS = "_commits"


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    if re.match(r"^file:", folder):
        return pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def named_files(fs: pafs.FileSystem, at: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files to read, in the order of their commits."""
    found = {f.base_name: f for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if f.type == pafs.FileType.File and f.base_name.endswith(".arrow")}
    commits = sorted((f.base_name, f.path) for f in fs.get_file_info(pafs.FileSelector(f"{at}/{COMMITS}", allow_not_found=True)) if f.base_name.endswith(".json"))
    if not commits:
        return [(f.path, f.size) for _, f in sorted(found.items())]
    out = []
    for _, path in commits:
        with fs.open_input_stream(path) as f:
            out += [(found[n].path, found[n].size) for n in json.loads(f.read())["files"]]
    return out


@dataclass
class Batches(InputPartition):
    """The record batches of part k of n of a file."""

    path: str
    k: int
    n: int


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class Reader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType, columns: list[str] | None):
        self.folder, self.kinds, self.columns = folder, to_arrow_schema(schema), columns

    def partitions(self) -> list[Batches]:
        """Files are split by their size; no file is opened here."""
        fs, at = opened(self.folder)
        out = []
        for path, size in named_files(fs, at):
            n = max(1, -(-size // SPLIT))
            out += [Batches(path, k, n) for k in range(n)]
        return out or [Batches("", 0, 1)]

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = opened(self.folder)
        with fs.open_input_file(partition.path) as f:
            names = pa.ipc.open_file(f).schema.names
            at = [names.index(c) for c in self.columns] if self.columns else None
            file = pa.ipc.open_file(f, options=pa.ipc.IpcReadOptions(included_fields=at))
            n = file.num_record_batches
            for k in range(n * partition.k // partition.n, n * (partition.k + 1) // partition.n):
                batch = file.get_batch(k)
                by_name = dict(zip(batch.schema.names, batch.columns, strict=True))
                yield pa.RecordBatch.from_arrays([landed(by_name[c.name], c.name).cast(c.type) for c in self.kinds], schema=self.kinds)


class Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.run = folder, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = opened(self.folder)
        fs.create_dir(at, recursive=True)
        task = TaskContext.get()
        name = f"{self.run}-{task.partitionId():06d}-{task.taskAttemptId()}.arrow"
        rows, out = 0, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                kinds = pa.schema([pa.field(f.name, pa.large_string() if pa.types.is_string(f.type) else f.type) for f in batch.schema])
                if out is None:
                    sink = fs.open_output_stream(f"{at}/{name}")
                    out = pa.ipc.new_file(sink, kinds)
                rows += batch.num_rows
                out.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, kinds, strict=True)], schema=kinds))
        finally:
            if out is not None:
                out.close()
                sink.close()
        return Written(name if rows else "", rows)

    def commit(self, messages: list[Written | None]) -> None:
        """The commit appears whole, after all files. An overwrite takes the old commits and their files away once the new one stands."""
        fs, at = opened(self.folder)
        fs.create_dir(f"{at}/{COMMITS}", recursive=True)
        before = fs.get_file_info(pafs.FileSelector(f"{at}/{COMMITS}"))
        old = [f.path for f in before if f.base_name.endswith(".json")] if self.overwrite else []
        stale = [p for p, _ in named_files(fs, at)] if old else []
        done = [m for m in messages if m is not None and m.name]
        entry = {"files": [m.name for m in done], "rows": sum(m.rows for m in done)}
        draft = f"{at}/{COMMITS}/.{self.run}"
        with fs.open_output_stream(draft) as f:
            f.write(json.dumps(entry).encode())
        fs.move(draft, f"{at}/{COMMITS}/{sum(f.base_name.endswith('.json') for f in before):012d}-{self.run}.json")
        for p in [*old, *(p for p in stale if p.rsplit("/", 1)[1] not in entry["files"])]:
            fs.delete_file(p)

    def abort(self, messages: list[Written | None]) -> None:
        """The files of a write that failed go; what a lost task left is named by no commit."""
        fs, at = opened(self.folder)
        for m in messages:
            if m is not None and m.name and fs.get_file_info(f"{at}/{m.name}").type == pafs.FileType.File:
                fs.delete_file(f"{at}/{m.name}")


class ArrowFiles(DataSource):
    """Options: path; columns, names joined by commas, which are read alone. Columns land as arrow_io.landed says, one after the other; a type
    without a home declines by its column's name, before any task starts."""

    @classmethod
    def name(cls) -> str:
        return "lanewise_arrow"

    def _columns(self) -> list[str] | None:
        named = self.options.get("columns")
        return [c.strip() for c in named.split(",")] if named else None

    def schema(self) -> StructType:
        fs, at = opened(self.options["path"])
        files = named_files(fs, at)
        if not files:
            raise NotPortable(f"there are no Arrow files below {self.options['path']}", path=self.options["path"], reason="empty", remedy="give a schema")
        with fs.open_input_file(files[0][0]) as f:
            own = pa.ipc.open_file(f).schema
        check_frame(own.names)
        kept = [own.field(c) for c in self._columns() or own.names]
        return from_arrow_schema(pa.schema([pa.field(f.name, landed(pa.array([], f.type), f.name).type) for f in kept]), prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema, self._columns())

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        check_frame(schema.names)
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ArrowFiles)


def write_arrow(df: DataFrame, folder: str, mode: str = "append") -> None:
    """The frame as Arrow IPC files: strings as large_string, not-a-number kept, missing values null."""
    register(df.sparkSession)
    df.write.format("lanewise_arrow").mode(mode).option("path", folder).save()


def read_arrow(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """The frame of Arrow IPC files, all columns or these."""
    register(spark)
    reader = spark.read.format("lanewise_arrow")
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(folder)
