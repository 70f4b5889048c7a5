"""A message log as a stream source with offsets of its own: what a channel sends, and what its peer reads.

A log is a folder that the driver and all executors share. Each append is one segment, a small Arrow file that appears whole under the next
number; appending starts no job and waits for nobody. A stream over the log counts its offsets in segments and takes at most a quantum of
them at once, so what a peer is given is bounded however far the log is ahead. Segments go once the stream has committed them.

    spark.readStream.format("lanewise_log").schema(schema).option("path", folder).option("quantum", 4).load()
"""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lanewise.session import ship
from lanewise.sources.arrow_files import opened

#: The file that says how far a stream has been given the log.
ADMITTED = "_admitted"


def segments(fs: pafs.FileSystem, at: str) -> list[int]:
    """The numbers of the segments that are there, ascending."""
    found = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
    return sorted(int(f.base_name.removesuffix(".arrow")) for f in found if f.base_name.endswith(".arrow"))


def admitted(fs: pafs.FileSystem, at: str) -> int:
    if fs.get_file_info(f"{at}/{ADMITTED}").type != pafs.FileType.File:
        return 0
    with fs.open_input_stream(f"{at}/{ADMITTED}") as f:
        return json.loads(f.read())["segment"]


class Log:
    """The sending end of a log; there is one for a folder at a time."""

    def __init__(self, folder: str, schema: StructType):
        self.fs, self.at = opened(folder)
        self.fs.create_dir(self.at, recursive=True)
        self.kinds, self.lock = to_arrow_schema(schema), threading.Lock()
        there = segments(self.fs, self.at)
        self.next = max(there[-1] + 1 if there else 0, admitted(self.fs, self.at))
        #: Messages of each segment of this process, until it is handled.
        self.sizes: dict[int, int] = {}

    def append(self, rows: list[tuple]) -> int:
        """The number of the segment that now holds these messages."""
        columns = list(zip(*rows, strict=True))
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.kinds, strict=True)], schema=self.kinds)
        with self.lock:
            k = self.next
            draft = f"{self.at}/.{k:020d}"
            with self.fs.open_output_stream(draft) as sink, pa.ipc.new_file(sink, self.kinds) as f:
                f.write_batch(batch)
            self.sizes[k] = len(rows)
            self.fs.move(draft, f"{self.at}/{k:020d}.arrow")
            self.next = k + 1
        return k

    def handled(self, until: int) -> int:
        """How many messages of this process lie below a segment and had not been counted yet."""
        with self.lock:
            return sum(self.sizes.pop(k) for k in sorted(self.sizes) if k < until)


@dataclass
class Segment(InputPartition):
    number: int


class LogReader(DataSourceStreamReader):
    def __init__(self, folder: str, schema: StructType, quantum: int):
        self.folder, self.kinds, self.quantum, self.given = folder, to_arrow_schema(schema), quantum, None

    def initialOffset(self) -> dict:
        return {"segment": 0}

    def latestOffset(self) -> dict:
        """A quantum beyond what the stream has been given, as far as the log goes."""
        fs, at = opened(self.folder)
        if self.given is None:
            self.given = admitted(fs, at)
        there = segments(fs, at)
        end = max(there[-1] + 1 if there else 0, self.given)
        return {"segment": min(end, self.given + self.quantum)}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        fs, at = opened(self.folder)
        if self.given is None or end["segment"] > self.given:
            self.given = end["segment"]
            with fs.open_output_stream(f"{at}/.{ADMITTED}") as f:
                f.write(json.dumps(end).encode())
            fs.move(f"{at}/.{ADMITTED}", f"{at}/{ADMITTED}")
        there = set(segments(fs, at))
        return [Segment(k) for k in range(start["segment"], end["segment"]) if k in there]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        fs, at = opened(self.folder)
        with fs.open_input_file(f"{at}/{partition.number:020d}.arrow") as f:
            file = pa.ipc.open_file(f)
            for k in range(file.num_record_batches):
                yield file.get_batch(k).cast(self.kinds)

    def commit(self, end: dict) -> None:
        fs, at = opened(self.folder)
        for k in segments(fs, at):
            if k < end["segment"]:
                fs.delete_file(f"{at}/{k:020d}.arrow")


class MessageLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lanewise_log"

    def streamReader(self, schema: StructType) -> LogReader:
        return LogReader(self.options["path"], schema, int(self.options.get("quantum", 1)))


def read_log(spark: SparkSession, folder: str, schema: StructType | str, quantum: int = 1) -> DataFrame:
    """The log as a streaming frame, at most so many segments a batch."""
    ship(spark)
    spark.dataSource.register(MessageLog)
    return spark.readStream.format("lanewise_log").schema(schema).option("path", folder).option("quantum", quantum).load()
