"""Job progress events in a folder, as a source and sink of batches and streams.

A writer commits its micro-batches one by one: files of JSON lines first, then a file that
names them. Readers see what has been committed, and a batch that is written again after a
failure replaces itself. A stream's offset is the last batch read of every writer.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.json as pa_json
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceStreamWriter,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

FORMAT = "job_events"
MESSAGE = pa.schema([("channel", pa.string()), ("value", pa.string())])
# Lines a task gathers before it writes a file of them.
FILE_LINES = 100_000


class Folder:
    """The committed batches of a folder of events."""

    def __init__(self, options) -> None:
        self.uri = options["path"]
        self.system, self.path = fs.FileSystem.from_uri(self.uri)

    def put(self, name: str, data: bytes) -> None:
        """Write a file under another name and move it into place."""
        target = f"{self.path}/{name}"
        parent, _, last = target.rpartition("/")
        self.system.create_dir(parent, recursive=True)
        draft = f"{parent}/.{last}-{uuid.uuid4().hex}"
        with self.system.open_output_stream(draft) as out:
            out.write(data)
        self.system.move(draft, target)

    def get(self, name: str) -> bytes:
        with self.system.open_input_stream(f"{self.path}/{name}") as data:
            return data.read()

    def commits(self) -> dict[str, list[int]]:
        """Numbers of the batches of every writer, in order."""
        found = self.system.get_file_info(fs.FileSelector(f"{self.path}/commits", allow_not_found=True))
        out: dict[str, list[int]] = {}
        for name in sorted(info.base_name for info in found):
            if not name.startswith("."):
                batch, _, writer = name.partition("-")
                out.setdefault(writer, []).append(int(batch))
        return out

    def files(self, writer: str, batch: int) -> list[str]:
        return json.loads(self.get(f"commits/{batch:012d}-{writer}"))

    def commit(self, writer: str, batch: int, files: list[str]) -> None:
        self.put(f"commits/{batch:012d}-{writer}", json.dumps(sorted(files)).encode())


@dataclass
class EventFile(InputPartition):
    name: str


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def read_file(options, name: str) -> Iterator[pa.RecordBatch]:
    data = Folder(options).get(name)
    if data:
        parse = pa_json.ParseOptions(explicit_schema=MESSAGE, unexpected_field_behavior="ignore")
        yield from pa_json.read_json(io.BytesIO(data), parse_options=parse).select(["channel", "value"]).to_batches()


def write_files(options, rows, place: str) -> Written:
    """Rows of one task as files of JSON lines."""
    folder, files, lines = Folder(options), [], []

    def flush():
        if lines:
            files.append(f"files/{place}-{uuid.uuid4().hex}.json")
            folder.put(files[-1], "".join(lines).encode())
            lines.clear()

    for channel, value in rows:
        lines.append(json.dumps({"channel": channel, "value": value}) + "\n")
        if len(lines) >= FILE_LINES:
            flush()
    flush()
    return Written(files)


class EventReader(DataSourceReader):
    """All committed batches."""

    def __init__(self, options) -> None:
        self.options = options

    def partitions(self):
        folder = Folder(self.options)
        every = folder.commits().items()
        return [EventFile(name) for writer, batches in every for batch in batches for name in folder.files(writer, batch)]

    def read(self, partition):
        if partition is not None:
            yield from read_file(self.options, partition.name)


class EventStreamReader(DataSourceStreamReader):
    """Committed batches after those that have been read."""

    def __init__(self, options) -> None:
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {writer: batches[-1] for writer, batches in Folder(self.options).commits().items()}

    def partitions(self, start: dict, end: dict):
        folder = Folder(self.options)
        out = []
        for writer, batches in folder.commits().items():
            due = [b for b in batches if start.get(writer, -1) < b <= end.get(writer, -1)]
            out += [EventFile(name) for batch in due for name in folder.files(writer, batch)]
        return out

    def read(self, partition):
        yield from read_file(self.options, partition.name)

    def commit(self, end: dict) -> None:
        """Files stay for other readers."""


class EventWriter(DataSourceWriter):
    """One more batch of a writer."""

    def __init__(self, options) -> None:
        self.options = options
        self.writer = options.get("writer", "main")

    def write(self, iterator):
        return write_files(self.options, ((row[0], row[1]) for row in iterator), self.writer)

    def commit(self, messages) -> None:
        folder = Folder(self.options)
        batch = folder.commits().get(self.writer, [-1])[-1] + 1
        folder.commit(self.writer, batch, [name for m in messages if m for name in m.files])

    def abort(self, messages) -> None:
        """Files that no commit names are not read."""


class EventStreamWriter(DataSourceStreamWriter):
    """The micro-batches of a stream, each under its own number."""

    def __init__(self, options) -> None:
        self.options = options
        self.writer = options.get("writer", "main")

    def write(self, iterator):
        return write_files(self.options, ((row[0], row[1]) for row in iterator), self.writer)

    def commit(self, messages, batchId: int) -> None:  # noqa: N803
        names = [name for m in messages if m for name in m.files]
        Folder(self.options).commit(self.writer, batchId, names)

    def abort(self, messages, batchId: int) -> None:  # noqa: N803
        """Files that no commit names are not read."""


class EventSource(DataSource):
    """Messages (channel, value) of the folder ``path``; ``writer`` names who writes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "channel string, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return EventReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return EventStreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("events are only appended")
        return EventWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return EventStreamWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(EventSource)
