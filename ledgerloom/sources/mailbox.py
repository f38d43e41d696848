"""A mailbox as a source: folders of message pages, as a batch and as a stream.

A mailbox is listed page by page. The pages lie in the files of a folder, one JSON object a line::

    {"messages": [{"id": "7", "user_id": "u", "labelIds": ["UNREAD"], ...}, ...], "nextPageToken": "..."}

``spark.read.format("mailbox_pages").load(path)`` gives one row a message: ``id``, ``user_id``, ``labels`` (all labels, each
between commas, so that one is tested with ``contains``), and ``message``, the message as JSON. Tests of ``labels``, ``id`` and
``user_id`` are pushed into the source, which leaves out messages before they are handed to Spark.

A file is one partition and is read line by line, so a task holds one page at a time. As a stream, the source takes up
files in the order of their paths; a later file needs a greater path, such as a folder for each sync. Files are opened through
pyarrow, which knows local folders and the common object stores; hidden files and folders are passed over.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringContains,
)

from .. import schemas

FORMAT = "mailbox_pages"
_COLUMNS = ("id", "user_id", "labels", "message")
ROWS = 1024  # of a batch


class PageFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return pafs.LocalFileSystem(), uri


def page_files(uri: str) -> list[str]:
    """Paths of the files below the folder, relative to it, in order. An absent folder is an empty mailbox."""
    system, base = _opened(uri)
    found = system.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
    paths = [posixpath.relpath(f.path, base) for f in found if f.type == pafs.FileType.File]
    return sorted(p for p in paths if not any(part.startswith(("_", ".")) for part in p.split("/")))


def _test(pushed: Filter):
    """The pushed filter as a test of a row, or None for one that is left to Spark."""
    if not isinstance(pushed, (EqualTo, In, StringContains)) or len(pushed.attribute) != 1 or pushed.attribute[0] not in _COLUMNS[:3]:
        return None
    name, value = pushed.attribute[0], pushed.value
    if isinstance(pushed, EqualTo):
        return name, "equal", value
    if isinstance(pushed, In):
        return name, "in", frozenset(value)
    return name, "contains", value


def _passes(row: dict, tests: list[tuple]) -> bool:
    for name, kind, value in tests:
        own = row[name]
        if own is None or not (own == value if kind == "equal" else own in value if kind == "in" else value in own):
            return False
    return True


def _messages(uri: str, path: str, tests: list[tuple]) -> Iterator[pa.RecordBatch]:
    system, base = _opened(uri)
    schema = pa.schema([(c, pa.string()) for c in _COLUMNS])
    held: list[dict] = []
    with system.open_input_stream(posixpath.join(base, path)) as raw:
        for line in _lines(raw):
            for message in json.loads(line).get("messages") or []:
                labels = message.get("labelIds")
                row = {
                    "id": message.get("id"),
                    "user_id": message.get("user_id"),
                    "labels": None if labels is None else "," + "".join(f"{label}," for label in labels),
                }
                if _passes(row, tests):
                    held.append({**row, "message": json.dumps(message)})
            if len(held) >= ROWS:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _lines(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """Non-blank lines of a stream; holds one line and one block."""
    rest = b""
    while block := stream.read(size):
        *whole, rest = (rest + block).split(b"\n")
        yield from (line for line in whole if line.strip())
    if rest.strip():
        yield rest


class MailboxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in _COLUMNS)

    def reader(self, schema) -> DataSourceReader:
        return MailboxReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return MailboxStreamReader(self.options["path"])


class MailboxReader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri, self.tests = uri, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for pushed in filters:
            test = _test(pushed)
            if test is None:
                yield pushed
            else:
                self.tests.append(test)

    def partitions(self) -> list[PageFile]:
        return [PageFile(p) for p in page_files(self.uri)]

    def read(self, partition: PageFile) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from _messages(self.uri, partition.path, self.tests)


class MailboxStreamReader(DataSourceStreamReader):
    """Offsets are paths: all files up to it have been taken up."""

    def __init__(self, uri: str):
        self.uri = uri

    def initialOffset(self) -> dict:
        return {"upto": ""}

    def latestOffset(self) -> dict:
        return {"upto": max(page_files(self.uri), default="")}

    def partitions(self, start: dict, end: dict) -> list[PageFile]:
        return [PageFile(p) for p in page_files(self.uri) if start["upto"] < p <= end["upto"]]

    def read(self, partition: PageFile) -> Iterator[pa.RecordBatch]:
        yield from _messages(self.uri, partition.path, [])

    def commit(self, end: dict) -> None:
        """Pages stay where they are."""


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(MailboxSource)
    return spark


def _typed(rows: DataFrame, label: str | None, folder: str | None) -> DataFrame:
    for wanted in (label, folder):
        if wanted:
            rows = rows.filter(F.col("labels").contains(f",{wanted},"))
    parsed = rows.select(*_COLUMNS[:2], F.from_json("message", schemas.MESSAGE_DDL).alias("m"))
    # ids come from the source, so that tests of them reach it
    return parsed.select(*[F.col(c if c in _COLUMNS[:2] else f"m.{c}").alias(c) for c in schemas.struct(schemas.MESSAGE_DDL).names])


def read_mailbox(spark: SparkSession, path: str, label: str | None = "UNREAD", folder: str | None = None) -> DataFrame:
    """Messages of all pages that carry the labels, with the columns of the message table."""
    return _typed(_registered(spark).read.format(FORMAT).load(path), label, folder)


def stream_mailbox(spark: SparkSession, path: str, label: str | None = "UNREAD", folder: str | None = None) -> DataFrame:
    """The same as a stream; labels are tested by Spark."""
    return _typed(_registered(spark).readStream.format(FORMAT).load(path), label, folder)


def write_pages(messages: DataFrame, path: str, page: int = 100) -> None:
    """Store messages as pages of ``page`` each: what a sync of the mailbox leaves behind. Each task pages its own rows."""

    def paged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = frame["message"].tolist()
            yield pd.DataFrame({"value": ['{"messages":[' + ",".join(own[i : i + page]) + "]}" for i in range(0, len(own), page)]})

    messages.select(F.to_json(F.struct(*messages.columns)).alias("message")).mapInPandas(paged, "value string").write.text(path)
