"""Data sources for ``spark.read.format`` and ``spark.readStream.format``: folders of archives, and dumps of package registries.

A file is a partition. Archives are read member by member from a stream, so a task holds one member of at most ``most_bytes`` bytes, whatever the
archive's size. A stream's offset is the last file (time of change, path) that was listed; files are taken in that order, ``files_per_batch`` at a time.
"""

from __future__ import annotations

import fnmatch
import gzip
import io
import json
import tarfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .readers import MOST_BYTES, safe_member
from .registries import FORMATS

ROWS = 200


class FilePartition(InputPartition):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size


def listed(path: str, pattern: str) -> list[tuple[int, str, int]]:
    """(time of change, path, size) of a folder's files, at any depth, in order; of a file, its own."""
    fs, inside = pafs.FileSystem.from_uri(path)
    found = fs.get_file_info(inside)
    infos = [found] if found.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(inside, recursive=True)) if found.type == pafs.FileType.Directory else []
    return sorted((i.mtime_ns or 0, i.path, i.size) for i in infos if i.type == pafs.FileType.File and fnmatch.fnmatch(i.base_name, pattern))


class _Files:
    """What the readers of both kinds of source share."""

    def __init__(self, options: dict[str, str], names: list[str], kinds: list):
        self.uri, self.pattern = options["path"], options.get("pattern", "*")
        self.per_batch, self.options, self.names, self.kinds = int(options.get("files_per_batch", 100)), dict(options), names, kinds

    def open(self, partition: FilePartition):
        fs, _ = pafs.FileSystem.from_uri(self.uri)
        return fs.open_input_stream(partition.path, compression=None)

    def rows(self, partition: FilePartition) -> Iterator[tuple]:
        raise NotImplementedError

    def read(self, partition: FilePartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without files
            return
        held: list[tuple] = []
        size = 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held), self.kinds)], self.names)

        for row in self.rows(partition):
            held.append(row)
            size += sum(len(v) for v in row if isinstance(v, str))
            if len(held) >= ROWS or size >= 4 << 20:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()


class _Batch(_Files, DataSourceReader):
    def partitions(self) -> list[FilePartition]:
        return [FilePartition(p, n) for _, p, n in listed(self.uri, self.pattern)]


class _Stream(_Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        if not hasattr(self, "at"):
            self.at = self.initialOffset()
        new = [f for f in listed(self.uri, self.pattern) if f[:2] > (self.at["time"], self.at["path"])][: self.per_batch]
        if new:
            self.at = {"time": new[-1][0], "path": new[-1][1]}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[FilePartition]:
        self.at = end
        return [FilePartition(p, n) for t, p, n in listed(self.uri, self.pattern) if (start["time"], start["path"]) < (t, p) <= (end["time"], end["path"])]

    def commit(self, end: dict) -> None:
        self.at = max(self.at, end, key=lambda o: (o["time"], o["path"]))


class _Members:
    """S3: the files of tar archives, plain or compressed; members that would leave the folder and links are passed over, and those above ``most_bytes`` have
    no text. An archive that breaks off gives what came before, then a row without a member that says so."""

    def rows(self, partition: FilePartition) -> Iterator[tuple]:
        most = int(self.options.get("most_bytes", MOST_BYTES))
        with self.open(partition) as raw:
            try:
                with tarfile.open(fileobj=raw, mode="r|*") as tar:
                    for m in tar:
                        if m.isfile() and safe_member(m.name):
                            text = tar.extractfile(m).read().decode("utf-8", "replace") if m.size <= most else None
                            yield partition.path, m.name, m.size, text, None
            except (tarfile.TarError, EOFError, OSError) as x:
                yield partition.path, None, None, None, f"{type(x).__name__}: {x}"


class ArchiveBatch(_Members, _Batch):
    pass


class ArchiveStream(_Members, _Stream):
    pass


class Archives(DataSource):
    """``spark.read.format("archives").load(folder)``; options: ``pattern`` of file names, ``most_bytes`` of a member."""

    NAMES, KINDS = ["archive", "member", "size", "text", "error"], [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return "archive string, member string, size long, text string, error string"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveBatch(self.options, self.NAMES, self.KINDS)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ArchiveStream(self.options, self.NAMES, self.KINDS)


class _Entries:
    """The entries of a registry's dump: one JSON document, an array of them, or one a line; gzip by the name's end. What is no JSON is passed over."""

    def rows(self, partition: FilePartition) -> Iterator[tuple]:
        parse = FORMATS[self.options["registry"]]
        with self.open(partition) as raw:
            text = gzip.open(raw) if partition.path.endswith(".gz") else io.BufferedReader(raw)
            lines = partition.path.removesuffix(".gz").endswith((".jsonl", ".ndjson"))
            for data in text if lines else [text.read()]:
                try:
                    found = json.loads(data)
                except ValueError:
                    continue
                for d in found if isinstance(found, list) else [found]:
                    if isinstance(d, dict):
                        yield from parse(d)


class RegistryBatch(_Entries, _Batch):
    pass


class RegistryStream(_Entries, _Stream):
    pass


class Registry(DataSource):
    """``spark.read.format("registry").option("registry", "npm").load(folder)``; registries: the keys of ``registries.FORMATS``."""

    NAMES = ["ecosystem", "identifier", "canonical", "display", "description", "keywords", "repository", "classes"]
    KINDS = [pa.string()] * 5 + [pa.list_(pa.string()), pa.string(), pa.list_(pa.string())]

    @classmethod
    def name(cls) -> str:
        return "registry"

    def schema(self) -> str:
        return "ecosystem string, identifier string, canonical string, display string, description string, keywords array<string>, repository string, classes array<string>"

    def reader(self, schema) -> DataSourceReader:
        return RegistryBatch(self.options, self.NAMES, self.KINDS)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return RegistryStream(self.options, self.NAMES, self.KINDS)


def register(spark: SparkSession) -> None:
    """Make both sources known to a session."""
    for source in (Archives, Registry):
        spark.dataSource.register(source)
