"""Snapshot files as a stream: a file is read again whenever it was replaced, as feeds that overwrite their export need."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a file that are read at once.
PIECE = 4 << 20


class ChangedFile(InputPartition):
    """A file that changed, with the signature under which it is read."""

    def __init__(self, path: str, signature: str):
        self.path, self.signature = path, signature


class SnapshotReader(DataSourceStreamReader):
    """Offsets are the signatures (time and size) of all files of a folder; a batch is the files whose signature is new.

    A file that is gone leaves the offsets, and would be read again if it came back.  Should a file be replaced while a batch
    reads it, its rows carry the old signature and the next batch reads it again under the new one."""

    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"], options.get("suffix", "")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, root = pf.FileSystem.from_uri(self.path)
        found = system.get_file_info(pf.FileSelector(root, recursive=True, allow_not_found=True))
        hidden = lambda f: f.base_name.startswith((".", "_"))
        return {f.path: f"{f.mtime_ns}:{f.size}" for f in sorted(found, key=lambda f: f.path) if f.type == pf.FileType.File and f.base_name.endswith(self.suffix) and not hidden(f)}

    def partitions(self, start: dict, end: dict) -> list[ChangedFile]:
        return [ChangedFile(path, signature) for path, signature in end.items() if start.get(path) != signature]

    def read(self, partition: ChangedFile) -> Iterator[pa.RecordBatch]:
        system, _ = pf.FileSystem.from_uri(self.path)
        left, line = b"", 0
        with system.open_input_stream(partition.path) as file:
            while piece := file.read(PIECE):
                *lines, left = (left + piece).split(b"\n")
                yield self._batch(partition, lines, line)
                line += len(lines)
        if left:
            yield self._batch(partition, [left], line)

    @staticmethod
    def _batch(partition: ChangedFile, lines: list[bytes], first: int) -> pa.RecordBatch:
        n = len(lines)
        text = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines]
        return pa.RecordBatch.from_arrays([pa.array([partition.path] * n, pa.string()), pa.array([partition.signature] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array(text, pa.string())], names=["file", "signature", "line", "value"])

    def commit(self, end: dict) -> None:
        pass


class SnapshotSource(DataSource):
    """``spark.readStream.format("snapshots").option("path", uri)``: (file, signature, line, value) of every line of every file
    that is new or was replaced; compressed files are opened by their ending; folders are read in whatever file system the
    URI names."""

    @classmethod
    def name(cls) -> str:
        return "snapshots"

    def schema(self) -> str:
        return "file string, signature string, line long, value string"

    def streamReader(self, schema) -> SnapshotReader:
        return SnapshotReader(self.options)


def snapshots(spark: SparkSession, uri: str, suffix: str = "") -> DataFrame:
    """The folder's files as a stream of lines."""
    spark.dataSource.register(SnapshotSource)
    return spark.readStream.format("snapshots").option("path", uri).option("suffix", suffix).load()
