"""A stream of the changes of a folder of files: what was added, changed and removed between two listings."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


def _opened(uri: str):
    """A file system and a path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class FolderChanges(DataSource):
    """``folder_changes``: options ``path``, the folder, and ``listings``, a folder of its own for the listings.

    An offset is the number of a listing, which is kept as a file, so that a batch can be made again after a restart and
    the checkpoint stays small. A listing holds size and time of change of each file; whoever has neither the same is
    changed. A listing like the last one is no new offset. Only the newest listings are kept.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return "path string, change_type string, version long"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Reader(self.options)


class _Reader(SimpleDataSourceStreamReader):
    KEPT = 3

    def __init__(self, options: dict[str, str]):
        self.path, self.listings = options["path"], options["listings"].rstrip("/")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"version": 0}

    def _kept(self, version: int) -> dict[str, list[int]]:
        if version == 0:
            return {}
        files, top = _opened(self.listings)
        with files.open_input_stream(f"{top}/{version}.json") as f:
            return json.loads(f.read())

    def _now(self) -> dict[str, list[int]]:
        from pyarrow import fs

        files, top = _opened(self.path)
        found = files.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
        return {x.path[len(top) :].lstrip("/"): [x.size, x.mtime_ns or 0] for x in found if x.is_file}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        before, now = self._kept(start["version"]), self._now()
        if before == now:
            return iter(()), start
        version = start["version"] + 1
        files, top = _opened(self.listings)
        files.create_dir(top, recursive=True)
        with files.open_output_stream(f"{top}/{version}.json") as f:
            f.write(json.dumps(now).encode())
        return iter(_changes(before, now, version)), {"version": version}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(_changes(self._kept(start["version"]), self._kept(end["version"]), end["version"]))

    def commit(self, end: dict) -> None:
        files, top = _opened(self.listings)
        old = end["version"] - self.KEPT
        if old > 0 and files.get_file_info(f"{top}/{old}.json").is_file:
            files.delete_file(f"{top}/{old}.json")


def _changes(before: dict, now: dict, version: int) -> list[tuple]:
    added = [(p, "add", version) for p in now.keys() - before.keys()]
    changed = [(p, "change", version) for p in now.keys() & before.keys() if now[p] != before[p]]
    return sorted(added + changed + [(p, "unlink", version) for p in before.keys() - now.keys()])


def watch_folder(spark: SparkSession, path: str, listings: str) -> DataFrame:
    """A stream ``(path, change_type, version)`` of a folder's files; paths are relative to it."""
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").option("path", path).option("listings", listings).load()
