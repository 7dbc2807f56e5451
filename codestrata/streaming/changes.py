"""A streaming source of the changes of a file tree: what was created, modified or deleted between two looks at it.

The tree is dealt to tasks by its folders; a task lists its own share, compares it
with its listing of the look before and gives out what differs. Listings lie in
the folder ``state`` as Parquet, one for each share and look, written once: a
batch that is run again reads its listing, it doesn't look again. The offset is
the time of the look, so the driver holds no path.
"""

from __future__ import annotations

import os
import time
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "rel_path string, change string, modified timestamp, size long, content binary"

#: Folders whose changes mean nothing.
IGNORED = (".git", "node_modules", "dist", "build", "target", "out")

_LISTING = pa.schema([("rel_path", pa.string()), ("modified", pa.int64()), ("size", pa.int64())])


class _Share(InputPartition):
    def __init__(self, number: int, start: int, end: int):
        self.number, self.start, self.end = number, start, end


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    files, path = pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")
    return files, path.rstrip("/")


class _Tree:
    """The tree below root, in shares; a share is a set of folders ``depth`` levels down, and of files above them."""

    def __init__(self, root: str, state: str, shares: int, depth: int):
        self.root, self.state, self.shares, self.depth = root, state, shares, depth

    def _mine(self, rel_path: str, number: int) -> bool:
        return zlib.crc32("/".join(rel_path.split("/")[: self.depth]).encode()) % self.shares == number

    def look(self, number: int) -> dict[str, tuple[int, int]]:
        """path: (time of change in microseconds, size) of all files of a share as they lie now."""
        files, root = _place(self.root)
        found, open_ = {}, [""]
        while open_:
            folder = open_.pop()
            for info in files.get_file_info(pafs.FileSelector(f"{root}/{folder}" if folder else root, allow_not_found=True)):
                rel_path = f"{folder}/{info.base_name}" if folder else info.base_name
                if info.type == pafs.FileType.Directory:
                    above = rel_path.count("/") + 1 < self.depth
                    if info.base_name not in IGNORED and (above or self._mine(rel_path, number)):
                        open_.append(rel_path)
                elif self._mine(rel_path, number):
                    found[rel_path] = ((info.mtime_ns or 0) // 1000, info.size)
        return found

    def _listing(self, number: int, at: int) -> str:
        return f"{at:015}/share-{number}.parquet"

    def kept(self, number: int, at: int) -> dict[str, tuple[int, int]] | None:
        files, state = _place(self.state)
        path = f"{state}/{self._listing(number, at)}"
        if files.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        t = pq.read_table(path, filesystem=files)
        return dict(zip(t["rel_path"].to_pylist(), zip(t["modified"].to_pylist(), t["size"].to_pylist())))

    def keep(self, number: int, at: int) -> dict[str, tuple[int, int]]:
        """The share's listing of a look, made if there is none. Of two tasks that make it the first one's stays (on stores whose rename doesn't replace)."""
        found = self.kept(number, at)
        if found is not None:
            return found
        files, state = _place(self.state)
        rows = sorted((p, *v) for p, v in self.look(number).items())
        table = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else ([], [], []), _LISTING)], schema=_LISTING)
        own, path = f"{state}/pending/{uuid.uuid4().hex}", f"{state}/{self._listing(number, at)}"
        files.create_dir(os.path.dirname(own), recursive=True)
        files.create_dir(os.path.dirname(path), recursive=True)
        pq.write_table(table, own, filesystem=files)
        try:
            if isinstance(files, pafs.LocalFileSystem):
                os.link(own, path)  # a move would replace
                files.delete_file(own)
            else:
                files.move(own, path)
        except OSError:
            if files.get_file_info(path).type == pafs.FileType.NotFound:
                raise
            files.delete_file(own)
        return self.kept(number, at)

    def forget(self, before: int) -> None:
        files, state = _place(self.state)
        for info in files.get_file_info(pafs.FileSelector(state, allow_not_found=True)):
            if info.base_name.isdigit() and int(info.base_name) < before:
                files.delete_dir(info.path)

    def content(self, rel_path: str) -> bytes | None:
        """None if the file has gone since: the next look tells."""
        files, root = _place(self.root)
        try:
            with files.open_input_stream(f"{root}/{rel_path}") as f:
                return f.read()
        except FileNotFoundError:
            return None


class _Looks(DataSourceStreamReader):
    def __init__(self, tree: _Tree, content: bool):
        self.tree, self.with_content = tree, content

    def initialOffset(self) -> dict:
        return {"time": 0}

    def latestOffset(self) -> dict:
        return {"time": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[_Share]:
        return [_Share(i, start["time"], end["time"]) for i in range(self.tree.shares)]

    def read(self, partition: _Share) -> Iterator[tuple]:
        from datetime import datetime, timezone

        old = self.tree.kept(partition.number, partition.start) if partition.start else {}
        if old is None:
            raise ValueError(f"the listing of {partition.start} has gone from {self.tree.state}; a new checkpoint is needed")
        new = self.tree.keep(partition.number, partition.end)
        for path in sorted(old.keys() | new.keys()):
            if old.get(path) == new.get(path):
                continue
            change = "created" if path not in old else "modified" if path in new else "deleted"
            modified, size = new.get(path) or (None, None)
            when = None if modified is None else datetime.fromtimestamp(modified / 1e6, timezone.utc)
            yield path, change, when, size, self.tree.content(path) if self.with_content and path in new else None

    def commit(self, end: dict) -> None:
        self.tree.forget(end["time"])


class FileChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        o = self.options
        tree = _Tree(o["path"], o["state"], int(o.get("shares", 16)), int(o.get("depth", 2)))
        return _Looks(tree, o.get("content", "false").lower() == "true")


def watch_changes(spark: SparkSession, root: str, state: str, shares: int = 16, depth: int = 2, content: bool = False) -> DataFrame:
    """A stream of (rel_path, change, modified, size, content): created, modified or deleted files below root since the look before.

    A batch is one look, so the trigger's interval is that of looking. A file
    that changes several times between two looks is one change; a renamed one is
    deleted and created; one that changes again is given out again. The first
    look gives all files as created. An edit that leaves size and time of change
    as they were isn't seen. Folders of names in IGNORED are passed over, an
    empty or missing root has no files. ``content`` is read when the change is
    given out. ``state`` has to be shared by driver and executors, outside of
    root, and one stream's own, as its checkpoint is. A share of the tree, by
    hash of its folders ``depth`` levels down, is listed by one task.
    """
    spark.dataSource.register(FileChanges)
    return spark.readStream.format("file_changes").option("path", root).option("state", state).options(shares=shares, depth=depth, content=content).load()
