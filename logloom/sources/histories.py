"""Histories as they grow: a Spark data source of the files of a folder, for batches and for streams.

A stream's offset is the number of a listing, which the source keeps in a folder of the stream's own: names, sizes and times of all files. What lies between two
listings are the files that are new in the later one, or of another size or time. A file's row tells the hash of as many bytes as the listing saw, so that a batch
that is run again after a failure gives the same rows although the file has grown since; what has been added comes with a later listing.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, size long, raw_hash string"
_CHUNK = 1 << 20


def _system(path: str):
    """(file system, path in it, what stands before it in a file's name)."""
    from pyarrow import fs

    if path.startswith("file:/"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, "file://" if path.startswith("/") else path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"


def listing(path: str, glob: str) -> dict[str, list[int]]:
    """{file: [size, time]} of the files whose names fit, in all folders below path but those whose names begin with a dot or an underscore, by name."""
    from pyarrow import fs

    system, inner, before = _system(path)
    found = {}
    for info in system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True)):
        below = info.path[len(inner) :].strip("/").split("/")
        if info.type == fs.FileType.File and fnmatch.fnmatchcase(below[-1], glob) and not any(x[:1] in "._" for x in below):
            found[before + info.path] = [info.size, info.mtime_ns or 0]
    return dict(sorted(found.items()))


def hashed(files: list[tuple[str, int]]) -> Iterator[tuple[str, int, str]]:
    """(file, size, SHA-256 of its first `size` bytes); a file that is gone meanwhile gives nothing."""
    for name, size in files:
        system, inner, _ = _system(name)
        try:
            h, left = hashlib.sha256(), size
            with system.open_input_stream(inner) as f:
                while left > 0 and (part := f.read(min(left, _CHUNK))):
                    h.update(part)
                    left -= len(part)
        except FileNotFoundError:
            continue
        yield name, size, h.hexdigest()


class FileGroup(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


def _groups(files: dict[str, list[int]], most: int) -> list[FileGroup]:
    rows = [(name, at[0]) for name, at in files.items()]
    return [FileGroup(rows[i : i + most]) for i in range(0, len(rows), most)] or [FileGroup([])]


class HistorySource(DataSource):
    """Options: path; glob (of names, `*.jsonl`); files (in a task, 1000); state (of streams: a folder of their own that outlives them)."""

    @classmethod
    def name(cls) -> str:
        return "logloom_histories"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.glob, self.most = options["path"], options.get("glob", "*.jsonl"), int(options.get("files", "1000"))

    def partitions(self):
        return _groups(listing(self.path, self.glob), self.most)

    def read(self, partition):
        return hashed(partition.files)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        if "state" not in options:
            raise ValueError("a stream of histories needs the option state, a folder of its own")
        self.path, self.glob, self.most, self.state = options["path"], options.get("glob", "*.jsonl"), int(options.get("files", "1000")), options["state"].rstrip("/")

    def _numbers(self) -> list[int]:
        from pyarrow import fs

        system, inner, _ = _system(self.state)
        names = [i.base_name for i in system.get_file_info(fs.FileSelector(inner, allow_not_found=True))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def _listing(self, number: int) -> dict[str, list[int]]:
        if not number:
            return {}
        system, inner, _ = _system(self.state)
        with system.open_input_stream(f"{inner}/{number}.json") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        """The last listing's number, or the next one's where something has changed since."""
        numbers = self._numbers()
        last = numbers[-1] if numbers else 0
        now = listing(self.path, self.glob)
        if now == self._listing(last):
            return {"listing": last}
        system, inner, _ = _system(self.state)
        system.create_dir(inner)
        with system.open_output_stream(f"{inner}/.{last + 1}") as f:
            f.write(json.dumps(now).encode())
        system.move(f"{inner}/.{last + 1}", f"{inner}/{last + 1}.json")
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict):
        before = self._listing(start["listing"])
        return _groups({name: at for name, at in self._listing(end["listing"]).items() if before.get(name) != at}, self.most)

    def read(self, partition):
        return hashed(partition.files)

    def commit(self, end: dict) -> None:
        """Listings before the last that is done with are not needed again."""
        system, inner, _ = _system(self.state)
        for n in self._numbers():
            if n < end["listing"]:
                system.delete_file(f"{inner}/{n}.json")
