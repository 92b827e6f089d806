"""Data sources that read files by ranges: digests of whole files, records of login files, first bytes.

Paths are local ones, file:// or any other that pyarrow.fs knows (hdfs://, s3://, gs://). The driver lists names and sizes; tasks
open files at the ranges they are given and hold one chunk at a time, so files may be of any size.
"""

from __future__ import annotations

import fnmatch
import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that a task holds of a file, and bytes and files that one task is given.
CHUNK = 1 << 22
TASK_BYTES, TASK_FILES = 128 << 20, 1000
HEAD = 512


@dataclass
class Part(InputPartition):
    """Ranges (path, first byte, byte after the last, size of the file, time of change in seconds)."""

    ranges: list[tuple[str, int, int, int, float]]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it. Names stand as they are, without %20 and the like."""
    found = re.match(r"([a-z0-9]+:(?://[^/]*)?)(/.*)?$", path)
    if not found:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(("file://" if found[1] == "file:" else found[1]) + quote(found[2] or "/"))


def listed(path: str, glob: str = "*") -> list[tuple[str, int, float]]:
    """(path as ``opened`` takes it, size, time of change) of a file, or of all files below a folder whose name fits ``glob``."""
    system, at = opened(path)
    head = path.removesuffix(at) if path.endswith(at) else ""
    own = system.get_file_info(at)
    if own.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = [own] if own.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((head + i.path, i.size, i.mtime_ns / 1e9 if i.mtime_ns is not None else 0.0) for i in infos if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, glob))


def dealt(ranges: list[tuple[str, int, int, int, float]]) -> list[Part]:
    """Ranges in tasks of about TASK_BYTES and at most TASK_FILES."""
    parts, held = [], 0
    for r in ranges:
        if not parts or held + r[2] - r[1] > TASK_BYTES or len(parts[-1].ranges) >= TASK_FILES:
            parts.append(Part([]))
            held = 0
        parts[-1].ranges.append(r)
        held += r[2] - r[1]
    return parts


def chunks(path: str, first: int, end: int, size: int = CHUNK) -> Iterator[bytes]:
    system, at = opened(path)
    with system.open_input_file(at) as f:
        while first < end:
            data = f.read_at(min(size, end - first), first)
            if not data:
                raise OSError(f"{path} ends at byte {first}, before {end}")
            yield data
            first += len(data)


class _Files(DataSource):
    """Options: path, pathGlobFilter."""

    def files(self) -> list[tuple[str, int, float]]:
        return listed(self.options["path"], self.options.get("pathglobfilter", "*"))


class _Digests(DataSourceReader):
    def __init__(self, files: list[tuple[str, int, float]]):
        self.files = files

    def partitions(self) -> list[Part]:
        return dealt([(p, 0, n, n, t) for p, n, t in self.files]) or [Part([])]

    def read(self, part: Part) -> Iterator[tuple]:
        for path, first, end, size, changed in part.ranges:
            md5, sha256 = hashlib.md5(usedforsecurity=False), hashlib.sha256()
            for data in chunks(path, first, end):
                md5.update(data)
                sha256.update(data)
            yield path, size, changed, md5.hexdigest(), sha256.hexdigest()


class FileDigests(_Files):
    """MD5 and SHA-256 of whole files, each fed chunk by chunk in one task; a digest can't be cut, but small files share a task."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "file string, size long, changed double, md5 string, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return _Digests(self.files())


class _Heads(_Digests):
    def read(self, part: Part) -> Iterator[tuple]:
        for path, _, _, size, changed in part.ranges:
            yield path, size, changed, b"".join(chunks(path, 0, min(size, HEAD)))

    def partitions(self) -> list[Part]:
        return dealt([(p, 0, min(n, HEAD), n, t) for p, n, t in self.files]) or [Part([])]


class FileHeads(_Files):
    """The first 512 bytes of each file, read by range."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "file string, size long, changed double, head binary"

    def reader(self, schema) -> DataSourceReader:
        return _Heads(self.files())


#: Layouts of login records by size: 400 bytes with long times, 384 with short ones; and of the last logins, one for each user number.
LAYOUTS = {400: struct.Struct("<h2xi32s4s32s256shhqqq4i20s4x"), 384: struct.Struct("<h2xi32s4s32s256shhiii4i20s"), 292: struct.Struct("<i32s256s")}
LOGIN_NAMES, LOGIN_ENDS = ("wtmp", "btmp", "utmp", "utmpdb", "lastlog"), (".wtmp", ".btmp")
LOGIN_KINDS = {2: "system_boot", 7: "auth_success", 8: "session_closed"}


def is_login_file(name: str) -> bool:
    return name.lower() in LOGIN_NAMES or name.lower().endswith(LOGIN_ENDS)


def record_size(name: str, size: int) -> int:
    """By name for last logins, else the size that divides the file's, the longer one first; 384 where neither does."""
    return 292 if name.lower() == "lastlog" else 400 if size and size % 400 == 0 else 384


class _Logins(DataSourceReader):
    def __init__(self, files: list[tuple[str, int, float]]):
        self.files = [f for f in files if is_login_file(f[0].rpartition("/")[2])]

    def partitions(self) -> list[Part]:
        ranges = []
        for path, size, changed in self.files:
            each = record_size(path.rpartition("/")[2], size)
            whole, step = size - size % each, max(1, TASK_BYTES // each) * each
            ranges += [(path, a, min(a + step, whole), size, changed) for a in range(0, whole, step)]
        return dealt(ranges) or [Part([])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        text = lambda b: b.split(b"\0", 1)[0].decode("utf-8", "replace").strip()
        for path, first, end, size, _ in part.ranges:
            name = path.rpartition("/")[2].lower()
            each = record_size(name, size)
            layout, nr = LAYOUTS[each], first // each
            for data in chunks(path, first, end, CHUNK // each * each):
                rows = []
                for r in layout.iter_unpack(data):
                    nr += 1
                    if each == 292:
                        if r[0]:
                            rows.append((path, nr, r[0], "auth_success", str(nr - 1), text(r[1]), text(r[2]), None))
                    elif r[0] in LOGIN_KINDS and (user := text(r[4])):
                        rows.append((path, nr, r[9], "auth_failure" if "btmp" in name else LOGIN_KINDS[r[0]], user, text(r[2]), text(r[5]), str(r[1])))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string())
                columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], LOGIN_FIELDS)


LOGIN_FIELDS = ["file", "nr", "seconds", "event_type", "user", "terminal", "hostname", "pid"]


class LoginRecords(_Files):
    """Records of login files (wtmp, btmp, utmp, utmpdb, lastlog, *.wtmp, *.btmp), each range of whole records a task of its own.

    Records of other kinds than boots, logins and logouts, those without a user, and the rest of a cut file are left out; the
    user of a last login is its number.
    """

    @classmethod
    def name(cls) -> str:
        return "login_records"

    def schema(self) -> str:
        return "file string, nr long, seconds long, event_type string, user string, terminal string, hostname string, pid string"

    def reader(self, schema) -> DataSourceReader:
        return _Logins(self.files())


def register(spark: SparkSession) -> None:
    for source in (FileDigests, FileHeads, LoginRecords):
        spark.dataSource.register(source)
