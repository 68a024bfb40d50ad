"""A directory tree as a table: a Python data source that lists, prunes and hashes in the readers.

`spark.dataSource.register(FileTree)`, then `spark.read.format("file_tree").option("path", root).load()`
gives path, is_dir, size, mtime, hash, metadata_only, error. The driver lists folders level by level until
there are `partitions` of them to give to tasks; a folder of many files is given to several, each taking
the names that fall to it.

Options: path, filter (names of folders below path, comma-separated), ignore (patterns, one a line),
hash (true), metadata_only_size (bytes; larger entries get no content hash), follow_symlinks (true),
rules (true; without them every regular file comes, hidden or in a package), partitions (64).
Hidden entries are left out; packages are one entry each, and their content is not listed unless the
package is ignored, when its files come one by one.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections import deque
from collections.abc import Iterator
from datetime import datetime, timezone
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from cairn.functions.paths import PACKAGE_EXTENSIONS
from cairn.schemas import METADATA_ONLY, SCAN

CHUNK = 1 << 16
FILES_A_TASK = 2_000  #: of one folder


def read_patterns(text: str) -> list[str]:
    """The patterns of an ignore file: lines without blank ones and comments."""
    return [x for line in text.splitlines() if (x := line.strip()) and not x.startswith("#")]


def load_patterns(path: str) -> list[str]:
    """Patterns of a file; none if it can't be read."""
    try:
        with open(path, encoding="utf-8") as f:
            return read_patterns(f.read())
    except (OSError, UnicodeDecodeError):
        return []


def ignored(path: str, patterns: list[str]) -> bool:
    name = os.path.basename(path)
    for p in patterns:
        if p.startswith("/"):
            if path.startswith(p[:-1]) if p.endswith("*") else path == p:
                return True
        elif fnmatchcase(name, p):
            return True
    return False


def is_package(path: str) -> bool:
    name = os.path.basename(path)
    return os.path.splitext(name.lower())[1] in PACKAGE_EXTENSIONS


def hash_file(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(CHUNK):
            h.update(chunk)
    return h.hexdigest()


def _files_below(top: str) -> list[str]:
    """Regular files below a folder, relative, in the order of their path parts."""
    found = []
    for folder, _, names in os.walk(top):
        for n in names:
            full = os.path.join(folder, n)
            if os.path.isfile(full):
                found.append(os.path.relpath(full, top))
    return sorted(found, key=lambda r: r.split(os.sep))


def hash_package(top: str) -> str:
    """One hash of a folder: relative names and contents of its files in order, errors by their path."""
    h = hashlib.sha256()
    for rel in _files_below(top):
        full = os.path.join(top, rel)
        h.update(rel.encode("utf-8", "surrogateescape"))
        try:
            with open(full, "rb") as f:
                while chunk := f.read(CHUNK):
                    h.update(chunk)
        except OSError:
            h.update(f"ERROR:{full}".encode())
    return h.hexdigest()


def package_size(top: str) -> int:
    return sum(os.path.getsize(os.path.join(top, r)) for r in _files_below(top))


class Folder(InputPartition):
    """A folder with all below it, or only the entries of one part of it."""

    def __init__(self, path: str, deep: bool, part: int = 0, parts: int = 1):
        self.path, self.deep, self.part, self.parts = path, deep, part, parts


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.realpath(options["path"])
        self.names = [x for x in (options.get("filter") or "").split(",") if x]
        self.patterns = read_patterns(options.get("ignore") or "")
        self.hash = (options.get("hash") or "true").lower() == "true"
        limit = options.get("metadata_only_size")
        self.limit = None if limit in (None, "") else int(limit)
        self.links = (options.get("follow_symlinks") or "true").lower() == "true"
        self.rules = (options.get("rules") or "true").lower() == "true"
        self.many = int(options.get("partitions") or 64)

    def partitions(self) -> list[Folder]:
        tops = list(dict.fromkeys(os.path.join(self.root, n) for n in self.names)) if self.names else [self.root]
        tops = [t for t in tops if os.path.isdir(t)]
        tops = [t for t in tops if not any(t != u and t.startswith(u + os.sep) for u in tops)]
        wait = deque(t for t in tops if not (self.rules and any(part.startswith(".") for part in t.split(os.sep) if part)))
        out: list[Folder] = []
        while wait and len(out) + len(wait) < self.many:
            t = wait.popleft()
            folders, files = [], 0
            try:
                with os.scandir(t) as entries:
                    for e in entries:
                        if e.is_dir() and self._descend(e.path):
                            folders.append(e.path)
                        else:
                            files += 1
            except OSError:
                continue
            parts = max(1, -(-files // FILES_A_TASK))
            out += [Folder(t, False, k, parts) for k in range(parts)]
            wait.extend(sorted(folders))
        return out + [Folder(t, True) for t in wait]

    def _descend(self, path: str) -> bool:
        name = os.path.basename(path)
        if os.path.islink(path):
            return False
        return not self.rules or not name.startswith(".") and (not is_package(path) or ignored(path, self.patterns))

    def _entry(self, path: str, package: bool) -> tuple:
        is_dir = size = mtime = digest = error = None
        only = False
        try:
            is_dir = os.path.isdir(path)
            size = package_size(path) if is_dir else os.path.getsize(path)
            mtime = datetime.fromtimestamp(os.path.getmtime(path), timezone.utc)
            only = self.limit is not None and size > self.limit
            if only:
                digest = METADATA_ONLY
            elif self.hash:
                digest = hash_package(path) if is_dir else hash_file(path)
        except OSError as e:
            error = str(e)
        return path, bool(is_dir), size, mtime, digest, only, error

    def _walk(self, top: str, deep: bool, part: int = 0, parts: int = 1) -> Iterator[tuple]:
        try:
            with os.scandir(top) as it:
                entries = sorted(it, key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            if parts > 1 and zlib.crc32(os.fsencode(e.name)) % parts != part:
                continue
            if self.rules and e.name.startswith(".") or (e.is_symlink() and not self.links):
                continue
            package = self.rules and is_package(e.path)
            if package and not ignored(e.path, self.patterns):
                yield self._entry(e.path, True)
            elif e.is_dir():
                if deep and self._descend(e.path):
                    yield from self._walk(e.path, True)
            elif not package and e.is_file() and not (self.rules and ignored(e.path, self.patterns)):
                yield self._entry(e.path, False)

    def read(self, partition: Folder) -> Iterator[tuple]:
        return self._walk(partition.path, partition.deep, partition.part, partition.parts)


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> StructType:
        return SCAN

    def reader(self, schema: StructType) -> DataSourceReader:
        return TreeReader(dict(self.options))


def scan(spark: SparkSession, root: str, names: list[str] | None = None, max_files: int | None = None, patterns: list[str] | None = None, metadata_only_size: int | None = None, hashes: bool = True) -> DataFrame:
    """The tree below root; with max_files the first so many entries in the order of their path parts, hashed once they are known."""
    from pyspark.sql import functions as F

    spark.dataSource.register(FileTree)
    read = spark.read.format("file_tree").option("path", root).option("hash", str(hashes and not max_files).lower())
    read = read.option("filter", ",".join(names or [])).option("ignore", "\n".join(patterns or []))
    if metadata_only_size is not None:
        read = read.option("metadata_only_size", str(metadata_only_size))
    df = read.load()
    if not max_files:
        return df
    first = df.orderBy(F.split("path", "/")).limit(max_files)
    return hash_column(first) if hashes else first


def walk(spark: SparkSession, root: str) -> DataFrame:
    """path and size of every regular file below root, without any rule; what cannot be read is left out."""
    spark.dataSource.register(FileTree)
    df = spark.read.format("file_tree").option("path", root).option("hash", "false").option("rules", "false").load()
    return df.where("error is null").select("path", "size")


def hash_column(df: DataFrame) -> DataFrame:
    """df (path, is_dir, metadata_only) with content hashes where there are none yet, in Arrow batches."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def digest(path, is_dir):
        def one(p, d):
            try:
                return hash_package(p) if d else hash_file(p)
            except OSError:
                return None

        return path.combine(is_dir, one)

    todo = F.col("hash").isNull() & ~F.coalesce("metadata_only", F.lit(False)) & F.col("error").isNull()
    return df.where(~todo).unionByName(df.where(todo).withColumn("hash", digest("path", "is_dir")))
