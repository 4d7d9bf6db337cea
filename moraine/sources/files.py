"""Directory trees and archives as Spark data sources.

    spark.dataSource.register(InodeSource)
    spark.read.format("inodes").load("/home")                      # metadata of every entry
    spark.dataSource.register(ArchiveSink)
    df.write.format("objects_tar").mode("append").save("/backup")  # one archive for each task

Contents come from Spark's own binaryFile source; what it lacks are device, inode, mode, owner and links.
"""

from __future__ import annotations

import os
import stat
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from moraine.sources.formats import tar_record

INODES = (
    "path string, name string, kind string, dev bigint, ino decimal(20,0), mode int, uid bigint, gid bigint, nlink bigint, size bigint, "
    "mtim struct<sec:bigint,nsec:int>, ctim struct<sec:bigint,nsec:int>, target string, error string"
)


def entry(root: str, path: str) -> tuple:
    """One row; a file that cannot be read is a row with an error, never an omission."""
    from decimal import Decimal

    shown = "/" + os.path.relpath(path, root) if path != root else "/"
    try:
        s = os.lstat(path)
    except OSError as e:
        return (shown, os.path.basename(shown), None, None, None, None, None, None, None, None, None, None, None, str(e))
    kind = next((n for n, f in (("dir", stat.S_ISDIR), ("reg", stat.S_ISREG), ("lnk", stat.S_ISLNK), ("fifo", stat.S_ISFIFO)) if f(s.st_mode)), None)
    time = lambda ns: (ns // 10**9, ns % 10**9)
    shown += "/" * (kind == "dir" and shown != "/")
    return (shown, os.path.basename(path), kind, s.st_dev, Decimal(s.st_ino), s.st_mode, s.st_uid, s.st_gid, s.st_nlink, s.st_size, time(s.st_mtime_ns), time(s.st_ctime_ns), os.readlink(path) if kind == "lnk" else None, None)


#: Entries other than directories that one task looks at, at most.
TASK_ENTRIES = 1000


@dataclass
class Subtree(InputPartition):
    paths: tuple[str, ...]
    deep: bool


class InodeReader(DataSourceReader):
    """Splits the tree at its second level: each directory there is a task, other entries are dealt out by the thousand. Sockets and other kinds have a null kind."""

    def __init__(self, root: str):
        self.root = os.path.abspath(root)

    def partitions(self) -> list[InputPartition]:
        parts, flat = [], [self.root]
        for top in sorted(os.scandir(self.root), key=lambda e: e.name):
            try:
                inside = sorted(os.scandir(top.path), key=lambda e: e.name) if top.is_dir(follow_symlinks=False) else []
            except OSError:  # the task that walks it yields the error
                parts.append(Subtree((top.path,), True))
                continue
            flat.append(top.path)
            for e in inside:
                if e.is_dir(follow_symlinks=False):
                    parts.append(Subtree((e.path,), True))
                else:
                    flat.append(e.path)
        return [Subtree(tuple(flat[k : k + TASK_ENTRIES]), False) for k in range(0, len(flat), TASK_ENTRIES)] + parts

    def read(self, part: Subtree) -> Iterator[tuple]:
        waiting = list(part.paths)[::-1]
        while waiting:
            path = waiting.pop()
            row = entry(self.root, path)
            if part.deep and row[2] == "dir":
                try:
                    waiting += sorted((e.path for e in os.scandir(path)), reverse=True)
                except OSError as e:
                    row = (*row[:13], str(e))
            yield row


class InodeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "inodes"

    def schema(self) -> str:
        return INODES

    def reader(self, schema) -> InodeReader:
        return InodeReader(self.options["path"])


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class ArchiveWriter(DataSourceWriter):
    """Each task writes an archive of (name, content) rows under a temporary name; the commit renames them all.

    Attempt numbers begin anew in every application, so names hold a number of the write as well.
    """

    def __init__(self, folder: str):
        self.folder, self.run = folder, uuid.uuid4().hex[:12]

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        os.makedirs(self.folder, exist_ok=True)
        task = TaskContext.get()
        handle, temporary = tempfile.mkstemp(prefix=".pending-", dir=self.folder)
        with os.fdopen(handle, "wb") as f:
            for row in rows:
                f.write(tar_record(row["name"], bytes(row["content"])))
        return Written(temporary, f"{self.folder}/part-{self.run}-{task.taskAttemptId():05d}.tar")

    def commit(self, messages: list) -> None:
        for m in messages:
            if m:
                os.rename(m.temporary, m.final)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m:
                os.unlink(m.temporary)


class ArchiveSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "objects_tar"

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def devices(spark: SparkSession, folder: str) -> DataFrame:
    """(dev, label) from a folder of links to places on devices: the link's name, 16 bytes at most, labels the device. Links that lead nowhere are passed over; no folder gives no rows."""
    rows = []
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else ():
        if len(name.encode()) > 16:
            raise ValueError(f"the device name is too long: {name}")
        if os.path.exists(f"{folder}/{name}"):
            rows.append((os.stat(f"{folder}/{name}").st_dev, name))
    return spark.createDataFrame(rows, "dev bigint, label string")


def contents(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root, with a leading slash) and content of every regular file, by Spark's own source."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = os.path.abspath(root)
    return found.select(F.regexp_replace(F.expr("url_decode(regexp_replace(path, '\\\\+', '%2B'))"), "^file:/*" + base, "").alias("path"), "content")


def listing(spark: SparkSession, store: str) -> DataFrame:
    """(id, path, length) of the objects in a store, without reading them; other names are passed over."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{store}/objects").drop("content")
    name = F.element_at(F.split("path", "/"), -1)
    return found.where(name.rlike("^[0-9a-fA-F]{56}")).select(F.lower(name).alias("id"), "path", "length")
