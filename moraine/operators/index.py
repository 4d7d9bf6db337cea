"""Keyed tables with last-write-wins updates, published atomically.

A store holds versions v-N of the tables inodes, deps, blocks and meta; the greatest is the published one.
A backup writes v-pending and marks it as complete; commit renames it, which is its only step, and abort
removes it. A reader sees the old version or the new one, whenever it or the commit is interrupted. (On a store
whose renames are copies, commit from one place at a time.)
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A file that ends a version: all its tables are written.
COMPLETE = "_COMPLETE"
SCHEMAS = {
    "inodes": "dev_label string, ino decimal(20,0), blob_id binary",
    "deps": "dev_label string, ino decimal(20,0), block bigint, clear_hash binary",
    "blocks": "clear_hash binary, blob_id binary",
    "meta": "sec bigint, nsec int",
}


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`, over both tables: a map-side maximum rather than a window, so a busy key does not gather."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return upserted(rows, rows.limit(0), keys, order)


def lookup(table: DataFrame, keys: Column) -> DataFrame:
    return table.where(keys)


class IndexTables:
    """Versions of the four tables below a folder that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._paths = jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._paths(self._at(name)))

    def current(self) -> str | None:
        """The published version, the greatest there is."""
        if not self._fs.exists(self._paths(self.path)):
            return None
        names = [str(s.getPath().getName()) for s in self._fs.listStatus(self._paths(self.path))]
        found = [int(n[2:]) for n in names if re.fullmatch(r"v-[0-9]+", n)]
        return f"v-{max(found)}" if found else None

    def read(self, table: str) -> DataFrame:
        """A table of the published version; an empty one before the first commit."""
        version = self.current()
        if version is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(self._at(f"{version}/{table}"))

    def stage(self, tables: dict[str, DataFrame]) -> None:
        """Write the pending version. Refuses if one is there: commit or abort it first."""
        if self.exists("v-pending"):
            raise FileExistsError("a pending index exists; commit or abort it first")
        for name, df in tables.items():
            df.select([F.col(f.split()[0]).cast(f.split(" ", 1)[1]).alias(f.split()[0]) for f in SCHEMAS[name].split(", ")]).write.parquet(self._at(f"v-pending/{name}"))
        self._fs.create(self._paths(self._at(f"v-pending/{COMPLETE}")), True).close()

    def commit(self) -> bool:
        """Publish the pending version; without one nothing happens. One that was not written to its end is refused."""
        if not self.exists("v-pending"):
            return False
        if not self.exists(f"v-pending/{COMPLETE}"):
            raise RuntimeError("the pending index is not complete; abort it")
        version = f"v-{int((self.current() or 'v-0')[2:]) + 1}"
        if not self._fs.rename(self._paths(self._at("v-pending")), self._paths(self._at(version))):
            raise OSError(f"the pending index could not be renamed to {version}")
        return True

    def abort(self) -> bool:
        return self.exists("v-pending") and self._fs.delete(self._paths(self._at("v-pending")), True)
