"""What the operators of this subpackage share: staging tables, batches and held-out rows."""

from __future__ import annotations

import functools
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch at most: whole texts travel in them, so the session's default of 10,000 is too many.
BATCH_ROWS = 1000
#: Bytes of a table that is broadcast, at most, and what a row of a few ids and digests takes of them.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset on one machine (tests) a
    temporary folder takes its place; on a cluster nobody else could read it, so there it is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        if option.isDefined():
            return option.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="moraine-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage (a lost executor re-reads files, it re-runs nothing) and, unlike
    ``checkpoint()``, computes df once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/moraine/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstaged(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read any more. What was made from them must be staged itself."""
    for df in tables:
        jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
        at = jvm.org.apache.hadoop.fs.Path(df._staged_at)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows for an Arrow batch to BATCH_ROWS, so that a batch of long texts fits in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches of a bounded size."""
    small_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """True where models may learn from the row: the id is known and not held out."""
    return doc_id.isNotNull() & ~held_out(doc_id)


def id_type(df: DataFrame, column: str = "doc_id") -> str:
    return df.schema[column].dataType.simpleString()


def parts_for(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))


def beside(small: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The narrow (and staged) side of a join: sent whole to the other side up to `limit` bytes, at ROW_BYTES a row; a larger one is joined by a shuffle."""
    return F.broadcast(small) if small.count() * ROW_BYTES <= limit else small.hint("merge")


def kept_rows(docs: DataFrame, verdicts: DataFrame, identity: dict[str, Column]) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    verdicts (staged): one row for each identity, with kept and copies (rows of that identity); of a kept one with
    several copies one stays. identity: columns of docs under the names that they have in verdicts. What goes is told by a
    narrow table, so texts move only where that is too large to be sent to where they are.
    """

    def same(some: DataFrame) -> tuple[DataFrame, Column]:
        named = beside(some.select(*[F.col(c).alias(f"_{c}_") for c in identity]))
        return named, functools.reduce(Column.__and__, [c.eqNullSafe(named[f"_{n}_"]) for n, c in identity.items()])

    out = docs.join(*same(verdicts.where("not kept")), "left_anti")
    repeated = verdicts.where("kept and copies > 1")
    if repeated.isEmpty():
        return out
    again = out.join(*same(repeated), "left_semi").select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.struct(*[c.alias(n) for n, c in identity.items()]).alias("same"))
    return out.join(*same(repeated), "left_anti").unionByName(again.dropDuplicates(["same"]).select("row.*"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
