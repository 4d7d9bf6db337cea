"""Change detection against a previous snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_changed(mtim: Column, ctim: Column, since: Column) -> Column:
    """Strictly later than the time before the previous walk began. Times are timestamps or (sec, nsec) structs."""
    return (mtim > since) | (ctim > since)


def classified(current: DataFrame, previous: DataFrame, keys: list[str], since: Column, ids: str = "blob_id") -> DataFrame:
    """Current inodes with reuse (found before and not changed since) and the blob id to reuse.

    Only metadata is read and joined; content is for the rows without reuse.
    """
    before = previous.select(*keys, F.col(ids).alias("_id"), F.lit(True).alias("_found"))
    joined = current.join(before, keys, "left")
    reuse = F.coalesce(F.col("_found"), F.lit(False)) & ~is_changed(F.col("mtim"), F.col("ctim"), since)
    return joined.withColumns({"reuse": reuse, ids: F.when(reuse, F.col("_id"))}).drop("_id", "_found")


def carried(unchanged: DataFrame, deps: DataFrame, block_index: DataFrame, keys: list[str], block: str) -> DataFrame:
    """Dependencies of unchanged inodes, with is_missing where the previous index lacks the block; such a row is fatal to a snapshot."""
    mine = deps.join(unchanged.select(*keys), keys, "left_semi")
    known = block_index.select(block).distinct().withColumn("_known", F.lit(True))
    return mine.join(known, block, "left").withColumn("is_missing", F.col("_known").isNull()).drop("_known")


def require_no_missing(deps: DataFrame) -> DataFrame:
    """Fails the job on a missing block."""
    return deps.withColumn("is_missing", F.when(F.col("is_missing"), F.raise_error("a block of an unchanged file is not in the index").cast("boolean")).otherwise(F.lit(False)))


def until_gap(deps: DataFrame, keys: list[str], block: str) -> DataFrame:
    """The dependencies of each inode from block 0 up to the first number that is missing; what comes after a gap is not carried.

    Rows that repeat a block all count as that block. Inodes without a gap, which are nearly all, are told by their
    counts; only the others are put in order.
    """
    sizes = deps.groupBy(*keys).agg((F.max(block) - F.count_distinct(block)).alias("_over"), F.min(block).alias("_least"))
    whole = sizes.where("_over = -1 and _least = 0").select(*keys)
    order = F.dense_rank().over(Window.partitionBy(*keys).orderBy(block)) - 1
    rest = deps.join(whole, keys, "left_anti").withColumn("_at", order).where(F.col("_at") == F.col(block)).drop("_at")
    return deps.join(whole, keys, "left_semi").unionByName(rest)


def reused(current: DataFrame, previous: DataFrame, since: Column, content: list[str]) -> DataFrame:
    """Adds reuse and the content of files (dev, ino) that the previous snapshot holds under any path and that did not change since: a renamed file is not read again."""
    held = previous.groupBy("dev", "ino").agg(F.min(F.struct(*content)).alias("_was"), F.lit(True).alias("_found"))
    joined = current.join(held, ["dev", "ino"], "left")
    joined = joined.withColumn("reuse", F.coalesce("_found", F.lit(False)) & ~is_changed(F.col("mtim"), F.col("ctim"), since))
    return joined.withColumns({c: F.when(F.col("reuse"), F.col(f"_was.{c}")) for c in content}).drop("_was", "_found")


def on_devices(files: DataFrame, devices: DataFrame, dev: str, root_dev: object, cross: bool = False) -> DataFrame:
    """Files on the root's device or a listed one; all of them with cross."""
    if cross:
        return files
    known = devices.select(F.col(dev)).distinct().withColumn("_listed", F.lit(True))
    return files.join(known, dev, "left").where(F.col("_listed") | (F.col(dev) == F.lit(root_dev))).drop("_listed")


def inode_label(files: DataFrame, devices: DataFrame, dev: str, ino: str) -> DataFrame:
    """Adds key: label/inode on a device with a label, else hexadecimal device:inode."""
    named = devices.select(dev, F.col("label").alias("_label"))
    key = F.when(F.col("_label").isNotNull(), F.concat("_label", F.lit("/"), F.col(ino).cast("string"))).otherwise(F.concat(F.lower(F.hex(F.col(dev).cast("bigint"))), F.lit(":"), F.col(ino).cast("string")))
    return files.join(named, dev, "left").withColumn("key", key).drop("_label")
