"""Fixed-size chunking, block de-duplication and reassembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.functions.hashing import block_digest

#: Bytes of a stored block that are not content, the default block size, and its allowed range.
RESERVED, DEFAULT_BLOCK, LEAST_BLOCK, MOST_BLOCK = 48, 262_144, 4000, 64 << 20
#: Files below this many bytes are kept inside their inode record.
INLINE_BYTES = 4000


def content_size(block_size: int = DEFAULT_BLOCK) -> int:
    if not LEAST_BLOCK <= block_size <= MOST_BLOCK:
        raise ValueError(f"a block has {LEAST_BLOCK} to {MOST_BLOCK} bytes, not {block_size}")
    return block_size - RESERVED


def is_inline(size: Column) -> Column:
    return size < INLINE_BYTES


def blocks(files: DataFrame, key: str, content: str, block_size: int = DEFAULT_BLOCK, keep: list[str] | None = None) -> DataFrame:
    """(key, block, data) of each file's blocks; the last may be short, an empty or null file has none.

    A generator on the scan: no shuffle, and content leaves the row only as the blocks themselves.
    """
    size = content_size(block_size)
    n = F.octet_length(content)
    numbered = files.where(n > 0).select(key, *(keep or []), F.col(content).alias("_content"), F.explode(F.sequence(F.lit(0), ((n - 1) / size).cast("int"))).alias("block"))
    return numbered.select(key, *(keep or []), F.col("block").cast("bigint").alias("block"), F.substring(F.col("_content"), F.col("block") * size + 1, F.lit(size)).alias("data"))


def hashed(found: DataFrame, kind: str = "sha256") -> DataFrame:
    """Adds hash and n_bytes and drops the data, so that later shuffles carry digests only."""
    return found.withColumns({"hash": block_digest(F.col("data"), kind), "n_bytes": F.octet_length("data").cast("bigint")}).drop("data")


def distinct_blocks(found: DataFrame, order: list[str]) -> DataFrame:
    """hash, n_bytes, copies and the first occurrence by `order`: counted map-side, so frequent blocks do not gather."""
    first = F.min(F.struct(*order)).alias("first")
    return found.groupBy("hash", "n_bytes").agg(F.count("*").alias("copies"), first).select("hash", "n_bytes", "copies", *[F.col(f"first.{c}").alias(f"first_{c}") for c in order])


def two_level(distinct: DataFrame, previous: DataFrame) -> DataFrame:
    """Adds is_new: the block is in no earlier snapshot. previous has the column hash."""
    seen = previous.select("hash").distinct().withColumn("_seen", F.lit(True))
    return distinct.join(seen, "hash", "left").withColumn("is_new", F.col("_seen").isNull()).drop("_seen")


def emitted(distinct: DataFrame, previous: DataFrame) -> DataFrame:
    """The blocks that a snapshot has to write."""
    return distinct.join(previous.select("hash"), "hash", "left_anti")


def reassembled(found: DataFrame, key: str) -> DataFrame:
    """(key, n_blocks, content) from (key, block, data), in block order."""
    return found.groupBy(key).agg(F.count("*").alias("n_blocks"), joined("data", "block").alias("content"))


def joined(data: str, order: str) -> Column:
    """An aggregate that joins byte strings in order and passes over nulls; it copies each byte once."""
    return F.coalesce(F.expr(f"listagg(`{data}`) WITHIN GROUP (ORDER BY `{order}`)"), F.lit(b"").cast("binary"))


def hardlinks(files: DataFrame, identity: list[str], order: str) -> DataFrame:
    """Adds first and is_link: files of one identity after the first by `order` are links to it.

    The first is found with a map-side minimum and joined back, so a file with very many links is never sorted in one task.
    """
    first = files.groupBy(*identity).agg(F.min(order).alias("first"))
    return files.join(first, identity).withColumn("is_link", F.col(order) != F.col("first"))


def ordered_hardlinks(files: DataFrame, identity: list[str], order: str) -> DataFrame:
    """The same with each file's rank among its links, for restoring; costs a sort of every identity."""
    return files.withColumn("rank", F.row_number().over(Window.partitionBy(*identity).orderBy(order)))
