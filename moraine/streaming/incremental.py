"""An extension of ours: snapshots taken as files arrive on a stream.

Each micro-batch of (path, content) is chunked and hashed; blocks that the block table lacks are
appended to it. A batch that is replayed after a failure finds its own blocks already there, so the
table holds every block once. The table is partitioned by the first digits of the hash: a batch reads only the
partitions of its own blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from moraine.functions.hashing import hexed
from moraine.operators import chunk

#: Digits of a hash by which the block table is partitioned.
PREFIX = 2


def dedup_sink(files: DataFrame, table: str, checkpoint: str, block_size: int = chunk.DEFAULT_BLOCK, trigger: dict | None = None) -> StreamingQuery:
    """files: a streaming (path, content). table: a Parquet folder of (hash, n_bytes, path, block) by prefix (PREFIX digits of hash)."""

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = chunk.hashed(chunk.blocks(batch, "path", "content", block_size)).withColumn("hash", hexed(F.col("hash")))
        first = chunk.distinct_blocks(found, ["path", "block"]).select("hash", "n_bytes", F.col("first_path").alias("path"), F.col("first_block").alias("block"), F.substring("hash", 1, PREFIX).alias("prefix"))
        first = first.persist()  # asked twice below; a lost executor computes its part again from the batch
        try:
            prefixes = [r["prefix"] for r in first.select("prefix").distinct().collect()]  # 16 ** PREFIX at most
            try:
                old = spark.read.schema(first.schema).parquet(table).where(F.col("prefix").isin(prefixes))
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                old = spark.createDataFrame([], first.schema)
            chunk.emitted(first, old).repartition("prefix").write.partitionBy("prefix").mode("append").parquet(table)
        finally:
            first.unpersist()

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
