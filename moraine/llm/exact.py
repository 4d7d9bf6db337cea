"""Exact de-duplication over an extendible-hash index, in DataFrame operations only.

Texts are equal when they are identical after ASCII white space is deleted.

1. Entries (row number, id, 64-bit key, sizes) of all rows are staged; texts are left behind. Rows of one
   key are counted with map-side partial sums, so a group that holds a third of all rows reaches the
   index as one entry.
2. The directory starts as one cell that points to one bucket. While a bucket holds more than
   BUCKET_KEYS keys it is split by its next bit; where its depth is the directory's, the directory
   doubles first. The splits run over a histogram of the keys, not over the keys.
3. Keys of several rows are compared by their bytes: their texts are read again and grouped by key
   and text. Different texts of one key form a chain.
4. Owner tasks each take a range of the directory (a range partitioning on cell and key) and write the
   index files, in the order of key and place in the chain.
5. Each row looks its cell up in the directory and its key up in the bucket to which the cell points; where
   a chain is longer than one, its bytes tell the entries apart. No result rests on a hash alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.llm.common import BROADCAST_BYTES, beside, kept_rows, staged

#: From a normalised text to its 64-bit key.
Hash = Callable[[Column], Column]

#: What is deleted before texts are compared: the characters of [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
#: Index entries of a bucket at most (colliding keys apart).
BUCKET_KEYS = 50_000
#: Bits by which the histogram of the keys is finer than a directory of even buckets.
FINER_BITS = 3


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), WHITE, "")


def digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _size(text: Column) -> Column:
    return F.char_length(F.coalesce(text.cast("string"), F.lit(""))).cast("bigint")


def entries(docs: DataFrame, hashed: Hash = F.xxhash64) -> DataFrame:
    """One row for each document without its text: rid (row number in the scan), doc_id, key, sha, n (code points of the original)."""
    norm = normalised(F.col("text"))
    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", hashed(norm).alias("key"), digest(norm).alias("sha"), _size(F.col("text")).alias("n"))


def cell(bits: int) -> Column:
    """The leading bits of the key, as an unsigned number."""
    return F.shiftrightunsigned("key", 64 - bits).cast("bigint") if bits else F.lit(0).cast("bigint")


def directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, int]:
    """(cell, depth, bucket) for each cell of the directory, and the directory's bits.

    bucket is the leading `depth` bits of all its keys; the cells that share them point to it. A bucket of one
    cell of 60 bits is not split any further.
    """
    total = keys.count()
    fine = min(60, max(0, total // bucket_keys).bit_length() + FINER_BITS)
    histogram = staged(keys.groupBy(cell(fine).alias("fine")).agg(F.count("*").alias("held")), "histogram")
    spark, bits = keys.sparkSession, 0
    cells = spark.range(1).select(F.lit(0).cast("bigint").alias("cell"), F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("bucket"))
    if total <= bucket_keys:
        return cells, bits
    while True:
        of = F.expr(f"shiftright(fine, {fine - bits})")
        held = histogram.groupBy(of.alias("cell")).agg(F.sum("held").alias("held")).join(cells, "cell").groupBy("depth", "bucket").agg(F.sum("held").alias("held"))
        over = staged(held.where((F.col("held") > bucket_keys) & (F.col("depth") < 60)).select("depth", "bucket"), "over")
        deepest = over.agg(F.max("depth")).first()[0]
        if deepest is None:
            return cells, bits
        if deepest == bits:
            # The directory doubles: both halves of a cell point to its bucket.
            bits += 1
            cells = cells.select(F.explode(F.array(F.col("cell") * 2, F.col("cell") * 2 + 1)).alias("cell"), "depth", "bucket")
            if bits > fine:
                fine = min(60, bits + FINER_BITS)
                histogram = staged(keys.groupBy(cell(fine).alias("fine")).agg(F.count("*").alias("held")), "histogram")
        # An overfull bucket is split: its cells point to one of two buckets by their next bit.
        marked = cells.join(over.withColumn("split", F.lit(1)), ["depth", "bucket"], "left")
        depth = (F.col("depth") + F.coalesce("split", F.lit(0))).alias("depth")
        half = F.when(F.col("split").isNull(), F.col("bucket")).otherwise(F.expr(f"shiftright(cell, CAST({bits} - depth - 1 AS INT))"))
        cells = staged(marked.select("cell", depth, half.alias("bucket")), "directory")


def _best() -> Column:
    """The row that stays: the longest, then the smallest id, nulls last, then the first row."""
    return F.min(F.struct((-F.col("n")).alias("longest"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid")).alias("best")


def grouped(found: DataFrame) -> DataFrame:
    """One entry for each key: rows, best, sha."""
    return found.groupBy("key").agg(F.count("*").alias("rows"), _best(), F.min("sha").alias("sha"))


def compared(docs: DataFrame, index: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, hashed: Hash = F.xxhash64) -> DataFrame:
    """(key, texts) of the keys with several rows: how many different byte strings they stand for."""
    return _keyed(docs, index.where("rows > 1").select("key"), broadcast_bytes, hashed).groupBy("key", "norm").count().groupBy("key").agg(F.count("*").alias("texts"))


def _keyed(docs: DataFrame, keys: DataFrame, broadcast_bytes: int, hashed: Hash) -> DataFrame:
    """doc_id, n, norm and key of the documents with one of the (distinct) keys."""
    norm = normalised(F.col("text"))
    return docs.select("doc_id", _size(F.col("text")).alias("n"), norm.alias("norm"), hashed(norm).alias("key")).join(beside(keys, broadcast_bytes), "key", "left_semi")


def owned(chained: DataFrame, cells: DataFrame, bits: int) -> DataFrame:
    """The index files: depth, bucket, key, chain, bytes, sha, rows, best; each owner task writes a range of the directory."""
    placed = chained.withColumn("cell", cell(bits)).join(cells, "cell")
    return staged(placed.repartitionByRange("cell", "key").sortWithinPartitions("cell", "key", "chain").drop("cell"), "index")


def build_index(found: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The index files over entries whose keys all stand for one text."""
    keys = staged(grouped(found), "keys")
    return owned(_alone(keys), *directory(keys, bucket_keys))


def _alone(keys: DataFrame) -> DataFrame:
    """Chains of one entry."""
    return keys.select("key", F.lit(0).alias("chain"), F.lit(None).cast("string").alias("bytes"), "sha", "rows", "best")


def resolved(docs: DataFrame, bucket_keys: int = BUCKET_KEYS, broadcast_bytes: int = BROADCAST_BYTES, hashed: Hash = F.xxhash64) -> DataFrame:
    """The entries, each with what the index holds of its text: rows, sha, the row that stays (keep_id, keep_n) and whether this is it (kept)."""
    found = staged(entries(docs, hashed), "entries")
    keys = staged(grouped(found), "keys")
    cells, bits = directory(keys, bucket_keys)
    chained = _alone(keys)
    collide = staged(compared(docs, keys, broadcast_bytes, hashed).where("texts > 1").select("key"), "collide")
    colliding = not collide.isEmpty()
    if colliding:
        # Keys that stand for several texts: their rows are staged with their bytes and numbered anew.
        texts = staged(_keyed(docs, collide, broadcast_bytes, hashed).withColumns({"rid": F.monotonically_increasing_id(), "sha": digest(F.col("norm"))}), "texts")
        each = texts.groupBy("key", "norm").agg(F.count("*").alias("rows"), _best(), F.min("sha").alias("sha"))
        chain = F.row_number().over(Window.partitionBy("key").orderBy("best")) - 1
        several = each.select("key", chain.alias("chain"), F.col("norm").alias("bytes"), "sha", "rows", "best")
        chained = chained.join(collide, "key", "left_anti").unionByName(several)
        found = found.join(collide, "key", "left_anti").withColumn("norm", F.lit(None).cast("string")).unionByName(texts.select("rid", "doc_id", "key", "sha", "n", "norm"))
    index = owned(chained, cells, bits)
    # The lookup: cell to bucket in the directory, key in the bucket, bytes along the chain.
    asked = found.withColumn("cell", cell(bits)).join(beside(cells, broadcast_bytes), "cell").drop("cell", "sha")
    kept = index.select("depth", "bucket", "key", "bytes", "sha", "rows", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"), (-F.col("best.longest")).alias("keep_n"))
    same = [asked[c] == kept[c] for c in ("depth", "bucket", "key")] + ([asked["norm"].eqNullSafe(kept["bytes"])] if colliding else [])
    return asked.join(kept, same).select("rid", "doc_id", asked["key"], "n", "sha", "rows", "keep_id", "keep_n", (F.col("keep_rid") == F.col("rid")).alias("kept"))


def exact_duplicates(docs: DataFrame, bucket_keys: int = BUCKET_KEYS, broadcast_bytes: int = BROADCAST_BYTES, hashed: Hash = F.xxhash64) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text stays, then the smallest
    doc_id (null ids last), then the first of rows that are repeated whole, so exactly one row of a
    group is kept. A null text counts as empty, texts of any length are compared whole. Other columns
    are ignored; an empty table gives an empty table. hashed: the 64-bit key of a text; what it is changes
    the buckets and chains, not the result.
    """
    return resolved(docs, bucket_keys, broadcast_bytes, hashed).select("doc_id", "keep_id", F.col("rows").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group, with all their columns.

    Documents are told by doc_id (null or not), digest and length; of rows that agree in all three the first that
    is met stays. A null text counts as empty; texts of any length are read whole; an empty table gives an empty one.
    """
    rows = staged(resolved(docs).groupBy("doc_id", "sha", "n").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("copies")), "resolved")
    return kept_rows(docs, rows, {"doc_id": docs["doc_id"], "sha": digest(normalised(docs["text"])), "n": _size(docs["text"])})
