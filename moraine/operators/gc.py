"""Garbage collection: which stored objects no snapshot needs.

The exact form is an anti join on ids. The compatible form asks Bloom filters, which are tables of 64-bit
words here: building is a shuffle with map-side bit_or, probing a join on the word, at any filter size.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.functions.keccak import keccak, keccak_many

#: Hash functions of a snapshot's filter, and of the small filter over the filters themselves.
K, K_FILTERS = 3, 8


def garbage(listed: DataFrame, live: list[DataFrame], key: str = "id") -> DataFrame:
    """Listed objects that none of the live tables names."""
    union = live[0].select(key)
    for more in live[1:]:
        union = union.unionByName(more.select(key))
    return listed.join(union, key, "left_anti")


def filter_bytes(objects: int) -> int:
    """Bytes of a snapshot's filter: about four bits for each object."""
    return objects // 2 + 1


def header(k: int = K) -> bytes:
    """31 random bytes and k."""
    return os.urandom(31) + bytes([k])


def positions(item: bytes, head: bytes, n_bytes: int) -> list[int]:
    """The bits of an item: 64-bit little-endian words of a Keccak output, modulo the filter's bits."""
    k = head[31]
    words = keccak(head + item, 8 * k, 200 - 16 * k)
    return [int.from_bytes(words[8 * i : 8 * i + 8], "little") % (8 * n_bytes) for i in range(k)]


def bits(item: Column, head: bytes, n_bytes: int) -> Column:
    """The bits of each item, a batch at a time."""
    k = head[31]

    @F.pandas_udf("array<bigint>")
    def of(items: pd.Series) -> pd.Series:
        words = keccak_many([head + x for x in items], 8 * k, 200 - 16 * k).view("<u8")
        return pd.Series(list((words % np.uint64(8 * n_bytes)).astype(np.int64)), index=items.index)

    return of(item)


def sha_bits(item: Column, k: int, n_bytes: int) -> Column:
    """Bits from the SHA-256 of a text, in steps of 15 hexadecimal digits, inside the JVM; k is 4 at most. Any engine with SHA-256 can ask the filter."""
    sha = F.sha2(item, 256)
    return F.array(*[F.pmod(F.conv(F.substring(sha, 1 + 15 * i, 15), 16, 10).cast("bigint"), F.lit(8 * n_bytes)) for i in range(k)])


def fast_bits(item: Column, k: int, n_bytes: int, seed: int = 0) -> Column:
    """Bits by xxHash, inside the JVM, for filters that need not be read elsewhere."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(seed * 64 + i), item), F.lit(8 * n_bytes)) for i in range(k)])


def build(ids: DataFrame, found: Column) -> DataFrame:
    """(word, bits) from the positions of each id."""
    each = ids.select(F.explode(found).alias("p"))
    return each.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits"))


def matching(ids: DataFrame, found: Column, bloom: DataFrame, key: str = "id") -> DataFrame:
    """The ids that the filter may hold; none that it does hold is missing."""
    each = ids.select(key, F.size(found).alias("k"), F.explode(F.array_distinct(found)).alias("p"))
    asked = each.select(key, "p", F.shiftright("p", 6).alias("word"))
    hit = asked.join(bloom, "word", "left").withColumn("on", F.coalesce(F.expr("(shiftright(bits, CAST(p & 63 AS INT)) & 1) = 1"), F.lit(False)))
    return hit.groupBy(key).agg(F.bool_and("on").alias("on")).where("on").select(key)


def filter_of_filters(digests: list[bytes]) -> Callable[[bytes], bool]:
    """A small filter over the digests of filters, 16 bytes for each, which tells whether a filter is one of them. It is as long as the list of snapshots."""
    head, n_bytes = header(K_FILTERS), max(1, 16 * len(digests))
    held = {p for d in digests for p in positions(d, head, n_bytes)}
    return lambda d: held.issuperset(positions(d, head, n_bytes))


def packed(bloom: DataFrame, head: bytes, n_bytes: int) -> bytes:
    """The filter's file, to be read elsewhere: the header, then bit p in bit p mod 8 of byte p div 8. It is made whole on the driver; snapshots keep their words as a table."""
    out = bytearray(n_bytes + 8)
    for r in bloom.toLocalIterator():
        out[8 * r["word"] : 8 * r["word"] + 8] = (r["bits"] & (1 << 64) - 1).to_bytes(8, "little")
    return head + bytes(out[:n_bytes])
