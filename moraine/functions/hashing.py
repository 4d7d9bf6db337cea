"""Digests and the text forms of record fields."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Bytes before a block's data when it is hashed.
BLOCK_MARK = b"blk\0"
#: Octets of an object id in the compatible profile (SHA3-224).
ID_BYTES = 28


@F.pandas_udf(BinaryType())
def _sha3_224(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else hashlib.sha3_224(x).digest())


def digest(data: Column, kind: str = "sha256") -> Column:
    """Binary digest of a binary column: "sha256" inside the JVM, "sha3_224" in Arrow batches (Spark has no SHA-3)."""
    if kind == "sha256":
        return F.unhex(F.sha2(data, 256))
    if kind == "sha3_224":
        return _sha3_224(data)
    raise ValueError(f"no digest {kind!r}")


def block_digest(data: Column, kind: str = "sha256") -> Column:
    return digest(F.concat(F.lit(BLOCK_MARK), data), kind)


def hexed(data: Column) -> Column:
    return F.lower(F.hex(data))


def object_path(name: Column) -> Column:
    """Where an object with this hexadecimal name lies: objects/ and a directory for its first three digits."""
    return F.concat(F.lit("objects/"), F.substring(name, 1, 3), F.lit("/"), name)


def is_object_name(name: Column) -> Column:
    return name.rlike(r"^[0-9a-fA-F]{56}")


def octal(mode: Column) -> Column:
    """A number in C's octal notation: a leading 0, and a lone 0 for zero."""
    return F.when(mode == 0, F.lit("0")).otherwise(F.concat(F.lit("0"), F.conv(mode.cast("string"), 10, 8)))


def from_octal(text: Column) -> Column:
    return F.conv(text, 8, 10).cast("int")


def file_kind(mode: Column) -> Column:
    """dir, reg, lnk or fifo; null for anything else, which is never stored."""
    kinds = {0o040000: "dir", 0o100000: "reg", 0o120000: "lnk", 0o010000: "fifo"}
    bits, out = mode.bitwiseAND(F.lit(0o170000)), F.lit(None).cast("string")
    for value, name in kinds.items():
        out = F.when(bits == value, F.lit(name)).otherwise(out)
    return out


def time_text(sec: Column, nsec: Column) -> Column:
    return F.concat(sec.cast("string"), F.lit("."), F.lpad(nsec.cast("string"), 9, "0"))


def time_struct(text: Column) -> Column:
    """(sec, nsec) from "sec.nnnnnnnnn"; structs compare in order."""
    parts = F.split(text, r"\.")
    return F.struct(F.get(parts, 0).cast("bigint").alias("sec"), F.rpad(F.coalesce(F.get(parts, 1), F.lit("0")), 9, "0").cast("int").alias("nsec"))


def padding(n: Column) -> Column:
    """Bytes that fill n up to a multiple of 512."""
    return F.pmod(-n, F.lit(512).cast("bigint"))


def set_digest(line: Column) -> Column:
    """An aggregate: one digest of a multiset of texts, whatever their order. Their SHA-256 are added up in four parts, so partial sums meet, never lists."""
    sha = F.sha2(line, 256)
    sums = [F.sum(F.conv(F.substring(sha, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(4)]
    return F.sha2(F.concat_ws(" ", F.count(line).cast("string"), *sums), 256)
