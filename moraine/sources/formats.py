"""Record formats as column expressions: snapshot summaries, inode records and archive headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions.hashing import octal, time_struct, time_text

#: Bytes before the data of a stored object, of an archive header, and of its blocks.
OBJECT_HEADER, TAR_HEADER, TAR_BLOCK = 40, 512, 512
SECTIONS = ("dents", "idata", "blocks")


# Summaries: lines "timestamp", "label", "root" and "bloom", in that order


def summary_text(sec: Column, nsec: Column, label: Column, root: Column, bloom: Column | None = None) -> Column:
    lines = [F.concat(F.lit("timestamp "), time_text(sec, nsec)), F.concat(F.lit("label "), label), F.concat(F.lit("root "), root)]
    if bloom is not None:
        lines.append(F.concat(F.lit("bloom "), bloom))  # null without a filter, so concat_ws leaves it out
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def summary_fields(text: Column) -> dict[str, Column]:
    """label, ts (sec, nsec), root and bloom; unknown lines are passed over, missing ones are null, without a timestamp time is zero."""

    def line(name: str) -> Column:
        found = F.regexp_extract(text, rf"(?m)^{name} ([^\n]*)$", 1)
        return F.when(found != "", found)

    return {"ts": time_struct(F.coalesce(line("timestamp"), F.lit("0.0"))), "label": line("label"), "root": line("root"), "bloom": line("bloom")}


def summary_name(label: Column, sec: Column, nsec: Column) -> Column:
    """label-YYYY-MM-DDTHHMMSS.nnnnnnnnnZ.txt, in UTC whatever the session's zone."""
    days, rest = F.floor(sec / 86400).cast("int"), F.pmod(sec, F.lit(86400).cast("bigint"))
    clock = F.concat(*[F.lpad(x.cast("bigint").cast("string"), 2, "0") for x in (F.floor(rest / 3600), F.floor(F.pmod(rest, F.lit(3600).cast("bigint")) / 60), F.pmod(rest, F.lit(60).cast("bigint")))])
    return F.concat(label, F.lit("-"), F.date_format(F.date_from_unix_date(days), "yyyy-MM-dd"), F.lit("T"), clock, F.lit("."), F.lpad(nsec.cast("string"), 9, "0"), F.lit("Z.txt"))


def read_summaries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, argpos and the fields of each summary file, in argument order."""
    text = spark.read.text(paths, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    order = spark.createDataFrame([(k, p.split("/")[-1]) for k, p in enumerate(paths)], "argpos int, name string")
    named = text.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(order, "name")
    return named.select("path", "argpos", *[c.alias(n) for n, c in summary_fields(F.col("value")).items()])


# Inode records: "key value" fields ended by NUL, then a section's name and its payload


def inode_record(mode: Column, uid: Column, gid: Column, mtim: Column, ctim: Column, nlink: Column, section: Column, payload: Column) -> Column:
    """Binary record; mtim and ctim are (sec, nsec) structs. nlink appears only above 1, a null section (a FIFO) ends the record."""
    field = lambda name, value: F.concat(F.lit(f"{name} "), value, F.lit("\0"))
    head = F.concat(
        field("mode", octal(mode)), field("uid", uid.cast("string")), field("gid", gid.cast("string")), field("mtim", time_text(mtim["sec"], mtim["nsec"])), field("ctim", time_text(ctim["sec"], ctim["nsec"])),
        F.when(nlink > 1, field("nlink", nlink.cast("string"))).otherwise(F.lit("")), F.coalesce(F.concat(section, F.lit("\0")), F.lit("")),
    )
    return F.concat(F.encode(head, "UTF-8"), F.coalesce(payload, F.lit(b"").cast("binary")))


def inode_fields(record: Column) -> dict[str, Column]:
    """The fields of a record and its section; unknown keys are skipped, a missing nlink is 1, a record may end after its fields.

    payload is the binary rest after the section's name, found by octets, so any bytes may be in it.
    """
    latin = F.decode(record, "ISO-8859-1")  # one character for each octet
    head = F.regexp_extract(latin, r"(?s)^((?:(?!(?:dents|idata|blocks)\x00)[^\x00 ]+ [^\x00]*\x00)*)", 1)
    pairs = F.str_to_map(F.rtrim(head, F.lit("\0")), F.lit("\\x00"), F.lit(" "))
    section = F.regexp_extract(F.substring(latin, F.length(head) + 1, F.lit(7)), r"(?s)^(dents|idata|blocks)\x00", 1)
    start = F.length(head) + F.length(section) + 2
    return {
        "mode": F.conv(pairs["mode"], 8, 10).cast("int"), "uid": pairs["uid"].cast("bigint"), "gid": pairs["gid"].cast("bigint"), "mtim": time_struct(pairs["mtim"]), "ctim": time_struct(pairs["ctim"]),
        "nlink": F.coalesce(F.try_element_at(pairs, F.lit("nlink")).cast("bigint"), F.lit(1).cast("bigint")), "section": F.when(section != "", section),
        "payload": F.when(section != "", F.substring(record, start, F.octet_length(record))),
    }


# Directory listings: an id and a name ended by NUL for each entry, in name order


def dents(name: Column, value: Column) -> Column:
    """An aggregate: the payload of a directory's record from its entries' names and (hexadecimal) ids."""
    each = F.array_sort(F.collect_list(F.struct(name.alias("name"), value.alias("value"))))
    return F.unhex(F.array_join(F.transform(each, lambda e: F.concat(e["value"], F.hex(F.encode(e["name"], "UTF-8")), F.lit("00"))), ""))


def dents_entries(payload: Column, id_bytes: int = 28) -> Column:
    """Array of (id, name) from a payload; null if it is cut off or an entry has no name."""
    shown = F.lower(F.hex(payload))
    digits = 2 * id_bytes
    entry = rf"([0-9a-f]{{{digits}}}(?:(?!00)[0-9a-f]{{2}})+00)"
    found = F.regexp_extract_all(shown, F.lit(entry), F.lit(1))
    name = lambda e: F.decode(F.unhex(F.substring(e, digits + 1, F.length(e) - digits - 2)), "UTF-8")
    entries = F.transform(found, lambda e: F.struct(F.substring(e, F.lit(1), F.lit(digits)).alias("id"), name(e).alias("name")))
    return F.when(F.length(F.array_join(found, "")) == F.length(shown), entries)


# Archives


def tar_bytes(size: Column) -> Column:
    """Bytes that an object of `size` content bytes takes in an archive: its own header, the archive's, and padding."""
    whole = size + OBJECT_HEADER
    return (whole + TAR_HEADER + F.pmod(-whole, F.lit(TAR_BLOCK).cast("bigint"))).cast("bigint")


def tar_header(name: str, size: int) -> bytes:
    """A ustar header: mode 0644, everything else zero, the checksum over a header whose checksum is blank."""
    raw = name.encode()
    if len(raw) > 100:
        raise ValueError("the name is too long for a header")
    number = lambda v, width: b"%0*o\0" % (width - 1, v)
    fields = [raw.ljust(100, b"\0"), number(0o644, 8), number(0, 8), number(0, 8), number(size, 12), number(0, 12), b" " * 8, b"0", bytes(100), b"ustar\0", b"00"]
    head = b"".join(fields).ljust(TAR_HEADER, b"\0")
    return head[:148] + b"%06o\0 " % sum(head) + head[156:]


def tar_record(name: str, content: bytes) -> bytes:
    return tar_header(name, len(content)) + content + bytes(-len(content) % TAR_BLOCK)
