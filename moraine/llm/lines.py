"""Line de-duplication over windows of three consecutive lines.

Windows of all documents are hashed and grouped globally in DataFrame operations; every occurrence of a
window but the first is removed, by merging the positions that such windows cover. Blank lines are no part
of a window and always stay. The lines are taken out in Arrow batches: array functions would look each
line up in a list, which is quadratic in a long document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import id_type, map_batches, staged

WINDOW = 3
#: Characters of which a blank line consists.
WHITE = " \t\n\x0b\x0c\r"


def line_array(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def without(text: str, covered: list[int] | None) -> tuple[str, int, int]:
    """(text, lines, lines removed) after the covered places among the solid lines are removed, in time linear in the text."""
    if not covered:
        return text, text.count("\n") + 1, 0
    every, gone, place, kept = text.split("\n"), set(covered), -1, []
    for line in every:
        place += (solid := bool(line.strip(WHITE)))
        if not solid or place not in gone:
            kept.append(line)
    return "\n".join(kept), len(every), len(every) - len(kept)


def windows(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(rid, doc_id, at, hash) of numbered rows: each window's row number, id, place among its document's solid lines, and MD5."""
    rows = rows.select("rid", "doc_id", line_array(F.col("text")).alias("all_lines"))
    rows = rows.select("rid", "doc_id", F.filter("all_lines", lambda line: F.translate(line, WHITE, "") != "").alias("lines")).where(F.size("lines") >= window)
    hashes = F.transform(F.sequence(F.lit(1), F.size("lines") - (window - 1)), lambda k: F.unhex(F.md5(F.array_join(F.slice("lines", k, window), "\n"))))
    return rows.select("rid", "doc_id", F.posexplode(hashes).alias("at", "hash"))


def repeats(found: DataFrame) -> DataFrame:
    """(rid, at) of every window that is not the first of its hash; the first is the one with the smallest doc_id (nulls last), row and place."""
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid", "at")
    groups = found.groupBy("hash").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1")
    groups = staged(groups.select("hash", F.col("first.rid").alias("first_rid"), F.col("first.at").alias("first_at")), "groups")
    # Both joins below are shuffles at any size: their smaller sides grow with the input too.
    return found.join(groups.hint("merge"), "hash").where("rid <> first_rid or at <> first_at").select("rid", "at")


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each document: doc_id, clean_text, n_lines, n_removed.

    Occurrences are ordered by doc_id (nulls last), row and position, in one document or several;
    of rows that are repeated whole, the first keeps its lines. A null text gives an empty clean_text, one
    line and nothing removed. Texts with fewer solid lines than a window are left alone. Other columns are
    ignored; an empty table gives an empty table. The rows are numbered once and staged with their numbers, so
    docs may read in another order each time.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    numbered = staged(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text.alias("text")), "numbered")
    found = staged(windows(numbered, window), "windows")
    covered = repeats(found).groupBy("rid").agg(F.collect_set("at").alias("at"))
    covered = covered.select("rid", F.array_distinct(F.flatten(F.transform("at", lambda k: F.sequence(k, k + (window - 1))))).alias("covered"))
    rows = numbered.join(staged(covered, "covered").hint("merge"), "rid", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [without(text, places) for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            clean, n, gone = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], ["doc_id", "clean_text", "n_lines", "n_removed"])

    return map_batches(rows.select("doc_id", "text", "covered"), cut, f"doc_id {id_type(docs)}, clean_text string, n_lines bigint, n_removed bigint")
