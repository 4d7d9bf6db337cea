"""Directory trees: Merkle roll-up, dirty propagation, sizes and paths.

A tree is a table of nodes (id, parent, depth, name); the root has a null parent and depth 0. Upward
aggregates and downward walks go level by level, one shuffle each. What a level hands to the next is staged where
the caller gives a stage (a table in a shared folder), so that plans and scans grow with the depth and not with its square;
without one it is a part of the next level's plan, which suits a few levels only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Writes a table and reads it back.
Stage = Callable[[DataFrame], DataFrame]


def depths(nodes: DataFrame) -> int:
    return nodes.agg(F.max("depth")).first()[0] or 0


def upward(nodes: DataFrame, own: Column, gather: Callable[[], Column], combine: Callable[[Column, Column], Column], levels: int | None = None, stage: Stage | None = None) -> DataFrame:
    """Adds value to each node, from the deepest level up.

    own: a node's value before its children count. gather(): an aggregate over the children's columns name
    and value. combine(own, gathered): a node's value; gathered is null without children. Only parents are joined with
    what their children gather: the deepest level never is, nor are leaves moved for it.
    """
    levels = depths(nodes) if levels is None else levels
    keep = stage or (lambda df: df)
    base = nodes.withColumn("own", own)
    columns = [*nodes.columns, "value"]
    out = below = keep(base.where(F.col("depth") == levels).withColumn("value", combine(F.col("own"), F.lit(None))).select(*columns))
    for depth in range(levels - 1, -1, -1):
        gathered = below.groupBy(F.col("parent").alias("id")).agg(gather().alias("_gathered"))
        mine = base.where(F.col("depth") == depth).join(gathered, "id", "left")
        below = keep(mine.withColumn("value", combine(F.col("own"), F.col("_gathered"))).select(*columns))
        out = out.unionByName(below)
    return out


def merkle(nodes: DataFrame, own: Column, levels: int | None = None, stage: Stage | None = None) -> DataFrame:
    """value: the SHA-256 of a node's own text, and for a directory of its children's names and digests in name order."""
    return upward(nodes, own, listed, lambda mine, below: F.sha2(F.concat(mine, F.lit("|"), F.coalesce(below, F.lit(""))), 256), levels, stage)


def listed() -> Column:
    """name:value of the children in name order, comma-joined. A directory's listing is one value, as it is in its record."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "value"))), lambda c: F.concat(c["name"], F.lit(":"), c["value"])), ",")


def dirty(nodes: DataFrame, own: Column, levels: int | None = None, stage: Stage | None = None) -> DataFrame:
    """value: whether a node or anything below it changed."""
    return upward(nodes, own, lambda: F.bool_or("value"), lambda mine, below: mine | F.coalesce(below.cast("boolean"), F.lit(False)), levels, stage)


def totals(nodes: DataFrame, own: Column, levels: int | None = None, stage: Stage | None = None) -> DataFrame:
    """value: the sum of own, a struct of numbers or a number, over a node and all below it."""
    kind = nodes.select(own.alias("own")).schema["own"].dataType
    fields = [f.name for f in kind.fields] if hasattr(kind, "fields") else []
    if not fields:
        return upward(nodes, own, lambda: F.sum("value"), lambda mine, below: (mine + F.coalesce(below.cast("bigint"), F.lit(0))).cast("bigint"), levels, stage)
    shape = "struct<" + ",".join(f"`{f}`:bigint" for f in fields) + ">"
    gather = lambda: F.struct(*[F.sum(F.col("value")[f]).alias(f) for f in fields])
    add = lambda mine, below: F.struct(*[(mine[f] + F.coalesce(below.cast(shape)[f], F.lit(0))).cast("bigint").alias(f) for f in fields])
    return upward(nodes, own, gather, add, levels, stage)


def paths(nodes: DataFrame, levels: int | None = None, stage: Stage | None = None) -> DataFrame:
    """Adds path: the names from the root, each after a slash; the root's is empty."""
    levels = depths(nodes) if levels is None else levels
    keep = stage or (lambda df: df)
    above = out = keep(nodes.where("depth = 0").withColumn("path", F.lit("")))
    for depth in range(1, levels + 1):
        step = nodes.where(F.col("depth") == depth).join(above.select(F.col("id").alias("parent"), F.col("path").alias("_above")), "parent")
        above = keep(step.withColumn("path", F.concat("_above", F.lit("/"), "name")).select(*out.columns))
        out = out.unionByName(above)
    return out


def marked_parents(excluded_rows: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """(id) of the directories that hold an excluded entry which the previous index knows; they count as changed."""
    return excluded_rows.join(previous.select(*keys).distinct(), keys, "left_semi").select(F.col("parent").alias("id")).where("id is not null").distinct()


def visited_once(files: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(files, skipped): a directory that is met again under another path is skipped with all that is below it; the first path stays.

    files: path (directories end in a slash), kind and the keys that tell a directory.
    """
    folders = files.where((F.col("kind") == "dir") & F.col(keys[-1]).isNotNull())
    first = folders.groupBy(*keys).agg(F.min("path").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    again = folders.join(first, keys).where(F.col("path") != F.col("_first")).select(F.col("path").alias("_top"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))
    below = files.select("path", F.explode(above).alias("_top")).join(again, "_top", "left_semi").select("path").distinct()
    return files.join(below, "path", "left_anti"), again.select(F.col("_top").alias("path"))


def excluded(files: DataFrame, path: str, expression: str) -> Column:
    """Whether a path, or a directory above it, matches: its prefixes are tested inside the row, without a join."""
    parts = F.split(F.col(path), "/")
    prefixes = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))
    above = F.filter(prefixes, lambda p: F.length(p) <= F.length(F.col(path)))
    return F.col(path).rlike(expression) | F.exists(above, lambda p: p.rlike(expression))


def without_excluded(files: DataFrame, path: str, expression: str) -> DataFrame:
    return files.where(~excluded(files, path, expression))
