"""Near-duplicate detection with SimHash fingerprints and sharded BK-trees.

1. A Python worker fingerprints every whole text (one pass, no shuffle of texts).
2. Distinct fingerprints are cut into radius + 1 bit blocks. Two of them within the radius
   differ in fewer blocks than there are, so they share one block at least: each
   (block, value) is a shard, and only members of the same shard are compared.
3. In each shard a BK-tree is built: children are keyed by their integer Hamming distance to
   the parent. A search at distance d from a node follows only edges in [d - r, d + r].
   Shards of up to SHARD_KEYS keys are searched whole, many in one task. The other bits of a
   larger shard are cut into radius + 1 blocks again, so its keys go to radius + 1 times as many
   shards, each about a thousandth of it in size: work grows with the keys, not with their square.
   Only a shard that further blocks do not thin out (near copies by the thousand, which share most of
   their bits) is cut into parts of SHARD_KEYS keys; each part's tree is broadcast to the other parts
   of its shard, so what is copied has a proven bound (SHARD_KEYS keys of 8 bytes) at any corpus size.
4. A shard reports a star for each of its local components, so its output never exceeds its
   members, however many pairs are close; components() joins the stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import id_type, kept_rows, map_batches, parts_for, staged
from moraine.llm.graph import components

RADIUS = 4
WORDS = 4
SEED = 42
#: Keys of one BK-tree at most.
SHARD_KEYS = 8192
#: Rows of one search task, about.
TASK_ROWS = 40_000
#: (query, node) pairs looked at in one numpy step.
FRONTIER = 1 << 20
#: The bits of each byte, the highest first: counts of byte values times this give counts of bits.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
#: Shingles whose bits are counted in one numpy step.
STEP = 1 << 15


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of a text as an unsigned int.

    A-Z are lower-cased, words are runs of anything but ASCII white space, shingles are `words` of
    them joined by a space, repeats included; a shorter text is one shingle. Null, empty and blank
    texts give 0. A bit is 1 if it is set in over half of the shingles' XXH64 (seed 42).
    """
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    last = ends[words - 1 :] if len(found) >= words else ends[-1:]
    digest, counts = xxhash.xxh64_digest, np.zeros((8, 256), np.int64)
    for at in range(0, n, STEP):
        spans = zip(starts[at : min(n, at + STEP)].tolist(), last[at : at + STEP].tolist())
        hashes = np.frombuffer(b"".join([digest(line[a:b], SEED) for a, b in spans]), np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[k] += np.bincount(hashes[:, k], minlength=256)
    bits = (counts @ BYTE_BITS).ravel()
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, key) for every row; fp is the fingerprint as a signed 64-bit integer, key a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), batch.column(2)], ["doc_id", "fp", "key"])

    text = F.col("text").cast("string")
    return map_batches(docs.select("doc_id", text, F.xxhash64(text)), run, f"doc_id {id_type(docs)}, fp bigint, key bigint")


class BKForest:
    """BK-trees over distinct 64-bit keys, one for each tree number, built and searched level by level.

    edge[(parent, distance)] leads to the one child at that distance; the rest of the parent's
    keys at that distance are below the child.
    """

    def __init__(self, keys: np.ndarray, trees: np.ndarray):
        self.keys = keys
        order = np.argsort(trees, kind="stable")
        first = np.ones(len(order), bool)
        first[1:] = trees[order][1:] != trees[order][:-1]
        self.roots = dict(zip(trees[order][first].tolist(), order[first].tolist()))
        self.root_of = np.empty(len(keys), np.int64)
        self.root_of[order] = np.repeat(order[first], np.diff(np.append(np.flatnonzero(first), len(order))))
        waiting, parent = order[~first], self.root_of[order[~first]]
        edges, children = [], []
        while len(waiting):
            edge = parent * 65 + np.bitwise_count(keys[waiting] ^ keys[parent])
            order = np.argsort(edge, kind="stable")
            waiting, edge = waiting[order], edge[order]
            first = np.ones(len(edge), bool)
            first[1:] = edge[1:] != edge[:-1]
            edges.append(edge[first])
            children.append(waiting[first])
            parent = np.repeat(waiting[first], np.diff(np.append(np.flatnonzero(first), len(edge))))[~first]
            waiting = waiting[~first]
        self.edge = np.concatenate(edges) if edges else np.empty(0, np.int64)
        self.child = np.concatenate(children) if children else np.empty(0, np.int64)
        order = np.argsort(self.edge, kind="stable")
        self.edge, self.child = self.edge[order], self.child[order]

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query number, node number) within the radius, some at a time."""
        for at in range(0, len(queries), max(1, FRONTIER // 64)):
            q = np.arange(at, min(len(queries), at + max(1, FRONTIER // 64)))
            stack = [(q, roots[q])]
            while stack:
                q, node = stack.pop()
                if len(q) > FRONTIER:
                    half = len(q) // 2
                    stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                    continue
                d = np.bitwise_count(queries[q] ^ self.keys[node]).astype(np.int64)
                hit = d <= radius
                if hit.any():
                    yield q[hit], node[hit]
                low = np.searchsorted(self.edge, node * 65 + np.maximum(d - radius, 0), "left")
                high = np.searchsorted(self.edge, node * 65 + np.minimum(d + radius, 64), "right")
                n = high - low
                if total := int(n.sum()):
                    at_child = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(total)
                    stack.append((np.repeat(q, n), self.child[at_child]))


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of a[i] and b[i] in label, which names each component by its least member."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def stars(keys: np.ndarray, shards: np.ndarray, tree: np.ndarray | None = None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within the radius in the same shard, as (member, centre) of local components.

    tree: which keys the trees hold; all others are queries only. None: all are both.
    """
    held = np.arange(len(keys)) if tree is None else np.flatnonzero(tree)
    asked = np.arange(len(keys)) if tree is None else np.flatnonzero(~tree)
    label = np.arange(len(keys))
    if len(held) and len(asked):
        forest = BKForest(keys[held], shards[held])
        roots = forest.root_of if tree is None else np.array([forest.roots.get(s, -1) for s in shards[asked].tolist()])
        asked, roots = asked[roots >= 0], roots[roots >= 0]
        for q, node in forest.search(keys[asked], roots, radius):
            _merge(label, asked[q], held[node])
    linked = np.flatnonzero(label != np.arange(len(keys)))
    return keys[linked], keys[label[linked]]


def _found(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _search_task(table: pa.Table) -> pa.Table:
    keys = table.column("fp").to_numpy().view(np.uint64)
    return _found(*stars(keys, table.column("shard").to_numpy()))


def _search_parts(table: pa.Table) -> pa.Table:
    keys, part = table.column("fp").to_numpy().view(np.uint64), table.column("part").to_numpy()
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    return _found(*stars(keys, np.zeros(len(keys), np.int64), None if i == j else part == j))


def blocks(bits: list[int], radius: int) -> list[list[int]]:
    """radius + 1 blocks of nearly the same size, each a list of bit numbers, that make up the given bits."""
    cuts = [len(bits) * i // (radius + 1) for i in range(radius + 2)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:])]


def _value(bits: list[int]) -> Column:
    """The bits (neighbours) of fp as a number."""
    return F.shiftrightunsigned("fp", bits[0]).bitwiseAND(F.lit((1 << len(bits)) - 1))


def _route(keys: DataFrame, radius: int) -> DataFrame:
    """(fp, path, value) for each block of all 64 bits: path names the blocks that a shard shares, value their contents."""
    each = [F.struct(F.lit(k).cast("bigint").alias("path"), _value(bits).alias("value")) for k, bits in enumerate(blocks(list(range(64)), radius))]
    return keys.select("fp", F.explode(F.array(*each)).alias("x")).select("fp", "x.path", "x.value")


def _reroute(shards: DataFrame, radius: int) -> DataFrame:
    """(fp, path, value, next_path, next_value): each key of a shard in the shards of the blocks of the bits that its shard leaves open."""
    first, each = blocks(list(range(64)), radius), None
    for k, block in enumerate(first):
        # A block of the bits left is a run below the shard's own block and a run above it, either of which may be empty.
        structs = []
        for j, rest in enumerate(blocks([b for b in range(64) if b not in block], radius)):
            low, high = [b for b in rest if b < block[0]], [b for b in rest if b > block[-1]]
            value = F.lit(0).cast("bigint")
            for run in (low, high):
                value = value * (1 << len(run)) + _value(run) if run else value
            number = F.col("value") * (1 << len(rest)) + value
            structs.append(F.struct(F.lit(len(first) * (k + 1) + j).cast("bigint").alias("next_path"), number.alias("next_value")))
        each = F.when(F.col("path") == k, F.array(*structs)) if each is None else each.when(F.col("path") == k, F.array(*structs))
    return shards.select("fp", "path", "value", F.explode(each).alias("x")).select("fp", "path", "value", "x.next_path", "x.next_value")


def _searched(routed: DataFrame, n: int) -> DataFrame:
    """Stars of shards that are searched whole; a task takes many of them."""
    tasks = routed.select("fp", F.xxhash64("path", "value").alias("shard"))
    return tasks.withColumn("task", F.pmod("shard", F.lit(parts_for(n, TASK_ROWS)))).groupBy("task").applyInArrow(_search_task, "a bigint, b bigint")


def links(distinct: DataFrame, radius: int = RADIUS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Stars (a, b) over the fingerprints in distinct.fp whose components are those of all pairs within the radius."""
    routed, shard = _route(distinct, radius), ["path", "value"]
    large = staged(routed.groupBy(*shard).count().where(F.col("count") > shard_keys), "shards")
    n, split = distinct.count() * (radius + 1), large.count() > 0
    if not split:
        return _searched(routed, n)
    out = _searched(routed.join(large, shard, "left_anti"), n)
    finer = _reroute(routed.join(large, shard), radius)
    # What a shard costs is the square of its keys; finer shards are taken where they cost half of that at most and fit.
    inner = staged(finer.groupBy(*shard, "next_path", "next_value").agg(F.count("*").alias("keys")), "finer")
    cost = inner.groupBy(*shard).agg(F.sum(F.col("keys").cast("double") ** 2).alias("cost")).join(large, shard)
    thin = F.col("cost") * 2 <= F.col("count").cast("double") ** 2
    judged = staged(cost.select(*shard, "count", thin.alias("thin")), "judged")
    sizes = inner.join(judged.where("thin"), shard, "left_semi")
    over = sizes.where(F.col("keys") > shard_keys)
    down = finer.join(judged.where("thin"), shard, "left_semi").select("fp", F.col("next_path").alias("path"), F.col("next_value").alias("value"))
    crowded = over.select(F.col("next_path").alias("path"), F.col("next_value").alias("value"), F.col("keys").alias("count"))
    small = int(sizes.where(F.col("keys") <= shard_keys).agg(F.sum("keys")).first()[0] or 0)
    out = out.unionByName(_searched(down.join(crowded, shard, "left_anti"), small))
    thick = judged.where("not thin").select(*shard, "count")
    members = routed.join(thick, shard).unionByName(down.join(crowded, shard))
    cut = members.withColumn("parts", F.ceil(F.col("count") / shard_keys).cast("int")).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    cut = cut.select("fp", *shard, "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cut = cut.select("fp", *shard, "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    return out.unionByName(cut.groupBy(*shard, "i", "j").applyInArrow(_search_parts, "a bigint, b bigint"))


def _labelled(docs: DataFrame, radius: int, shard_keys: int) -> DataFrame:
    """(doc_id, fp, key, root, component_id) for every row; root names the component by one of its fingerprints."""
    fps = staged(fingerprints(docs), "fingerprints")
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    found = staged(links(distinct, radius, shard_keys), "links")
    roots = components(found)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    rooted = staged(rooted, "roots")
    names = staged(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "names")
    return fps.join(staged(rooted.join(names, "root").select("fp", "root", "component_id"), "named"), "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of fingerprints that differ in
    `radius` bits at most. Null and blank texts have fingerprint 0, which links like any other.
    Null ids keep their row and are passed over when the smallest is taken; repeated rows each
    come back; texts of any length are read whole. Other columns are ignored; an empty table gives an empty table.
    """
    return _labelled(docs, radius, shard_keys).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, exactly_one: bool = False) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest doc_id.

    exactly_one: rows without an id come last in their component, ties go to the least hash of the text, and one of rows
    that repeat both stays, so that each component keeps one row. Else documents are told by doc_id alone: rows that
    repeat the id that stays all stay, as do rows without an id. Null and blank texts are near copies of one another. An
    empty table gives an empty table.
    """
    found = _labelled(docs, RADIUS, SHARD_KEYS)
    if exactly_one:
        found = staged(found.groupBy("doc_id", "key", "root").agg(F.count("*").alias("copies")), "labelled")
        one = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
        best = staged(found.groupBy("root").agg(F.min(one).alias("best")), "best")
        kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key"))
        verdicts = found.join(best, "root").select("doc_id", "key", "copies", kept.alias("kept"))
        return kept_rows(docs, staged(verdicts, "verdicts"), {"doc_id": docs["doc_id"], "key": F.xxhash64(docs["text"].cast("string"))})
    verdicts = found.where("doc_id is not null").select("doc_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), F.lit(1).alias("copies")).distinct()
    # An id of several rows stays if one of them does.
    verdicts = verdicts.groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.max("copies").alias("copies"))
    return kept_rows(docs, staged(verdicts, "verdicts"), {"doc_id": docs["doc_id"]})
