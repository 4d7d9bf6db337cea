"""A repository of snapshots, with the commands of a backup tool as methods.

Layout, below a folder that Spark's file systems reach: objects/ (id, content), nodes/snapshot=N (the
entries), trees/ (id, dents: a directory's listing, once for all snapshots that share it), filters/snapshot=N (words
of the snapshot's Bloom filter), summaries/ (the table) and NAME.txt (a summary's text), errors/snapshot=N, and index/
(versions of the keyed tables). Tables are Parquet; an object's id is the digest of its content, so equal blocks are
stored once. A file is told by device and inode: what was renamed is not read again, and hard links are one file.
"""

from __future__ import annotations

import itertools
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import crypto, globs
from moraine.functions.hashing import BLOCK_MARK, digest, hexed, set_digest
from moraine.operators import chunk, diff, gc, retention, tree
from moraine.operators.index import IndexTables
from moraine.sources import formats

NODES = (
    "path string, kind string, mode int, uid bigint, gid bigint, mtim struct<sec:bigint,nsec:int>, target string, inline binary, blocks array<string>, digest string, "
    "dev_label string, ino decimal(20,0), nlink bigint, subtree string"
)
SUMMARIES = "id string, label string, ts timestamp_ntz, root string, argpos int, has_bloom boolean, bloom string, head string, filter_bytes bigint"
OBJECTS = "id string, content binary, blob_id string"
FILTERS = "word bigint, bits bigint"
#: What tells a file.
IDENTITY = ["dev_label", "ino"]


@dataclass(frozen=True)
class Config:
    label: str = "backup"
    block_size: int = chunk.DEFAULT_BLOCK
    digest: str = "sha3_224"
    cross_devices: bool = False
    glob_mode: str = "documented"
    #: Public key (hexadecimal) for which blocks and the contents of small files are sealed; none leaves them clear. Names, times and listings are never sealed.
    recipient: str = ""


class Repository:
    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or Config()
        chunk.content_size(self.config.block_size)
        self.index = IndexTables(spark, f"{self.path}/index")

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if self.index._fs.exists(self.index._paths(f"{self.path}/{name}")) else self.spark.createDataFrame([], schema)

    def objects(self) -> DataFrame:
        """id (of the clear block), content (sealed if there is a recipient) and blob_id (of the sealed one)."""
        return self._table("objects", OBJECTS)

    def opened(self, secret: bytes | None) -> DataFrame:
        """(id, content) in the clear. A blob that does not have its id has no content."""
        if not self.config.recipient:
            return self.objects().select("id", "content")
        if secret is None:
            raise ValueError("the blocks are sealed; a secret key is needed")

        def run(batches):
            opener = crypto.Opener(secret)
            for batch in batches:
                clear = []
                for blob, name in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    try:
                        clear.append(opener.open(blob, bytes.fromhex(name)))
                    except ValueError:
                        clear.append(None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clear, pa.binary())], ["id", "content"])

        return self.objects().mapInArrow(run, "id string, content binary")

    def _sealed_inline(self, data: Column) -> Column:
        """The content of small files as entries hold it."""
        if not self.config.recipient:
            return data
        recipient = bytes.fromhex(self.config.recipient)

        @F.pandas_udf("binary")
        def seal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            sealer = crypto.Sealer(recipient)
            for batch in batches:
                yield batch.map(lambda x: None if x is None else sealer.seal(bytes(x))[1])

        return seal.asNondeterministic()(data)

    def _opened_inline(self, data: Column, secret: bytes | None) -> Column:
        if not self.config.recipient:
            return data

        @F.pandas_udf("binary")
        def opened(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            opener = crypto.Opener(secret)
            for batch in batches:
                yield batch.map(lambda x: None if x is None else opener.open(bytes(x)))

        return opened(data)

    def _sealed(self, found: DataFrame) -> DataFrame:
        """(id, content, blob_id) as stored: each task seals under a key of its own, so no key and nonce are used twice, and ids of blobs differ from run to run."""
        if not self.config.recipient:
            return found.withColumn("blob_id", F.lit(None).cast("string"))
        recipient = bytes.fromhex(self.config.recipient)

        def run(batches):
            sealer = crypto.Sealer(recipient)
            for batch in batches:
                sealed = [sealer.seal(x) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b for _, b in sealed], pa.binary()), pa.array([n.hex() for n, _ in sealed], pa.string())], ["id", "content", "blob_id"])

        return found.mapInArrow(run, OBJECTS)

    def snapshots(self) -> DataFrame:
        return self._table("summaries", SUMMARIES)

    def nodes(self, snapshot: str) -> DataFrame:
        return self._table(f"nodes/snapshot={snapshot}", NODES)

    # backup

    def admissible(self, files: DataFrame, devices: DataFrame | None = None, exclude: list[str] | None = None) -> DataFrame:
        """Directories, regular files, links and FIFOs on the allowed devices that no pattern excludes, alone or through a directory above."""
        out = files.where(F.col("kind").isin("dir", "reg", "lnk", "fifo"))
        if devices is not None and "dev" in files.columns:
            root = files.where("path = '/'").select("dev").first()
            out = diff.on_devices(out, devices, "dev", root[0] if root else None, self.config.cross_devices)
        return tree.without_excluded(out, "path", globs.combined(exclude or [], self.config.glob_mode)) if exclude else out

    def _told(self, files: DataFrame, devices: DataFrame | None) -> DataFrame:
        """Adds dev_label (the device's label, else its number in hexadecimal); without device and inode a file is told by its path."""
        if "ino" not in files.columns:
            return files.withColumns({"dev_label": F.concat(F.lit("path:"), "path"), "ino": F.lit(0).cast("decimal(20,0)"), "nlink": F.lit(1).cast("bigint")})
        number = F.lower(F.hex(F.col("dev")))
        if devices is None or "label" not in devices.columns:
            return files.withColumn("dev_label", number)
        named = devices.select("dev", F.col("label").alias("_label")).dropDuplicates(["dev"])
        return files.join(named, "dev", "left").withColumn("dev_label", F.coalesce("_label", number)).drop("_label")

    def _staged(self, df: DataFrame, at: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{at}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{at}")

    def _pieces(self, files: DataFrame, contents: DataFrame) -> DataFrame:
        """(path, block, data, id) of the files' contents, read and digested once: a small file is one row of block -1, one that cannot be read a row of block -2."""
        size, n = chunk.content_size(self.config.block_size), F.octet_length("content")
        places = F.when(n.isNull(), F.array(F.lit(-2))).when(chunk.is_inline(n), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), ((n - 1) / size).cast("int")))
        rows = files.select("path").join(contents.select("path", "content"), "path", "left").select("path", "content", F.explode(places).alias("block"))
        data = F.when(F.col("block") >= 0, F.substring("content", F.col("block") * size + 1, F.lit(size))).when(F.col("block") == -1, F.col("content"))
        mark = F.when(F.col("block") >= 0, F.concat(F.lit(BLOCK_MARK), F.col("data"))).otherwise(F.col("data"))
        return rows.select("path", F.col("block").cast("bigint").alias("block"), data.alias("data")).withColumn("id", hexed(digest(mark, self.config.digest)))

    def backup(self, files: DataFrame, contents: DataFrame, devices: DataFrame | None = None, exclude: list[str] | None = None, commit: bool = True, dry_run: bool = False, now: float | None = None) -> dict:
        """Take a snapshot of files (inode rows) and contents (path, content).

        Content is read only for files whose (device, inode) is new or strictly later than the previous walk, once for all
        hard links, in one pass that is staged; a block is written only if no earlier snapshot has it. A file that
        vanishes in between, or cannot be read, is an error row and not part of the snapshot. Returns the counts and
        the snapshot's id. An interrupted backup leaves at most objects that no snapshot needs and a pending index.
        """
        spark, started = self.spark, time.time() if now is None else now
        before = self.index.read("meta").first()
        if before and (before["sec"], before["nsec"]) > (int(started), int(started % 1 * 1e9)):
            raise ValueError("the previous index is from the future")
        if self.index.exists("v-pending"):
            raise FileExistsError("a pending index exists; commit or abort it first")
        snapshot = f"{self.config.label}-{int(started)}-{int(started % 1 * 1e9):09d}"
        work = f"work/{snapshot}-{uuid.uuid4().hex[:8]}"
        try:
            return self._backup(files, contents, devices, exclude, commit, dry_run, started, before, snapshot, work)
        finally:
            self.index._fs.delete(self.index._paths(f"{self.path}/{work}"), True)

    def _backup(self, files, contents, devices, exclude, commit, dry_run, started, before, snapshot, work) -> dict:
        spark, sec, nsec = self.spark, int(started), int(started % 1 * 1e9)
        told = self._told(self.admissible(files, devices, exclude), devices)
        rows = self._staged(tree.visited_once(told, IDENTITY)[0] if "ino" in files.columns else told, f"{work}/rows")
        since = F.struct(F.lit(before["sec"] if before else -(2**62)).alias("sec"), F.lit(before["nsec"] if before else 0).alias("nsec"))
        last = self.snapshots().orderBy(F.desc("ts")).select("id").first()
        known = self.nodes(last[0]) if last else spark.createDataFrame([], NODES)
        # One row for each file that the last snapshot holds, whatever its paths were.
        held = known.where("kind = 'reg'").groupBy(*IDENTITY).agg(F.min(F.struct("path", "inline", "blocks", "digest")).alias("was"), F.lit(True).alias("_found"))
        regular = chunk.hardlinks(rows.where("kind = 'reg'"), IDENTITY, "path").join(held, IDENTITY, "left")
        regular = regular.withColumn("reuse", F.coalesce("_found", F.lit(False)) & ~diff.is_changed(F.col("mtim"), F.col("ctim"), since))
        regular = self._staged(regular, f"{work}/regular")
        stale = regular.where("not reuse and not is_link")
        pieces = self._staged(self._pieces(stale, contents), f"{work}/pieces")
        failed = pieces.where("block = -2").select("path", F.lit("the file could not be read").alias("error"))
        errors = failed.unionByName(files.where("error is not null").select("path", "error")) if "error" in files.columns else failed
        # New blocks are picked by their digests; only their contents move.
        first = pieces.where("block >= 0").groupBy("id").agg(F.min(F.struct("path", "block")).alias("at")).join(self.objects().select("id"), "id", "left_anti")
        first = self._staged(first.select("id", "at.path", "at.block"), f"{work}/first")
        counts = {"snapshot": snapshot, "files": rows.count(), "read": stale.count(), "errors": errors.count()}
        if dry_run:
            return counts | {"new_objects": first.count()}
        new = pieces.select("path", "block", "data").join(first, ["path", "block"]).select("id", F.col("data").alias("content"))
        self._sealed(new).write.mode("append").parquet(f"{self.path}/objects")
        small = pieces.where("block = -1").select("path", self._sealed_inline(F.col("data")).alias("inline"), F.lit(None).cast("array<string>").alias("blocks"), F.col("id").alias("digest"))
        lists = pieces.where("block >= 0").groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "id"))), lambda b: b["id"]).alias("blocks"))
        large = lists.select("path", F.lit(None).cast("binary").alias("inline"), "blocks", hexed(digest(F.encode(F.array_join("blocks", ""), "UTF-8"), self.config.digest)).alias("digest"))
        fresh = small.unionByName(large).withColumnRenamed("path", "first")
        shown = ["path", "kind", "mode", "uid", "gid", "mtim", "target"]
        told = ["dev_label", "ino", "nlink"]
        body = ["inline", "blocks", "digest"]
        read = regular.where("not reuse").select(*shown, *told, "first").join(fresh, "first").select(*shown, *body, *told)
        same = regular.where("reuse").select(*shown, *[F.col(f"was.{c}").alias(c) for c in body], *told)
        other = rows.where("kind <> 'reg'").select(*shown, F.lit(None).cast("binary").alias("inline"), F.lit(None).cast("array<string>").alias("blocks"), F.sha2(F.coalesce("target", F.lit("")), 256).alias("digest"), *told)
        entries = self._staged(same.unionByName(read).unionByName(other), f"{work}/entries")
        root, trees, new_trees = self._tree(entries, work)
        folders = trees.groupBy("path").agg(F.first("value").alias("subtree"))
        entries.join(folders, "path", "left").write.parquet(f"{self.path}/nodes/snapshot={snapshot}")
        errors.write.parquet(f"{self.path}/errors/snapshot={snapshot}")
        stored = self.nodes(snapshot)
        ids = stored.select(F.explode("blocks").alias("id")).unionByName(stored.where("subtree is not null").select(F.col("subtree").alias("id"))).distinct()
        bloom, head, n_bytes = self._filter(ids, snapshot)
        regs = stored.where("kind = 'reg'")
        blocks = regs.select(F.explode("blocks").alias("id")).distinct().join(self.objects().select("id", "blob_id"), "id").select(F.unhex("id").alias("clear_hash"), F.unhex(F.coalesce("blob_id", "id")).alias("blob_id"))
        deps = regs.dropDuplicates(IDENTITY).select(*IDENTITY, F.posexplode("blocks").alias("block", "h")).select(*IDENTITY, "block", F.unhex("h").alias("clear_hash"))
        inodes = stored.dropDuplicates(IDENTITY).select(*IDENTITY, F.unhex(F.coalesce("subtree", "digest")).alias("blob_id"))
        self.index.stage({"inodes": inodes, "deps": deps, "blocks": blocks, "meta": spark.createDataFrame([(sec, nsec)], "sec bigint, nsec int")})
        when = F.timestamp_seconds(F.lit(started)).cast("timestamp_ntz")
        row = {"id": F.lit(snapshot), "label": F.lit(self.config.label), "ts": when, "root": F.lit(root), "argpos": F.lit(0), "has_bloom": F.lit(True), "bloom": F.lit(bloom), "head": F.lit(head.hex()), "filter_bytes": F.lit(n_bytes).cast("bigint")}
        one = spark.range(1).select(*[c.alias(n) for n, c in row.items()])
        text = one.select(formats.summary_name(F.col("label"), F.lit(sec).cast("bigint"), F.lit(nsec)), formats.summary_text(F.lit(sec), F.lit(nsec), F.col("label"), F.col("root"), F.col("bloom"))).first()
        self._write(text[0], text[1].encode())
        one.write.mode("append").parquet(f"{self.path}/summaries")
        if commit:
            self.index.commit()
        return counts | {"root": root, "objects": self.objects().count(), "new_trees": new_trees}

    def _tree(self, entries: DataFrame, work: str) -> tuple[str | None, DataFrame, int]:
        """The root's digest, (path, value) of all directories, and how many directories no earlier snapshot holds; their listings are stored."""
        bare = F.regexp_replace("path", "/$", "")
        nodes = entries.select(
            F.when(F.col("path") == "/", "/").otherwise(bare).alias("id"), F.when(F.col("path") == "/", F.lit(None)).when(F.length(F.regexp_replace(bare, "/[^/]*$", "")) == 0, "/").otherwise(F.regexp_replace(bare, "/[^/]*$", "")).alias("parent"),
            F.when(F.col("path") == "/", 0).otherwise(F.size(F.split(bare, "/")) - 1).alias("depth"), F.element_at(F.split(bare, "/"), -1).alias("name"), "path", "kind",
            F.concat_ws(" ", "kind", F.col("mode").cast("string"), F.col("digest")).alias("own_text"),
        )
        nodes, number = self._staged(nodes, f"{work}/tree"), itertools.count()
        rolled = tree.merkle(nodes, F.col("own_text"), stage=lambda df: self._staged(df, f"{work}/level-{next(number)}"))
        folders = rolled.where("kind = 'dir'").select("id", "path", "value")
        listing = rolled.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(formats.dents(F.col("name"), F.col("value")).alias("dents"))
        held = self._table("trees", "id string, dents binary").select(F.col("id").alias("value"))
        new = folders.join(held, "value", "left_anti").join(listing, "id", "left").groupBy("value").agg(F.first("dents").alias("dents"))
        new = self._staged(new.select(F.col("value").alias("id"), F.coalesce("dents", F.lit(b"").cast("binary")).alias("dents")), f"{work}/trees")
        new.write.mode("append").parquet(f"{self.path}/trees")
        root = folders.where("path = '/'").select("value").first()
        return root[0] if root else None, folders.select("path", "value"), new.count()

    def _filter(self, ids: DataFrame, snapshot: str) -> tuple[str, bytes, int]:
        """Store the Bloom filter over the ids (hexadecimal) as a table of words; returns its digest, header and size."""
        head, n_bytes = gc.header(), gc.filter_bytes(ids.count())
        words = gc.build(ids, gc.bits(F.unhex("id"), head, n_bytes))
        words.write.parquet(f"{self.path}/filters/snapshot={snapshot}")
        line = F.concat_ws(" ", F.col("word").cast("string"), F.col("bits").cast("string"))
        return self._table(f"filters/snapshot={snapshot}", FILTERS).agg(set_digest(F.concat(F.lit(head.hex()), F.lit(" "), line))).first()[0], head, n_bytes

    def _write(self, name: str, data: bytes) -> None:
        out = self.index._fs.create(self.index._paths(f"{self.path}/{name}"), True)
        out.write(bytearray(data))
        out.close()

    def commit(self) -> bool:
        return self.index.commit()

    def abort(self) -> bool:
        return self.index.abort()

    # restore, prune, cull

    def listing(self, snapshot: str) -> DataFrame:
        """path and digest of everything in a snapshot."""
        return self.nodes(snapshot).select("path", "kind", "digest").orderBy("path")

    def restore(self, snapshot: str, secret: bytes | None = None) -> DataFrame:
        """Sealed blocks are opened with the secret key.

        (path, kind, mode, uid, gid, mtim, target, content, is_intact, first, is_link); is_intact is false where an object is missing or does not have its id, or a small file's content not its digest.

        Of the paths of one file the first holds the content; the others are links to it and have none.
        """
        if self.config.recipient and secret is None:
            raise ValueError("the blocks are sealed; a secret key is needed")
        every = self.nodes(snapshot).withColumn("inline", self._opened_inline(F.col("inline"), secret))
        regular = chunk.hardlinks(every.where("kind = 'reg'"), IDENTITY, "path")
        nodes = regular.unionByName(every.where("kind <> 'reg'").withColumns({"first": F.col("path"), "is_link": F.lit(False)}))
        asked = regular.where("blocks is not null and not is_link").select("path", F.posexplode("blocks").alias("block", "id"))
        mark = hexed(chunk.block_digest(F.col("content"), self.config.digest))
        got = asked.join(self.opened(secret), "id", "left").withColumn("ok", F.coalesce(mark == F.col("id"), F.lit(False)))
        joined = got.groupBy("path").agg(chunk.joined("content", "block").alias("joined"), F.bool_and("ok").alias("ok"))
        content = F.when(~F.col("is_link"), F.coalesce("joined", "inline")).alias("content")
        whole = F.when(F.col("inline").isNotNull(), hexed(digest(F.col("inline"), self.config.digest)) == F.col("digest")).otherwise(F.coalesce("ok", F.lit(True)))
        return nodes.join(joined, "path", "left").select("path", "kind", "mode", "uid", "gid", "mtim", "target", content, whole.alias("is_intact"), "first", "is_link")

    def prune(self, keep: list[str] | None = None, invert: bool = False, filters: bool = False) -> DataFrame:
        """ids of objects that no snapshot (or none of those to keep) reaches; with invert, of those that are needed. Nothing is deleted.

        filters: ask the snapshots' Bloom filters instead of their entries, as one can who has only these: what they
        let go is garbage for certain, some of it they keep.
        """
        ids, kept = self.objects().select("id"), self.snapshots() if keep is None else self.snapshots().where(F.col("id").isin(keep))
        if filters:
            live = ids.limit(0)
            for s in kept.where("has_bloom").select("id", "head", "filter_bytes").toLocalIterator():
                words = self._table(f"filters/snapshot={s['id']}", FILTERS)
                live = live.unionByName(gc.matching(ids, gc.bits(F.unhex("id"), bytes.fromhex(s["head"]), s["filter_bytes"]), words))
        else:
            nodes = self._table("nodes", f"{NODES}, snapshot string").join(kept.select(F.col("id").alias("snapshot")), "snapshot", "left_semi")
            live = nodes.select(F.explode("blocks").alias("id"))
        return ids.join(live, "id", "left_semi") if invert else gc.garbage(ids, [live])

    def stale_filters(self, keep: list[str]) -> list[str]:
        """Snapshots whose filters are not those of the ones to keep, told by a small filter over the kept filters' digests."""
        of = {r["id"]: bytes.fromhex(r["bloom"]) for r in self.snapshots().where("has_bloom").select("id", "bloom").toLocalIterator()}
        has = gc.filter_of_filters([of[k] for k in keep if k in of])
        return sorted(name for name, bloom in of.items() if not has(bloom))

    def cull(self, rules: dict[str, int] | None = None, by_label: bool = False, invert: bool = False) -> DataFrame:
        """Snapshots that the policy would delete; with invert, those that it keeps."""
        by = ["label"] if by_label else []
        found = self.snapshots()
        return found.join(retention.kept(found, by, rules), "id", "left_semi") if invert else retention.culled(found, by, rules)


def write_files(restored: DataFrame, folder: str, owners: bool = False, permissions: bool = True, times: bool = True) -> int:
    """Create the files of a restored snapshot below folder; returns how many files are not intact.

    Directories come first, hard links after the files that they link to, and modes, times and (where asked for) owners of
    directories last, deepest first, as files that are made in them would change these.
    """
    import os

    def settle(at: str, r) -> None:
        if owners:
            os.chown(at, r["uid"], r["gid"], follow_symlinks=False)
        if permissions and r["kind"] != "lnk":
            os.chmod(at, r["mode"] & 0o7777)
        if times:
            os.utime(at, ns=(r["mtim"]["sec"] * 10**9 + r["mtim"]["nsec"],) * 2, follow_symlinks=False)

    for r in restored.where("kind = 'dir'").select("path").orderBy("path").toLocalIterator():
        os.makedirs(folder + r["path"], exist_ok=True)

    def create(rows) -> None:
        for r in rows:
            at = folder + r["path"]
            os.makedirs(os.path.dirname(at), exist_ok=True)
            if r["kind"] == "lnk":
                os.symlink(r["target"], at)
            elif r["kind"] == "fifo":
                os.mkfifo(at)
            else:
                with open(at, "xb") as f:
                    f.write(bytes(r["content"] or b""))
            settle(at, r)

    def link(rows) -> None:
        for r in rows:
            os.makedirs(os.path.dirname(folder + r["path"]), exist_ok=True)
            os.link(folder + r["first"], folder + r["path"])

    restored.where("kind <> 'dir' and not is_link").foreachPartition(create)
    restored.where("is_link").select("path", "first").foreachPartition(link)
    for r in restored.where("kind = 'dir'").select("path", "kind", "mode", "uid", "gid", "mtim").orderBy(F.desc("path")).toLocalIterator():
        settle(folder + r["path"], r)
    return restored.where("not is_intact").count()
