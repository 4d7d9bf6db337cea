"""Operators against small models, published vectors and round trips; queries against DuckDB."""

import hashlib
import os
import random
import re
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from moraine import __main__ as cli
from moraine.functions import crypto, globs, hashing
from moraine.functions.keccak import keccak, keccak_many
from moraine.operators import chunk, gc, retention
from moraine.operators.index import IndexTables
from moraine.plans.snapshots import Config, Repository, write_files
from moraine.queries import ORACLE_SQL, QUERIES
from moraine.sources import files, formats
from moraine.streaming.incremental import dedup_sink

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def shown(df):
    rows = df[sorted(df.columns)].map(lambda v: "" if v is None or v is pd.NaT or v != v else str(v))
    return sorted(map(tuple, rows.values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE_SQL:
        want = oracle.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and shown(got) == shown(want)
    else:
        assert len(got)


# Digests and ciphers


def test_keccak_is_sha3():
    for n in (0, 1, 71, 72, 135, 136, 300):
        data = bytes(range(256)) * 2
        assert keccak(data[:n], 28) == hashlib.sha3_224(data[:n]).digest() and keccak(data[:n], 64) == hashlib.sha3_512(data[:n]).digest()
    assert keccak(b"", 28).hex() == "6b4e03423667dbb73b6e15454f0eb1abd4597f9a1b078e3f5b5a6bc7"


def test_x25519_vectors():
    """RFC 7748, sections 5.2 and 6.1."""
    k, u = bytes.fromhex("a546e36bf0527c9d3b16154b82465edd62144c0ac1fc5a18506a2244ba449ac4"), bytes.fromhex("e6db6867583030db3594c1a424b15f7c726624ec26b3353b10a903a6d0ab1c4c")
    assert crypto.x25519(k, u).hex() == "c3da55379de9c6908e94ea4df28d084f32eccf03491c71f754b4075577a28552"
    a = bytes.fromhex("77076d0a7318a57d3c16c17251b26645 4c6a4b8f".replace(" ", "").ljust(64, "0")[:64])
    b = crypto.generate_key()
    assert crypto.x25519(a, crypto.public_key(b)) == crypto.x25519(b, crypto.public_key(a))


def test_chacha20_vector():
    """RFC 8439, section 2.3.2: its 96-bit nonce and 32-bit counter as a 64-bit counter and nonce."""
    key, nonce, counter = bytes(range(32)), bytes.fromhex("0000004a00000000"), 1 | 0x09000000 << 32
    assert crypto.chacha20(key, nonce, 64, counter).hex().startswith("10f1e7e4d13b5915500fdd1fa32071c4c7d1f4c733c068030422aa9ac3d46c4e")
    assert crypto.chacha20(key, nonce, 200, 5)[64:128] == crypto.chacha20(key, nonce, 64, 6)


def test_sealed_blobs():
    secret = crypto.generate_key()
    sealer, opener = crypto.Sealer(crypto.public_key(secret)), crypto.Opener(secret)
    for data in (b"", b"x", os.urandom(5000)):
        name, blob = sealer.seal(data)
        assert opener.open(blob, name) == data and len(blob) == len(data) + formats.OBJECT_HEADER
    with pytest.raises(ValueError):
        opener.open(blob[:-1] + b"\0", name)


# Patterns

CASES = [
    ("*.o", "/x/a.o", 1, 1), ("*.o", "/a.o/", 1, 1), ("build/", "/x/build/", 1, 1), ("build/", "/build", 0, 0), ("a/b", "/a/b", 1, 1), ("a/b", "/x/a/b", 0, 0), ("a/**", "/a/", 0, 0), ("a/**", "/a/b/c", 1, 1),
    ("a/**/b", "/a/b", 1, 1), ("a/**/b", "/a/x/y/b", 1, 1), ("/**/foo", "/a/foo", 1, 1), ("**/foo", "/a/foo", 0, 1), ("a?c", "/a/c", 0, 0), ("[!a]x", "/bx", 1, 1), ("[!a]x", "/ax", 0, 0), (r"\.x", "/qx", 1, 0),
    ("f(1)", "/f(1)", None, 1), ("[[:digit:]]z", "/7z", 1, 1), ("[ab", "/[ab", 1, 1), (r"\*", "/*", 1, 1), ("a.b", "/aXb", 0, 0), ("**", "/a/b", 0, 1), ("#x", "/#x", 1, 1),
]


@pytest.mark.parametrize("pattern,path,exact,documented", CASES)
def test_globs(spark, pattern, path, exact, documented):
    one = spark.createDataFrame([(path,)], "path string")
    for mode, want in (("exact", exact), ("documented", documented)):
        if want is not None:
            assert one.select(F.col("path").rlike(globs.combined([pattern], mode))).first()[0] == bool(want), mode


def test_no_patterns_match_nothing(spark):
    assert not spark.createDataFrame([("/",)], "p string").select(F.col("p").rlike(globs.combined(["", ""]))).first()[0]


# Chunks, records, filters


def test_block_sizes(spark):
    size = chunk.content_size(4000)
    rows = [(n, os.urandom(n)) for n in (0, 1, 3999, 4000, size - 1, size, size + 1, 2 * size)]
    found = chunk.blocks(spark.createDataFrame([*rows, (-1, None)], "n int, content binary"), "n", "content", 4000)
    assert {r["n"]: r["count"] for r in found.groupBy("n").count().collect()} == {n: -(-n // size) for n, _ in rows if n}
    assert {r["n"]: bytes(r["content"]) for r in chunk.reassembled(found, "n").collect()} == {n: c for n, c in rows if n}
    with pytest.raises(ValueError):
        chunk.content_size(3999)


def test_blocks_join_in_order(spark):
    rows = [(1, k, bytes([k % 251]) * 100) for k in range(3000)] + [(2, 1, None), (2, 0, b"a"), (3, 0, None)]
    random.Random(1).shuffle(rows)
    got = {r["key"]: (r["n_blocks"], bytes(r["content"])) for r in chunk.reassembled(spark.createDataFrame(rows, "key int, block bigint, data binary").repartition(4), "key").collect()}
    assert got == {1: (3000, b"".join(bytes([k % 251]) * 100 for k in range(3000))), 2: (2, b"a"), 3: (1, b"")}


def test_set_digest(spark):
    mark = lambda rows: spark.createDataFrame([(x,) for x in rows], "line string").repartition(3).agg(hashing.set_digest(F.col("line"))).first()[0]
    assert mark(["a", "b", "b"]) == mark(["b", "a", "b"])
    assert len({mark(x) for x in (["a", "b"], ["a", "b", "b"], ["a", "c"], ["ab"], [])}) == 5


def test_inode_records(spark):
    time = lambda s, n: {"sec": s, "nsec": n}
    rows = [
        (0o100644, 1000, 1, time(1, 5), "idata", b"hello"), (0o100644, 0, 2, time(1, 0), "blocks", os.urandom(56)), (0o40755, 0, 1, time(1, 0), "dents", b"\0 mode x\0"), (0o120777, 0, 1, time(9, 7), "idata", b"target"),
        (0o10644, 0, 1, time(1, 0), None, None), (0o100600, 3, 1, time(2, 2), "idata", b""),
    ]
    df = spark.createDataFrame(rows, "mode int, uid bigint, nlink bigint, mtim struct<sec:bigint,nsec:int>, section string, payload binary")
    made = df.select("*", formats.inode_record(F.col("mode"), F.col("uid"), F.col("uid"), F.col("mtim"), F.col("mtim"), F.col("nlink"), F.col("section"), F.col("payload")).alias("r"))
    first = made.where("uid = 1000").first()["r"]
    assert bytes(first) == b"mode 0100644\0uid 1000\0gid 1000\0mtim 1.000000005\0ctim 1.000000005\0idata\0hello"
    back = made.select(*[c.alias(n) for n, c in formats.inode_fields(F.col("r")).items()]).collect()
    assert [(r["mode"], r["uid"], r["nlink"], r["mtim"].asDict(), r["section"], None if r["payload"] is None else bytes(r["payload"])) for r in back] == rows
    kinds = [r[0] for r in df.select(hashing.file_kind(F.col("mode"))).collect()]
    assert kinds == ["reg", "reg", "dir", "lnk", "fifo", "reg"]


def test_archives():
    import io
    import tarfile

    content = [("objects/abc/" + "ab" * 28, os.urandom(n)) for n in (0, 1, 511, 512, 5000)]
    with tarfile.open(fileobj=io.BytesIO(b"".join(formats.tar_record(*x) for x in content))) as tar:
        assert [(m.name, tar.extractfile(m).read(), m.mode) for m in tar] == [(*x, 0o644) for x in content]


def test_bloom_filters(spark):
    items = [os.urandom(28) for _ in range(300)]
    ids = spark.createDataFrame([(bytearray(x),) for x in items], "id binary")
    head, n = gc.header(), gc.filter_bytes(200)
    live = spark.createDataFrame([(bytearray(x),) for x in items[:200]], "id binary")
    bits = gc.bits(F.col("id"), head, n)
    bloom = gc.build(live, bits)
    hit = {bytes(r["id"]) for r in gc.matching(ids, bits, bloom).collect()}
    assert set(items[:200]) <= hit and len(hit) < 260
    file = gc.packed(bloom, head, n)
    assert len(file) == 32 + n
    has = lambda x: all(file[32 + p // 8] >> p % 8 & 1 for p in gc.positions(x, head, n))
    assert {x for x in items if has(x)} == hit


# Retention, against a loop


def slow_kept(rows, rules):
    last = max(t for _, t, _ in rows)
    keep = {i for i, t, b in rows if b and t > last - timedelta(days=1)}
    day = last.replace(hour=0, minute=0, second=0, microsecond=0)
    back = {
        "days": lambda k: day - timedelta(days=k), "weeks": lambda k: day - timedelta(days=(day.weekday() + 1) % 7 + 7 * k),
        "months": lambda k: day.replace(day=1, year=day.year + (day.month - 1 - k) // 12, month=(day.month - 1 - k) % 12 + 1), "years": lambda k: day.replace(day=1, month=1, year=day.year - k),
    }
    for rule, n in rules.items():
        for k in range(n):
            best = None
            for i, t, b in rows:
                if b and t <= back[rule](k) and (best is None or t > best[1]):
                    best = (i, t)
            if best:
                keep.add(best[0])
    return keep


@pytest.mark.parametrize("seed", range(6))
def test_retention(spark, seed):
    r = random.Random(seed)
    start = datetime(2023, r.choice((1, 12)), r.randint(1, 28))
    rows = [(i, start + timedelta(hours=r.choice((0, 24 * r.randint(-500, 0), r.randint(-2000, 0)))), r.random() < 0.8) for i in range(150)] + [(150, start - timedelta(days=1), True), (151, start, False)]
    df = spark.createDataFrame([(i, t, b, i) for i, t, b in rows], "id int, ts timestamp_ntz, has_bloom boolean, argpos int")
    for rules in (retention.RULES, {}, {"weeks": 9, "years": 2}):
        kept = {x["id"] for x in retention.kept(df, [], rules).collect()}
        assert kept == slow_kept(rows, rules)
        assert {x["id"] for x in retention.culled(df, [], rules).collect()} == {i for i, *_ in rows} - kept


# The repository


def test_backup_restore_prune_cull(spark, tmp_path):
    root = tmp_path / "home"
    (root / "a/deep").mkdir(parents=True)
    big = os.urandom(9000)
    for name, data in {"a/big": big, "a/deep/copy": big, "small": b"hi", "a/skip.tmp": b"no", "a b+c": b"odd name"}.items():
        (root / name).write_bytes(data)
    os.symlink("small", root / "link")
    spark.dataSource.register(files.InodeSource)
    repo = Repository(spark, str(tmp_path / "repo"), Config(label="t", block_size=4000))

    def take(now):
        return repo.backup(spark.read.format("inodes").load(str(root)), files.contents(spark, str(root)), exclude=["*.tmp"], now=now)

    later = max(os.stat(root / n).st_ctime for n in ("a/big", "small")) + 10
    one = take(later)
    assert one["read"] == 4 and repo.objects().count() == 3
    assert repo.backup(spark.read.format("inodes").load(str(root)), files.contents(spark, str(root)), now=later + 1, dry_run=True)["new_objects"] == 0
    two = take(later + 100)
    assert two["read"] == 0 and two["root"] == one["root"] and repo.objects().count() == 3
    assert not repo.abort() and not repo.commit()
    got = repo.restore(two["snapshot"])
    assert {r["path"] for r in got.collect()} == {"/", "/a/", "/a/deep/", "/a/big", "/a/deep/copy", "/small", "/a b+c", "/link"}
    assert write_files(got, str(tmp_path / "out")) == 0
    assert (tmp_path / "out/a/big").read_bytes() == big and (tmp_path / "out/a b+c").read_bytes() == b"odd name" and os.readlink(tmp_path / "out/link") == "small"
    assert repo.prune().count() == 0 and repo.prune(keep=[]).count() == 3 and repo.prune(invert=True).count() == 3
    assert repo.cull({}, invert=True).count() == 2 and repo.cull({}).count() == 0
    with pytest.raises(ValueError):
        take(later)


def test_index_versions(spark, tmp_path):
    index = IndexTables(spark, str(tmp_path / "index"))
    meta = lambda n: {"meta": spark.createDataFrame([(n, 0)], "sec bigint, nsec int")}
    assert index.read("meta").count() == 0 and not index.commit() and not index.abort()
    index.stage(meta(1))
    with pytest.raises(FileExistsError):
        index.stage(meta(2))
    assert index.commit() and index.read("meta").first()["sec"] == 1
    index.stage(meta(3))
    assert index.abort() and index.read("meta").first()["sec"] == 1
    index.stage(meta(4))
    assert index.commit() and index.current() == "v-2" and index.read("meta").first()["sec"] == 4


def test_archive_sink(spark, tmp_path):
    import tarfile

    spark.dataSource.register(files.ArchiveSink)
    rows = [(f"objects/aaa/{k:056x}", os.urandom(k * 100)) for k in range(9)]
    spark.createDataFrame([(n, bytearray(c)) for n, c in rows], "name string, content binary").repartition(3).write.format("objects_tar").mode("append").save(str(tmp_path / "tars"))
    found = {}
    for name in os.listdir(tmp_path / "tars"):
        with tarfile.open(tmp_path / "tars" / name) as tar:
            found |= {m.name: tar.extractfile(m).read() for m in tar}
    assert found == dict(rows)


def test_stream_keeps_each_block_once(spark, tmp_path):
    table, check, inbox = (str(tmp_path / n) for n in ("table", "check", "in"))
    for _ in range(2):
        rows = [(f"/{k}", bytearray(bytes([k % 3]) * 5000)) for k in range(6)]
        spark.createDataFrame(rows, "path string, content binary").write.mode("append").parquet(inbox)
        dedup_sink(spark.readStream.schema("path string, content binary").parquet(inbox), table, check, 4000).awaitTermination()
    found = spark.read.parquet(table)
    assert found.count() == found.select("hash").distinct().count() == 6


def test_command_line(tmp_path, capsys):
    assert cli.main([]) == 0 and cli.main(["init", "-b", "4000", str(tmp_path / "r")]) == 0 and cli.main(["init", str(tmp_path / "r")]) == 1
    assert cli.main(["-C", str(tmp_path), "genkey", "key"]) == 0 and os.stat(tmp_path / "key").st_mode & 0o777 == 0o600
    with pytest.raises(ValueError):
        cli.main(["init", "-b", "10", str(tmp_path / "x")])


def test_names(spark):
    one = spark.createDataFrame([(1704067200, 123)], "sec bigint, nsec int")
    text = one.select(formats.summary_name(F.lit("demo"), F.col("sec"), F.col("nsec"))).first()[0]
    assert text == "demo-2024-01-01T000000.000000123Z.txt"
    assert re.fullmatch(r"objects/abc/abc\w*", one.select(hashing.object_path(F.lit("abcdef"))).first()[0])


def test_sponge_over_batches():
    r = random.Random(1)
    items = [r.randbytes(n) for n in (0, 1, 7, 71, 72, 103, 104, 135, 136, 143, 144, 500, 28, 28)]
    for size, rate in ((28, None), (64, None), (24, 152), (64, 72)):
        assert [x.tobytes() for x in keccak_many(items, size, rate)] == [keccak(x, size, rate) for x in items]
    assert keccak_many([], 28).shape == (0, 28)


def test_sha3_blocks_against_hashlib(spark):
    size = chunk.content_size(4000)
    want = []
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        data = r["text"].encode()
        want += [(r["doc_id"], k, hashlib.sha3_224(b"blk\0" + data[k * size : (k + 1) * size]).hexdigest()) for k in range(-(-len(data) // size))]
    assert sorted(map(tuple, QUERIES["sha3_blocks"](spark, DATA).collect())) == sorted(want)


def test_commit_that_is_interrupted(spark, tmp_path, monkeypatch):
    """Whatever step a commit or a stage stops at, readers see a whole version, and it can be tried again."""
    index = IndexTables(spark, str(tmp_path / "index"))
    meta = lambda n: {"meta": spark.createDataFrame([(n, 0)], "sec bigint, nsec int")}
    index.stage(meta(1))
    index.commit()
    index.stage(meta(2))
    steps = ["exists", "current"]
    for step in steps:
        with monkeypatch.context() as m:
            m.setattr(index, step, lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
            with pytest.raises(KeyboardInterrupt):
                index.commit()
        assert IndexTables(spark, index.path).read("meta").first()["sec"] == 1
    assert index.commit() and IndexTables(spark, index.path).read("meta").first()["sec"] == 2
    os.makedirs(tmp_path / "index/v-pending/meta")
    with pytest.raises(RuntimeError):
        index.commit()
    assert index.read("meta").first()["sec"] == 2 and index.abort() and index.current() == "v-2"


def test_archives_of_two_writes_are_kept_apart(tmp_path, monkeypatch):
    """Task numbers begin anew in each application; archives of an earlier one stay."""
    import tarfile

    import pyspark

    class Task:
        taskAttemptId = staticmethod(lambda: 0)

    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: Task))
    for k in range(2):
        writer = files.ArchiveWriter(str(tmp_path))
        writer.commit([writer.write(iter([{"name": f"objects/{k}", "content": b"x"}]))])
    assert sorted(tarfile.open(tmp_path / n).getnames()[0] for n in os.listdir(tmp_path)) == ["objects/0", "objects/1"]


def test_deep_trees_take_plans_that_grow_with_the_depth(spark, tmp_path):
    """A chain of 40 levels with a leaf on each: staged levels are planned once, and the digests are those of a plain recursion."""
    from moraine.operators import tree

    rows = [(f"d{k}", f"d{k - 1}" if k else None, k, f"n{k}") for k in range(41)] + [(f"l{k}", f"d{k - 1}", k, f"leaf{k}") for k in range(1, 41)]
    nodes, count = spark.createDataFrame(rows, "id string, parent string, depth int, name string"), [0]

    def stage(df):
        count[0] += 1
        df.write.parquet(f"{tmp_path}/{count[0]}")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{count[0]}")

    def scans(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") + df._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation")

    rolled = tree.merkle(nodes, F.col("name"), stage=stage)
    assert count[0] == 41 and scans(rolled) <= 2 * 41
    below = {}
    for i, parent, _, name in sorted(rows, key=lambda r: -r[2]):
        listed = ",".join(f"{n}:{v}" for n, v in sorted(below.pop(i, [])))
        value = hashlib.sha256(f"{name}|{listed}".encode()).hexdigest()
        below.setdefault(parent, []).append((name, value))
    assert rolled.where("depth = 0").first()["value"] == below[None][0][1]
    assert scans(tree.paths(nodes, stage=stage)) <= 2 * 41 and tree.depths(nodes) == 40


def test_marks_and_visits(spark):
    from moraine.operators import tree

    rows = [("/", "dir", 1), ("/a/", "dir", 2), ("/a/x", "reg", 3), ("/b/", "dir", 2), ("/b/x", "reg", 3), ("/b/c/", "dir", 4), ("/c", "reg", 2), ("/d/", "dir", None), ("/e/", "dir", None)]
    kept, skipped = tree.visited_once(spark.createDataFrame(rows, "path string, kind string, ino int"), ["ino"])
    assert {r["path"] for r in kept.collect()} == {"/", "/a/", "/a/x", "/c", "/d/", "/e/"} and [r["path"] for r in skipped.collect()] == ["/b/"]
    gone = spark.createDataFrame([(1, "p"), (2, "q"), (3, None), (1, "p")], "ino int, parent string")
    assert [r["id"] for r in tree.marked_parents(gone, spark.createDataFrame([(1,), (3,)], "ino int"), ["ino"]).collect()] == ["p"]


@pytest.fixture
def home(spark, tmp_path):
    """A tree with hard links, modes and a directory without entries; and a function that takes snapshots of it."""
    spark.dataSource.register(files.InodeSource)
    root = tmp_path / "home"
    (root / "a/deep").mkdir(parents=True)
    (root / "empty").mkdir()
    (root / "a/big").write_bytes(os.urandom(9000))
    (root / "a/small").write_bytes(b"hi")
    (root / "a/deep/other").write_bytes(os.urandom(5000))
    os.link(root / "a/big", root / "z-big")
    os.link(root / "a/small", root / "a/deep/small too")
    os.chmod(root / "a/big", 0o640)
    os.chmod(root / "a/deep", 0o710)
    os.utime(root / "a/deep", ns=(10**18, 10**18 + 123_000))
    repo, clock = Repository(spark, str(tmp_path / "repo"), Config(label="t", block_size=4000)), [os.stat(root / "a/big").st_ctime + 100]

    def take(contents=None, **more):
        clock[0] += 10
        return repo.backup(spark.read.format("inodes").load(str(root)), contents if contents is not None else files.contents(spark, str(root)), now=clock[0], **more)

    return root, repo, take


def test_hard_links_and_modes_come_back(home, tmp_path):
    root, repo, take = home
    one = take()
    assert one["read"] == 3 and one["errors"] == 0 and repo.objects().count() == 5
    restored = repo.restore(one["snapshot"])
    assert {r["path"]: r["first"] for r in restored.where("is_link").collect()} == {"/z-big": "/a/big", "/a/small": "/a/deep/small too"}
    assert restored.where("is_link and content is not null").count() == 0
    out = tmp_path / "out"
    assert write_files(restored, str(out)) == 0
    assert os.stat(out / "a/big").st_ino == os.stat(out / "z-big").st_ino and os.stat(out / "a/big").st_nlink == 2
    assert (out / "z-big").read_bytes() == (root / "z-big").read_bytes() and (out / "a/small").read_bytes() == b"hi" and (out / "empty").is_dir()
    assert os.stat(out / "a/big").st_mode & 0o777 == 0o640 and os.stat(out / "a/deep").st_mode & 0o777 == 0o710 and os.stat(out / "a/deep").st_mtime_ns == 10**18 + 123_000


def test_renamed_files_are_not_read_again_and_trees_are_shared(home):
    root, repo, take = home
    one, two = take(), take()
    assert two["read"] == 0 and two["root"] == one["root"] and two["new_trees"] == 0 and one["new_trees"] == 4
    os.rename(root / "a/big", root / "a/renamed")
    later = take()
    # A rename changes the inode's ctime, which lies before these made-up times, so the file counts as unchanged.
    assert later["read"] == 0 and later["root"] != one["root"] and later["new_trees"] == 2
    assert {r["path"] for r in repo.nodes(later["snapshot"]).where("kind = 'reg'").collect()} == {"/a/renamed", "/z-big", "/a/small", "/a/deep/small too", "/a/deep/other"}
    from moraine.sources.formats import dents_entries

    trees = {r["id"]: [e["name"] for e in r["e"]] for r in repo._table("trees", "id string, dents binary").select("id", dents_entries(F.col("dents"), 32).alias("e")).collect()}
    assert trees[later["root"]] == ["a", "empty", "z-big"] and trees[one["root"]] == ["a", "empty", "z-big"] and len(trees) == 6


def test_files_that_vanish_are_errors(home, spark):
    root, repo, take = home
    seen = files.contents(spark, str(root)).where("path not like '%other'")
    one = take(seen)
    assert one["errors"] == 1 and repo.nodes(one["snapshot"]).where("path like '%other'").count() == 0
    assert [r["path"] for r in repo._table(f"errors/snapshot={one['snapshot']}", "path string, error string").collect()] == ["/a/deep/other"]
    assert repo.restore(one["snapshot"]).where("not is_intact").count() == 0


def test_contents_are_read_once(home, spark):
    """Blocks and lists come from one pass: contents that differ each time they are read still give a snapshot that is whole."""
    root, repo, take = home
    noise = F.udf(lambda path: bytearray(os.urandom(9000)), "binary").asNondeterministic()
    one = take(files.contents(spark, str(root)).select("path", noise("path").alias("content")))
    assert repo.restore(one["snapshot"]).where("not is_intact").count() == 0 and not os.listdir(f"{repo.path}/work")


def test_filters_and_summaries(home):
    root, repo, take = home
    one = take()
    (root / "a/deep/other").write_bytes(os.urandom(6000))
    os.utime(root / "a/deep/other", ns=(4 * 10**18, 4 * 10**18))
    two = take()
    exact, filtered = ({r["id"] for r in repo.prune([two["snapshot"]], filters=f).collect()} for f in (False, True))
    assert len(exact) == 2 and filtered <= exact
    assert repo.prune(filters=True).count() == 0 and repo.prune(invert=True, filters=True).count() == repo.objects().count()
    assert repo.stale_filters([two["snapshot"]]) == [one["snapshot"]] and repo.stale_filters([]) == sorted([one["snapshot"], two["snapshot"]])
    texts = {n: open(f"{repo.path}/{n}").read() for n in os.listdir(repo.path) if n.endswith("Z.txt")}
    assert len(texts) == 2 and all(t.startswith("timestamp ") and "label t\nroot " in t and "\nbloom " in t for t in texts.values())
    found = formats.read_summaries(repo.spark, [f"{repo.path}/{n}" for n in sorted(texts)]).orderBy("argpos").collect()
    assert [r["root"] for r in found] == [one["root"], two["root"]]


def test_devices(home, spark, tmp_path):
    root, repo, take = home
    (tmp_path / "devices").mkdir()
    os.symlink(root, tmp_path / "devices/home")
    os.symlink(tmp_path / "nowhere", tmp_path / "devices/gone")
    found = files.devices(spark, str(tmp_path / "devices"))
    assert [(r["dev"], r["label"]) for r in found.collect()] == [(os.stat(root).st_dev, "home")]
    one = take(devices=found)
    assert {r["dev_label"] for r in repo.nodes(one["snapshot"]).collect()} == {"home"}
    (tmp_path / "devices/a-name-that-is-too-long").mkdir()
    with pytest.raises(ValueError):
        files.devices(spark, str(tmp_path / "devices"))
    assert files.devices(spark, str(tmp_path / "none")).count() == 0


def test_dents(spark):
    one = spark.createDataFrame([("b", "ab" * 28), ("aé x", "00" * 28)], "name string, value string").agg(formats.dents(F.col("name"), F.col("value")).alias("p"))
    payload = bytes(one.first()["p"])
    assert payload == bytes(28) + "aé x".encode() + b"\0" + b"\xab" * 28 + b"b\0"
    rows = spark.createDataFrame([(bytearray(payload),), (bytearray(payload[:-1]),), (bytearray(),), (bytearray(payload[:28] + b"\0"),)], "p binary").select(formats.dents_entries(F.col("p")).alias("e")).collect()
    assert [(e["id"], e["name"]) for e in rows[0]["e"]] == [("00" * 28, "aé x"), ("ab" * 28, "b")] and [r["e"] for r in rows[1:]] == [None, [], None]


def test_sealed_repository(home, spark):
    root, plain, _ = home
    secret = crypto.generate_key()
    repo = Repository(spark, plain.path + "-sealed", Config(label="s", block_size=4000, recipient=crypto.public_key(secret).hex()))
    now = os.stat(root / "a/big").st_ctime + 100
    one = repo.backup(spark.read.format("inodes").load(str(root)), files.contents(spark, str(root)), now=now)
    stored = repo.objects().collect()
    big = (root / "a/big").read_bytes()
    assert len(stored) == 5 and all(hashlib.sha3_224(r["content"]).hexdigest() == r["blob_id"] != r["id"] for r in stored) and not any(big[:64] in bytes(r["content"]) for r in stored)
    got = {r["path"]: bytes(r["content"] or b"") for r in repo.restore(one["snapshot"], secret).where("is_intact").collect()}
    assert got["/a/big"] == big
    inline = [bytes(r["inline"]) for r in repo.nodes(one["snapshot"]).where("inline is not null").collect()]
    assert got["/a/deep/small too"] == b"hi" and len(inline) == 2 and all(b"hi" not in x or len(x) == 42 for x in inline) and {len(x) for x in inline} == {42}
    # With another key both files of blocks and both paths of the small one come out damaged.
    assert repo.restore(one["snapshot"], crypto.generate_key()).where("not is_intact and not is_link").count() == 3
    with pytest.raises(ValueError):
        repo.restore(one["snapshot"])
    two = repo.backup(spark.read.format("inodes").load(str(root)), files.contents(spark, str(root)), now=now + 5)
    assert two["read"] == 0 and two["root"] == one["root"] and repo.objects().count() == 5
    assert {r["blob_id"] for r in stored} == {bytes(r["blob_id"]).hex() for r in repo.index.read("blocks").collect()}


def test_commands_end_to_end(home, tmp_path, capsys):
    root, _, _ = home
    repo, out = str(tmp_path / "r"), str(tmp_path / "restored")
    run = lambda *a: cli.main(list(map(str, a)))
    assert run("genkey", tmp_path / "key") == 0
    (tmp_path / "pub").write_bytes(crypto.public_key((tmp_path / "key").read_bytes()))
    assert run("init", "-b", 4000, "-l", "cli", "-p", tmp_path / "pub", repo) == 0
    os.symlink(root, f"{repo}/devices/home")
    capsys.readouterr()
    assert run("backup", "-v", repo, root) == 0
    lines = capsys.readouterr().out.splitlines()
    import json

    done = json.loads(lines[-1])
    assert "/a/big" in lines and done["errors"] == 0
    assert run("restore", "-k", tmp_path / "key", "-S", "-d", out, repo, done["snapshot"]) == 0
    assert open(f"{out}/z-big", "rb").read() == (root / "a/big").read_bytes() and os.stat(f"{out}/z-big").st_nlink == 2
    (tmp_path / "other").write_bytes(crypto.generate_key())
    assert run("restore", "-k", tmp_path / "other", "-S", "-d", out + "2", repo, done["snapshot"]) == 1 and not os.path.exists(out + "2")
    capsys.readouterr()
    assert run("prune", "-f", "-s", done["snapshot"], repo) == 0 and capsys.readouterr().out == ""
    (tmp_path / "patterns").write_text("deep/\nz-*\n\n")
    assert run("backup", "-v", "--pending", "-e", tmp_path / "patterns", repo, root) == 0
    lines = capsys.readouterr().out.splitlines()
    assert "/a/big" in lines and not [x for x in lines[:-1] if "deep" in x or x.startswith("/z-")]
    assert run("commit", repo) == 0 and run("restore", "-n", repo, json.loads(lines[-1])["snapshot"]) == 0
    assert run("cull", "-v", repo) == 0 and len(capsys.readouterr().out.splitlines()) > 2


def test_gaps_and_missing_blocks(spark):
    from moraine.operators import diff, index

    deps = spark.createDataFrame([(1, 0), (1, 1), (1, 3), (2, 0), (3, 1), (4, 0), (4, 1), (4, 2)], "ino int, block int")
    assert sorted(map(tuple, diff.until_gap(deps, ["ino"], "block").collect())) == [(1, 0), (1, 1), (2, 0), (4, 0), (4, 1), (4, 2)]
    marked = deps.withColumn("is_missing", F.col("ino") == 3)
    with pytest.raises(Exception, match="not in the index"):
        diff.require_no_missing(marked).collect()
    assert diff.require_no_missing(marked.where("ino < 3")).count() == 4
    assert index.lookup(deps, F.col("block") == 3).collect() == [(1, 3)]


def test_object_listing(spark, tmp_path):
    name = "ab" * 28
    for at in (f"objects/aba/{name}", f"objects/abb/{name.upper()}.x", "objects/abc/notes"):
        os.makedirs(os.path.dirname(tmp_path / at), exist_ok=True)
        (tmp_path / at).write_bytes(b"12345")
    found = files.listing(spark, str(tmp_path)).collect()
    assert {r["length"] for r in found} == {5} and len(found) == 2 and found[0]["id"].startswith(name)
    shown = spark.createDataFrame([(name,), (name[:-1],), ("notes",), (None,)], "n string").select(hashing.is_object_name(F.col("n")).alias("ok")).collect()
    assert [r["ok"] for r in shown] == [True, False, False, None]


def test_ordered_hard_links(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "ino int, path string")
    assert {tuple(r) for r in chunk.ordered_hardlinks(df, ["ino"], "path").select("path", "rank").collect()} == {("a", 1), ("b", 2), ("c", 1)}
