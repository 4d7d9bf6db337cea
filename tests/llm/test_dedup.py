"""SimHash, exact and line de-duplication against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from moraine.llm import exact, graph, lines, simhash

WHITE = re.compile(r"[\x20\x09-\x0D]")


def slow_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def slow_components(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


@pytest.mark.parametrize("text", [None, "", " \t", "One", "one TWO three", "a b c d e f a b c d", "É é Word word", "x " * 50_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_trees_find_what_a_scan_finds():
    r = random.Random(2)
    keys = {r.getrandbits(64) for _ in range(300)}
    for k in list(keys)[:60]:
        for _ in range(4):
            for b in r.sample(range(64), r.randint(1, 6)):
                k ^= 1 << b
            keys.add(k)
    keys = np.array(sorted(keys), np.uint64)
    forest = simhash.BKForest(keys, np.zeros(len(keys), np.int64))
    found = {(a, b) for q, n in forest.search(keys, forest.root_of, 4) for a, b in zip(q.tolist(), n.tolist())}
    near = np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 4
    assert found == set(zip(*map(np.ndarray.tolist, np.nonzero(near))))


@pytest.mark.parametrize("shard_keys", [simhash.SHARD_KEYS, 3])
def test_near_duplicates(odd, shard_keys):
    """Small shards are cut into parts whose trees go to the others; the components stay the same."""
    docs = odd.collect()
    got = simhash.near_duplicates(odd, shard_keys=shard_keys).collect()
    fps = {slow_fingerprint(r["text"]) for r in docs}
    label = slow_components(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])
    ids = defaultdict(list)
    for r in docs:
        if r["doc_id"] is not None:
            ids[label[slow_fingerprint(r["text"])]].append(r["doc_id"])
    want = sorted((str(r["doc_id"]), f"{(f := slow_fingerprint(r['text'])):016x}", min(ids[label[f]], default=None)) for r in docs)
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == want
    assert len(got) == len(docs)


def test_large_shard_of_near_copies(spark):
    """A hot shard: thousands of fingerprints around one centre, cut into parts."""
    r = random.Random(9)
    keys = {0x123456789ABCDEF0 ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for _ in range(3000)}
    signed = [(k - (1 << 64) if k >> 63 else k,) for k in keys]
    found = simhash.links(spark.createDataFrame(signed, "fp bigint"), shard_keys=500)
    assert found.count() < 5 * 12 * len(keys)
    roots = graph.components(found)
    assert roots.count() == len(keys) and roots.select("root").distinct().count() == 1


def test_large_shards_are_routed_finer(spark):
    """Spread keys with planted links: every shard is too large, and finer ones, some of them crowded, lose no link."""
    r = random.Random(12)
    keys = [r.getrandbits(64) for _ in range(1500)]
    keys += [k ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))) for k in keys[:500]]
    keys += [(0x2AB << 54 | r.getrandbits(54)) for _ in range(60)] + [keys[0] ^ sum(1 << b for b in r.sample(range(64), 2)) for _ in range(80)]
    keys = sorted(set(keys))
    signed = [(k - (1 << 64) if k >> 63 else k,) for k in keys]
    array = np.array(keys, np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(array[:, None] ^ array[None, :]) <= 4, 1))
    want = slow_components(range(len(keys)), list(zip(a.tolist(), b.tolist())))
    groups = lambda label: {frozenset(m) for m in label if len(m) > 1}
    expected = defaultdict(set)
    for k, root in want.items():
        expected[root].add(signed[k][0])
    for shard_keys in (1, 8):
        roots = graph.components(simhash.links(spark.createDataFrame(signed, "fp bigint"), shard_keys=shard_keys)).collect()
        got = defaultdict(set)
        for x in roots:
            got[x["root"]].add(x["node"])
        assert groups(got.values()) == groups(expected.values())


def test_blocks_make_up_the_bits():
    assert sorted(b for block in simhash.blocks(list(range(7, 64)), 4) for b in block) == list(range(7, 64))


def test_representatives(odd, none):
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 2
    assert simhash.representatives(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def test_one_row_of_each_component(odd, none):
    docs = odd.collect()
    fps = {slow_fingerprint(r["text"]) for r in docs}
    label = slow_components(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for r in docs:
        root = label[slow_fingerprint(r["text"])]
        least[root] = min(least.get(root, (True, 0)), (r["doc_id"] is None, r["doc_id"] or 0))
    kept = simhash.representatives(odd, exactly_one=True)
    got = kept.collect()
    assert kept.columns == odd.columns and sorted((label[slow_fingerprint(r["text"])], r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((k, *v) for k, v in least.items())
    assert simhash.representatives(none, exactly_one=True).count() == 0


def test_components_of_chains_and_hubs(spark):
    pairs = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(5, 5), (None, 3), (7, 200)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 7 for k in [7, *range(200, 260)]}


def slow_exact(docs):
    groups = defaultdict(list)
    for k, r in enumerate(docs):
        groups[WHITE.sub("", r["text"] or "")].append((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0, k))
    return {norm: (docs[min(rows)[3]]["doc_id"], len(rows)) for norm, rows in groups.items()}


@pytest.mark.parametrize("bucket_keys", [exact.BUCKET_KEYS, 2])
def test_exact_duplicates(odd, bucket_keys):
    docs = odd.collect()
    want = slow_exact(docs)
    got = exact.exact_duplicates(odd, bucket_keys).collect()
    shown = lambda i, keep, n, sha: (str(i), str(keep), n, sha)
    expected = [shown(r["doc_id"], *want[norm], hashlib.sha256(norm.encode()).hexdigest()) for r in docs for norm in [WHITE.sub("", r["text"] or "")]]
    assert sorted(shown(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == sorted(expected)
    assert sum(r["kept"] for r in got) == len(want)


def test_directory_doubles_until_buckets_fit(odd):
    keys = exact.entries(odd).groupBy("key", "sha").count().drop("count")
    cells, bits = exact.directory(keys, 2)
    held = keys.withColumn("cell", exact.cell(bits)).join(cells, "cell").groupBy("depth", "bucket").count()
    assert bits > 0 and held.agg({"count": "max"}).first()[0] <= 2 and keys.count() == held.agg({"count": "sum"}).first()[0]


def test_bytes_are_compared_by_shuffle_too(odd):
    found = exact.build_index(exact.entries(odd))
    one, other = (sorted(map(tuple, exact.compared(odd, found, limit).collect())) for limit in (exact.BROADCAST_BYTES, 0))
    assert one == other and all(n == 1 for *_, n in one)


@pytest.mark.parametrize("digests", [True, False])
@pytest.mark.parametrize("keys", [1, 3])
def test_texts_that_share_key_and_digest_stay_apart(odd, monkeypatch, keys, digests):
    """All texts fall into one or a few keys, and share their digest too: only their bytes tell them apart."""
    from pyspark.sql import functions as F

    if not digests:
        monkeypatch.setattr(exact, "digest", lambda norm: F.unhex(F.sha2(F.substring(norm, 1, 0), 256)))
    docs = odd.collect()
    want = slow_exact(docs)
    for limit in (exact.BROADCAST_BYTES, 0):
        got = exact.exact_duplicates(odd, 2, limit, lambda norm: F.pmod(F.xxhash64(norm), F.lit(keys)) - 1).collect()
        shown = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in got)
        assert shown == sorted((str(r["doc_id"]), str(want[norm][0]), want[norm][1]) for r in docs for norm in [WHITE.sub("", r["text"] or "")])
        assert sum(r["kept"] for r in got) == len(want)


def test_directory_points_every_key_to_one_bucket(spark):
    """Skewed keys: most share their leading bits, so their buckets are deeper than the others, to which several cells point."""
    r = random.Random(7)
    keys = {r.getrandbits(64) for _ in range(40)} | {0x1F << 59 | r.getrandbits(59) for _ in range(60)}
    df = spark.createDataFrame([(k - (1 << 64) if k >> 63 else k,) for k in sorted(keys)], "key bigint")
    cells, bits = exact.directory(df, 5)
    rows = {c["cell"]: (c["depth"], c["bucket"]) for c in cells.collect()}
    assert sorted(rows) == list(range(1 << bits)) and all(c >> bits - d == b for c, (d, b) in rows.items())
    held = defaultdict(int)
    for k in keys:
        held[rows[k >> 64 - bits]] += 1
    assert max(held.values()) <= 5 and sum(held.values()) == len(keys)
    # A bucket is split only if it is overfull, so the parent of a bucket holds more than fits.
    assert all(sum(k >> 65 - d == b >> 1 for k in keys) > 5 for d, b in rows.values() if d)


def test_deduplicated(odd, none):
    docs, kept = odd.collect(), exact.deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == len(slow_exact(docs))
    assert exact.deduplicated(none).count() == 0


def slow_lines(docs):
    docs = sorted(enumerate(docs), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0]))
    seen, out = set(), []
    for _, (doc_id, text) in docs:
        every = (text or "").split("\n")
        solid = [k for k, line in enumerate(every) if WHITE.sub("", line)]
        gone = set()
        for i in range(len(solid) - 2):
            w = tuple(every[k] for k in solid[i : i + 3])
            if w in seen:
                gone.update(solid[i : i + 3])
            seen.add(w)
        out.append((str(doc_id), "\n".join(line for k, line in enumerate(every) if k not in gone) if gone else text or "", len(every), len(gone)))
    return sorted(out)


def test_lines(spark, odd, none, tmp_path):
    r = random.Random(4)
    rows = [(k, "\n".join(r.choice(["a", "b", "", " ", "c d", "e"]) for _ in range(r.randint(0, 14)))) for k in range(60)]
    rows += [(60, None), (61, ""), (62, "a\nb\nc\n" * 300), (63, "only\ntwo"), (64, "p\nq\nr"), (64, "p\nq\nr"), (None, "p\nq\nr\ns"), (65, "\r\np\n\nq\nr\n")]
    spark.createDataFrame([(*x, 1) for x in rows], "doc_id bigint, text string, lines int").coalesce(1).write.parquet(f"{tmp_path}/lines")
    docs = spark.read.parquet(f"{tmp_path}/lines")
    got = [(str(x["doc_id"]), x["clean_text"], x["n_lines"], x["n_removed"]) for x in lines.deduplicated(docs).collect()]
    assert sorted(got) == slow_lines([(x["doc_id"], x["text"]) for x in docs.collect()])
    assert lines.deduplicated(odd).count() == odd.count() and lines.deduplicated(none).count() == 0


def test_lines_of_files_that_are_split_otherwise_later(spark, tmp_path, monkeypatch):
    same = "\n".join(f"same {k}" for k in range(4))
    rows = [(k, f"own {k} a\nown {k} b\n{same}" if k % 2 else "\n".join(f"own {k} {n}" for n in range(6))) for k in range(24)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6).write.parquet(f"{tmp_path}/lines")
    docs, first, staged = spark.read.parquet(f"{tmp_path}/lines"), {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}, lines.staged

    def split_otherwise(df, *more):
        out = staged(df, *more)
        for key in first:
            spark.conf.unset(key)
        return out

    monkeypatch.setattr(lines, "staged", split_otherwise)
    try:
        for key, value in first.items():
            spark.conf.set(key, value)
        got = [(str(x["doc_id"]), x["clean_text"], x["n_lines"], x["n_removed"]) for x in lines.deduplicated(docs).collect()]
    finally:
        for key in first:
            spark.conf.unset(key)
    assert sorted(got) == slow_lines(rows)


def test_rounds_leave_one_table(spark, tmp_path, monkeypatch):
    import os

    from moraine.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    found = graph.components(spark.createDataFrame([(k, k + 1) for k in range(40)], "a bigint, b bigint"))
    (application,) = os.listdir(tmp_path / "moraine")
    assert len(os.listdir(tmp_path / "moraine" / application)) == 1 and found.count() == 41


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from moraine.llm import common

    class Context:
        master = "spark://far:7077"

        def getConf(self):
            return {}

        class _jsc:
            class sc:
                def getCheckpointDir(self):
                    return self

                def isDefined(self):
                    return False

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
