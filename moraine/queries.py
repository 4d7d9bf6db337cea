"""Queries that apply the operators to the test tables, and the DuckDB SQL that gives the same rows.

A row of documents stands for a file (/source/lang/doc_id.txt, content text), events for snapshots labelled by
their type, orders and lineitem for inodes and their dependencies, and region, nation, customer and orders for a
directory tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import globs
from moraine.functions.hashing import file_kind, from_octal, hexed, object_path, octal
from moraine.operators import chunk, diff, gc, index, retention, tree
from moraine.sources import formats

#: A block size small enough that documents have several blocks, and its content bytes.
BLOCK = 4000
SIZE = BLOCK - chunk.RESERVED
SINCE = "1998-01-01"
PATTERNS = ["*.tmp", "src1/", "/src2/**", "en/*7.txt", "**/de/?.txt", "[!s]rc*", "/src3/e[ns]/"]

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select("doc_id", "lang", "source", path.alias("path"), F.encode("text", "UTF-8").alias("content"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.hashed(chunk.blocks(_files(spark, sf_dir), "doc_id", "content", BLOCK, ["lang", "source"])).withColumn("hash", hexed(F.col("hash")))


#: Blocks of all documents, as the SQL side has them.
_BLOCKS = rf"""
    b AS (SELECT doc_id, lang, source, i AS block, array_slice(c, i * {SIZE} + 1, least((i + 1) * {SIZE}, octet_length(c))) AS data
          FROM (SELECT doc_id, lang, source, c, unnest(range(0, (octet_length(c) + {SIZE - 1}) // {SIZE})) AS i FROM (SELECT *, encode(text) AS c FROM documents))),
    h AS (SELECT doc_id, lang, source, block, octet_length(data) AS n_bytes, sha256('blk\x00'::BLOB || data) AS hash FROM b)"""

# Chunking and de-duplication


@query(f"WITH {_BLOCKS} SELECT doc_id, block, n_bytes FROM h")
def chunk_blocks(spark, sf_dir):
    return chunk.blocks(_files(spark, sf_dir), "doc_id", "content", BLOCK).select("doc_id", "block", F.octet_length("data").cast("bigint").alias("n_bytes"))


@query(f"WITH {_BLOCKS} SELECT doc_id, block, hash FROM h")
def chunk_hash(spark, sf_dir):
    return _hashed(spark, sf_dir).select("doc_id", "block", "hash")


@query("SELECT lang, octet_length(encode(text)) < 4000 AS is_inline, count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY ALL")
def inline_split(spark, sf_dir):
    size = F.octet_length("content").cast("bigint")
    return _files(spark, sf_dir).groupBy("lang", chunk.is_inline(size).alias("is_inline")).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))


@query(f"""WITH {_BLOCKS} SELECT hash, n_bytes, count(*) AS copies, CAST(n_bytes * (count(*) - 1) AS BIGINT) AS saved_bytes, min((doc_id, block))[1] AS first_doc_id, min((doc_id, block))[2] AS first_block
           FROM h GROUP BY hash, n_bytes""")
def block_dedup(spark, sf_dir):
    found = chunk.distinct_blocks(_hashed(spark, sf_dir), ["doc_id", "block"])
    return found.withColumn("saved_bytes", F.col("n_bytes") * (F.col("copies") - 1))


@query(f"""WITH {_BLOCKS} SELECT hash, n_bytes, count(*) AS copies, min((doc_id, block))[1] AS first_doc_id, min((doc_id, block))[2] AS first_block,
           hash NOT IN (SELECT hash FROM h WHERE doc_id % 3 = 0) AS is_new FROM h GROUP BY hash, n_bytes""")
def dedup_two_level(spark, sf_dir):
    now = _hashed(spark, sf_dir)
    return chunk.two_level(chunk.distinct_blocks(now, ["doc_id", "block"]), now.where("doc_id % 3 = 0"))


@query(f"WITH {_BLOCKS} SELECT count(*) AS blocks, CAST(sum(n_bytes) AS BIGINT) AS bytes FROM (SELECT DISTINCT hash, n_bytes FROM h WHERE hash NOT IN (SELECT hash FROM h WHERE doc_id % 3 = 0))")
def emitted_blocks(spark, sf_dir):
    now = _hashed(spark, sf_dir)
    return chunk.emitted(chunk.distinct_blocks(now, ["doc_id"]), now.where("doc_id % 3 = 0")).agg(F.count("*").alias("blocks"), F.sum("n_bytes").alias("bytes"))


@query(f"""WITH {_BLOCKS}, u AS (SELECT source, hash, n_bytes, count(*) AS n FROM h GROUP BY ALL)
           SELECT source, CAST(sum(n * n_bytes) AS BIGINT) AS logical_bytes, CAST(sum(n_bytes) AS BIGINT) AS stored_bytes FROM u GROUP BY source""")
def dedup_ratio(spark, sf_dir):
    unique = _hashed(spark, sf_dir).groupBy("source", "hash", "n_bytes").agg(F.count("*").alias("n"))
    return unique.groupBy("source").agg(F.sum(F.col("n") * F.col("n_bytes")).alias("logical_bytes"), F.sum("n_bytes").alias("stored_bytes"))


@query(f"WITH {_BLOCKS} SELECT d.doc_id, (SELECT count(*) FROM h WHERE h.doc_id = d.doc_id) AS n_blocks, sha256(encode(d.text)) AS sha256 FROM documents d WHERE octet_length(encode(d.text)) > 0")
def reassemble(spark, sf_dir):
    whole = chunk.reassembled(chunk.blocks(_files(spark, sf_dir), "doc_id", "content", BLOCK), "doc_id")
    return whole.select("doc_id", "n_blocks", F.sha2("content", 256).alias("sha256"))


@query("SELECT doc_id, first_doc_id, doc_id <> first_doc_id AS is_link FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_doc_id FROM documents)")
def hardlinks(spark, sf_dir):
    files = _files(spark, sf_dir).select("doc_id", F.sha2("content", 256).alias("identity"))
    return chunk.hardlinks(files, ["identity"], "doc_id").select("doc_id", F.col("first").alias("first_doc_id"), "is_link")


# Change detection


def _inodes(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("mtim"), F.expr("o_orderdate + make_interval(0, 0, 0, CAST(o_custkey % 400 AS INT), 0, 0, 0)").alias("ctim"))


_INODES = "i AS (SELECT o_orderkey, o_orderdate AS mtim, o_orderdate + to_days(CAST(o_custkey % 400 AS INTEGER)) AS ctim FROM orders)"
_REUSE = f"r AS (SELECT o_orderkey, o_orderkey % 5 <> 0 AND NOT (mtim > TIMESTAMP '{SINCE}' OR ctim > TIMESTAMP '{SINCE}') AS reuse FROM i)"


def _classified(spark, sf_dir):
    now = _inodes(spark, sf_dir)
    before = now.where("o_orderkey % 5 <> 0").select("o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("blob_id"))
    return diff.classified(now, before, ["o_orderkey"], F.lit(SINCE).cast("timestamp_ntz"))


@query(f"WITH {_INODES}, {_REUSE} SELECT o_orderkey, reuse, CASE WHEN reuse THEN sha256(CAST(o_orderkey AS VARCHAR)) END AS blob_id FROM r")
def changed_inodes(spark, sf_dir):
    return _classified(spark, sf_dir).select("o_orderkey", "reuse", "blob_id")


@query(f"""WITH {_INODES}, {_REUSE} SELECT l_orderkey AS o_orderkey, l_linenumber AS block, l_partkey, l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) AS is_missing
           FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM r WHERE reuse)""")
def carry_forward(spark, sf_dir):
    unchanged = _classified(spark, sf_dir).where("reuse")
    deps = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("block"), "l_partkey")
    known = _table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    return diff.carried(unchanged, deps, known, ["o_orderkey"], "l_partkey").select("o_orderkey", "block", "l_partkey", "is_missing")


@query("""WITH d AS (SELECT l_orderkey, l_linenumber - 1 AS block, l_partkey FROM lineitem WHERE l_partkey % 10 <> 0)
          SELECT * FROM d WHERE block = (SELECT count(DISTINCT e.block) FROM d e WHERE e.l_orderkey = d.l_orderkey AND e.block < d.block)""")
def deps_until_gap(spark, sf_dir):
    deps = _table(spark, sf_dir, "lineitem").where("l_partkey % 10 <> 0").select("l_orderkey", (F.col("l_linenumber") - 1).alias("block"), "l_partkey")
    return diff.until_gap(deps, ["l_orderkey"], "block")


def _paths(spark, sf_dir, way: str):
    """Orders as files on devices (the priority), two paths of which are of one inode; way is part of their paths."""
    o = _table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderpriority").alias("dev"), F.expr("o_orderkey div 2").alias("ino"), F.concat(F.lit(f"/{way}/"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("path"), F.col("o_orderdate").alias("mtim"), F.col("o_orderdate").alias("ctim"),
        F.sha2(F.concat("o_orderpriority", F.lit(":"), F.expr("o_orderkey div 2").cast("string")), 256).alias("digest"),
    )


_PATHS = """f AS (SELECT o_orderpriority AS dev, o_orderkey // 2 AS ino, o_orderkey AS k, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS name, o_orderdate AS t,
               sha256(o_orderpriority || ':' || (o_orderkey // 2)) AS digest FROM orders)"""


@query(f"""WITH {_PATHS}, old AS (SELECT DISTINCT dev, ino, digest FROM f WHERE k % 5 <> 0)
          SELECT '/renamed/' || name AS path, old.ino IS NOT NULL AND t <= TIMESTAMP '{SINCE}' AS reuse, CASE WHEN old.ino IS NOT NULL AND t <= TIMESTAMP '{SINCE}' THEN old.digest END AS digest FROM f LEFT JOIN old USING (dev, ino)""")
def inode_reuse(spark, sf_dir):
    """Every file was renamed; those that the last snapshot held and that did not change are not read again."""
    before = _paths(spark, sf_dir, "first").where("substr(path, 8) % 5 <> 0")
    now = _paths(spark, sf_dir, "renamed").drop("digest")
    return diff.reused(now, before.select("dev", "ino", "digest"), F.lit(SINCE).cast("timestamp_ntz"), ["digest"]).select("path", "reuse", "digest")


@query(f"WITH {_PATHS} SELECT '/p/' || name AS path, '/p/' || min(name) OVER w AS first, row_number() OVER (PARTITION BY dev, ino ORDER BY name) > 1 AS is_link, row_number() OVER (PARTITION BY dev, ino ORDER BY name) AS rank FROM f WINDOW w AS (PARTITION BY dev, ino)")
def restore_links(spark, sf_dir):
    """Which of a file's paths is created and which are linked to it, in the order of restoring."""
    found = chunk.hardlinks(_paths(spark, sf_dir, "p"), ["dev", "ino"], "path")
    return chunk.ordered_hardlinks(found, ["dev", "ino"], "path").select("path", "first", "is_link", "rank")


@query("""SELECT n_nationkey, rank() OVER (PARTITION BY n_nationkey ORDER BY c_name) - 1 AS place, sha256(CAST(c_custkey AS VARCHAR)) AS id, c_name AS name
          FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def dents_parse(spark, sf_dir):
    """Listings of directories (nations) with their entries (customers), written as records and read back."""
    rows = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("int").alias("n_nationkey"), F.col("c_name").alias("name"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("value"))
    made = rows.groupBy("n_nationkey").agg(formats.dents(F.col("name"), F.col("value")).alias("dents"))
    return made.select("n_nationkey", F.posexplode(formats.dents_entries(F.col("dents"), 32)).alias("place", "e")).select("n_nationkey", F.col("place").cast("bigint").alias("place"), "e.id", "e.name")


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def device_semi(spark, sf_dir):
    devices = _table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return diff.on_devices(_table(spark, sf_dir, "customer"), devices, "c_nationkey", 3).select("c_custkey")


@query("""SELECT c_custkey, CASE WHEN n_name IS NOT NULL THEN n_name || '/' || c_custkey ELSE printf('%x', c_nationkey) || ':' || c_custkey END AS key
          FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON c_nationkey = n_nationkey""")
def device_label(spark, sf_dir):
    devices = _table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("label"))
    return diff.inode_label(_table(spark, sf_dir, "customer"), devices, "c_nationkey", "c_custkey").select("c_custkey", "key")


# Trees


def _nodes(spark, sf_dir):
    r, n, c, o = (_table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    none = F.lit(0).cast("bigint")
    root = spark.range(1).select(F.lit("/").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit("").alias("name"), none.alias("cents"), F.lit(False).alias("late"))
    late, cents = F.col("o_orderdate") > F.lit("2001-07-25").cast("timestamp_ntz"), F.round(F.col("o_totalprice") * 100).cast("bigint")
    return (
        root.unionByName(r.select(text("r", "r_regionkey").alias("id"), F.lit("/").alias("parent"), F.lit(1).alias("depth"), F.col("r_name").alias("name"), none.alias("cents"), F.lit(False).alias("late")))
        .unionByName(n.select(text("n", "n_nationkey").alias("id"), text("r", "n_regionkey").alias("parent"), F.lit(2).alias("depth"), F.col("n_name").alias("name"), none.alias("cents"), F.lit(False).alias("late")))
        .unionByName(c.select(text("c", "c_custkey").alias("id"), text("n", "c_nationkey").alias("parent"), F.lit(3).alias("depth"), F.col("c_name").alias("name"), none.alias("cents"), F.lit(False).alias("late")))
        .unionByName(o.select(text("o", "o_orderkey").alias("id"), text("c", "o_custkey").alias("parent"), F.lit(4).alias("depth"), text("o", "o_orderkey").alias("name"), cents.alias("cents"), late.alias("late")))
    )


_TREE = """
    t0 AS (SELECT '/' AS id, CAST(NULL AS VARCHAR) AS parent, 0 AS depth, '' AS name, CAST(0 AS BIGINT) AS cents, false AS late
          UNION ALL SELECT 'r' || r_regionkey, '/', 1, r_name, 0, false FROM region
          UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 2, n_name, 0, false FROM nation
          UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 3, c_name, 0, false FROM customer
          UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 4, 'o' || o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT), o_orderdate > TIMESTAMP '2001-07-25' FROM orders)"""
_CLOSURE = f"{_TREE}, up AS (SELECT id AS top, id, cents, late FROM t0 UNION ALL SELECT t0.parent, up.id, up.cents, up.late FROM up JOIN t0 ON up.top = t0.id WHERE t0.parent IS NOT NULL)"


@query(f"WITH RECURSIVE {_CLOSURE} SELECT top AS id, bool_or(late) AS is_dirty FROM up GROUP BY top")
def tree_dirty(spark, sf_dir):
    return tree.dirty(_nodes(spark, sf_dir), F.col("late"), 4).select("id", F.col("value").alias("is_dirty"))


@query(f"WITH RECURSIVE {_CLOSURE} SELECT top AS id, count(*) AS n_nodes, CAST(sum(cents) AS BIGINT) AS cents FROM up GROUP BY top")
def subtree_size(spark, sf_dir):
    both = F.struct(F.lit(1).cast("bigint").alias("n_nodes"), F.col("cents").alias("cents"))
    return tree.totals(_nodes(spark, sf_dir), both, 4).select("id", "value.n_nodes", "value.cents")


@query("""SELECT DISTINCT 'c' || o_custkey AS id FROM orders WHERE o_orderkey % 9 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)""")
def exclude_marks_parent(spark, sf_dir):
    gone = _nodes(spark, sf_dir).where("depth = 4").withColumn("key", F.substring("id", 2, 20).try_cast("bigint")).where("key % 9 = 0")
    return tree.marked_parents(gone, _table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("key")), ["key"])


@query("""WITH f AS (SELECT doc_id, '/' || source || '/' || lang || '/' AS d, '/' || source || '/' || lang || '/' || doc_id || '.txt' AS p FROM documents),
        t AS (SELECT d, md5(split_part(d, '/', 3)) AS ino, row_number() OVER (PARTITION BY split_part(d, '/', 3) ORDER BY d) AS n FROM (SELECT DISTINCT d FROM f))
        SELECT p AS path FROM f JOIN t USING (d) WHERE n = 1 UNION ALL SELECT d FROM t WHERE n = 1""")
def visited_directories(spark, sf_dir):
    """Directories of one language count as one directory that is met again and again."""
    files = _files(spark, sf_dir).select("path", F.lit("reg").alias("kind"), F.lit(None).cast("string").alias("ino"), "lang")
    folders = _files(spark, sf_dir).select(F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/")).alias("path"), F.lit("dir").alias("kind"), F.md5("lang").alias("ino"), "lang").distinct()
    return tree.visited_once(files.unionByName(folders), ["ino"])[0].select("path")


_ROLL = """
    l4 AS (SELECT parent, name, sha256(name || ':' || cents || '|') AS v FROM t0 WHERE depth = 4),
    g4 AS (SELECT parent, string_agg(name || ':' || v, ',' ORDER BY name) AS g FROM l4 GROUP BY parent),
    l3 AS (SELECT id, t0.parent, name, sha256(name || ':' || cents || '|' || coalesce(g, '')) AS v FROM t0 LEFT JOIN g4 ON g4.parent = t0.id WHERE depth = 3),
    g3 AS (SELECT parent, string_agg(name || ':' || v, ',' ORDER BY name) AS g FROM l3 GROUP BY parent),
    l2 AS (SELECT id, t0.parent, name, sha256(name || ':' || cents || '|' || coalesce(g, '')) AS v FROM t0 LEFT JOIN g3 ON g3.parent = t0.id WHERE depth = 2),
    g2 AS (SELECT parent, string_agg(name || ':' || v, ',' ORDER BY name) AS g FROM l2 GROUP BY parent),
    l1 AS (SELECT id, t0.parent, name, sha256(name || ':' || cents || '|' || coalesce(g, '')) AS v FROM t0 LEFT JOIN g2 ON g2.parent = t0.id WHERE depth = 1),
    g1 AS (SELECT parent, string_agg(name || ':' || v, ',' ORDER BY name) AS g FROM l1 GROUP BY parent),
    l0 AS (SELECT id, sha256(name || ':' || cents || '|' || coalesce(g, '')) AS v FROM t0 LEFT JOIN g1 ON g1.parent = t0.id WHERE depth = 0)"""


@query(f"WITH {_TREE}, {_ROLL} SELECT id, v AS digest FROM l0 UNION ALL SELECT id, v FROM l1 UNION ALL SELECT id, v FROM l2 UNION ALL SELECT id, v FROM l3")
def merkle_rollup(spark, sf_dir):
    own = F.concat("name", F.lit(":"), F.col("cents").cast("string"))
    return tree.merkle(_nodes(spark, sf_dir), own, 4).where("depth < 4").select("id", F.col("value").alias("digest"))


@query(f"WITH RECURSIVE {_TREE}, p AS (SELECT id, '' AS path FROM t0 WHERE parent IS NULL UNION ALL SELECT t0.id, p.path || '/' || t0.name FROM t0 JOIN p ON t0.parent = p.id) SELECT id, path FROM p")
def tree_paths(spark, sf_dir):
    return tree.paths(_nodes(spark, sf_dir), 4).select("id", "path")


# Exclusion: the SQL side tests the same expressions with another engine, written out

_RE2 = r"^(?:/(.*/)?[^/]*\.tmp/?|/(.*/)?src1//?|/src2/(.*)?./?|/en/[^/]*7\.txt/?|/(.*/)?de/[^/]\.txt/?|/(.*/)?[^s]rc[^/]*/?|/src3/e[ns]//?)$"


@query(rf"SELECT doc_id, regexp_full_match('/' || source || '/' || lang || '/' || doc_id || '.txt', '{_RE2}') AS is_excluded FROM documents")
def exclude_glob(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", F.col("path").rlike(globs.combined(PATTERNS)).alias("is_excluded"))


@query(rf"""WITH f AS (SELECT doc_id, '/' || source || '/' AS a, '/' || source || '/' || lang || '/' AS b, '/' || source || '/' || lang || '/' || doc_id || '.txt' AS p FROM documents)
        SELECT doc_id, p AS path FROM f WHERE NOT (regexp_full_match(a, '{_RE2}') OR regexp_full_match(b, '{_RE2}') OR regexp_full_match(p, '{_RE2}'))""")
def exclude_subtree(spark, sf_dir):
    return tree.without_excluded(_files(spark, sf_dir), "path", globs.combined(PATTERNS)).select("doc_id", "path")


# Keyed tables


@query("SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def index_upsert(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return index.upserted(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), ["user_id"], ["ts", "event_id"])


@query(f"WITH {_BLOCKS}, n AS (SELECT (SELECT count(*) FROM documents) + (SELECT count(DISTINCT hash) FROM h) AS objects) SELECT objects, objects // 2 + 1 AS filter_bytes FROM n")
def index_stats(spark, sf_dir):
    found = _hashed(spark, sf_dir).agg(F.countDistinct("hash").alias("n"))
    n = _table(spark, sf_dir, "documents").agg(F.count("*").alias("n")).union(found).agg(F.sum("n").alias("objects"))
    return n.select("objects", F.expr("objects div 2 + 1").alias("filter_bytes"))


# Retention


def _snapshots(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), "event_type", "ts", F.col("event_id").alias("argpos"), (F.col("event_id") % 7 != 0).alias("has_bloom"))


_CUTS = """
    e AS (SELECT event_id AS id, event_type, ts, event_id % 7 <> 0 AS has_bloom FROM events),
    l AS (SELECT event_type, max(ts) AS last, CAST(max(ts) AS DATE) AS d FROM e GROUP BY event_type),
    k AS (SELECT unnest(range(0, 7)) AS i),
    c AS (SELECT event_type, 'days' AS rule, CAST(d - CAST(i AS INTEGER) AS DATE) AS cutoff FROM l, k
          UNION ALL SELECT event_type, 'weeks', CAST(d - CAST(dayofweek(d) + 7 * i AS INTEGER) AS DATE) FROM l, k WHERE i < 4
          UNION ALL SELECT event_type, 'months', CAST(date_trunc('month', d) - to_months(CAST(i AS INTEGER)) AS DATE) FROM l, k WHERE i < 4
          UNION ALL SELECT event_type, 'years', CAST(date_trunc('year', d) AS DATE) FROM l),
    p AS (SELECT event_type, rule, cutoff, id, ts FROM (
            SELECT c.*, e.id, e.ts, row_number() OVER (PARTITION BY c.event_type, rule, cutoff ORDER BY e.ts DESC, e.id) AS n
            FROM c JOIN e ON c.event_type = e.event_type AND e.has_bloom AND e.ts <= c.cutoff) WHERE n = 1),
    keep AS (SELECT id FROM p UNION SELECT e.id FROM e JOIN l USING (event_type) WHERE has_bloom AND ts > last - INTERVAL 86400 SECOND)"""


@query(f"WITH {_CUTS} SELECT id FROM keep")
def retention_keep(spark, sf_dir):
    return retention.kept(_snapshots(spark, sf_dir), ["event_type"])


@query(f"WITH {_CUTS} SELECT id, event_type, ts FROM e WHERE id NOT IN (SELECT id FROM keep)")
def retention_delete(spark, sf_dir):
    return retention.culled(_snapshots(spark, sf_dir), ["event_type"]).select("id", "event_type", "ts")


def _old_snapshots(spark, sf_dir):
    """Orders as snapshots over several years, with many equal times at midnight."""
    o = _table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("event_type"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("argpos"), (F.col("o_orderkey") % 7 != 0).alias("has_bloom"))


_EVENTS_AS, _ORDERS_AS = "SELECT event_id AS id, event_type, ts, event_id % 7 <> 0 AS has_bloom FROM events", "SELECT o_orderkey AS id, o_orderstatus AS event_type, o_orderdate AS ts, o_orderkey % 7 <> 0 AS has_bloom FROM orders"


def _rule(name: str, rule: str, rows, sql: str):
    def f(spark, sf_dir):
        return retention.picks(rows(spark, sf_dir), ["event_type"], {rule: retention.RULES[rule]}).select("event_type", F.col("cutoff").cast("string").alias("cutoff"), "id", "ts")

    f.__name__ = f"retention_{name}"
    query(f"WITH {_CUTS.replace(_EVENTS_AS, sql)} SELECT event_type, CAST(cutoff AS VARCHAR) AS cutoff, id, ts FROM p WHERE rule = '{rule}'")(f)


for _name, _r in (("daily", "days"), ("weekly", "weeks")):
    _rule(_name, _r, _snapshots, _EVENTS_AS)
for _name, _r in (("monthly", "months"), ("yearly", "years")):
    _rule(_name, _r, _old_snapshots, _ORDERS_AS)


@query(f"WITH {_CUTS} SELECT c.event_type, c.rule, CAST(c.cutoff AS VARCHAR) AS cutoff, x.ts FROM c ASOF JOIN (SELECT event_type, ts FROM e WHERE has_bloom) x ON c.event_type = x.event_type AND x.ts <= CAST(c.cutoff AS TIMESTAMP)")
def asof_latest(spark, sf_dir):
    return retention.picks(_snapshots(spark, sf_dir), ["event_type"]).select("event_type", "rule", F.col("cutoff").cast("string").alias("cutoff"), "ts")


# Garbage collection


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def gc_exact(spark, sf_dir):
    listed = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return gc.garbage(listed, [_table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("id"))])


@query(f"WITH {_BLOCKS} SELECT DISTINCT hash AS id FROM h WHERE hash NOT IN (SELECT hash FROM h WHERE doc_id % 3 = 0) AND hash NOT IN (SELECT hash FROM h WHERE doc_id % 5 = 0)")
def gc_any_of(spark, sf_dir):
    found = _hashed(spark, sf_dir).select(F.col("hash").alias("id"), "doc_id")
    return gc.garbage(found.select("id").distinct(), [found.where("doc_id % 3 = 0"), found.where("doc_id % 5 = 0")])


@query(f"""WITH {_BLOCKS}, live AS (SELECT DISTINCT hash FROM h WHERE doc_id % 3 = 0), m AS (SELECT 8 * (count(*) // 2 + 1) AS bits FROM live),
        p AS (SELECT hash, CAST('0x' || substr(sha256(hash), 1 + 15 * i, 15) AS BIGINT) % (SELECT bits FROM m) AS p FROM (SELECT DISTINCT hash FROM h), (VALUES (0), (1), (2)) v(i)),
        held AS (SELECT DISTINCT p FROM p WHERE hash IN (SELECT hash FROM live))
        SELECT hash AS id FROM p GROUP BY hash HAVING count(*) FILTER (p NOT IN (SELECT p FROM held)) > 0""")
def gc_bloom(spark, sf_dir):
    """What the filter of every third document's blocks lets a collection remove: no live block, and most of the others."""
    found = _hashed(spark, sf_dir).select(F.col("hash").alias("id"), "doc_id")
    ids, live = found.select("id").distinct(), found.where("doc_id % 3 = 0").select("id").distinct()
    n_bytes = gc.filter_bytes(live.count())
    bits = gc.sha_bits(F.col("id"), gc.K, n_bytes)
    return ids.join(gc.matching(ids, bits, gc.build(live, bits)), "id", "left_anti")


# Names, sizes and records


@query(f"WITH {_BLOCKS} SELECT doc_id, block, 'objects/' || substr(hash, 1, 3) || '/' || hash AS path FROM h")
def object_paths(spark, sf_dir):
    return _hashed(spark, sf_dir).select("doc_id", "block", object_path(F.col("hash")).alias("path"))


@query(f"WITH {_BLOCKS} SELECT substr(hash, 1, 3) AS prefix, count(DISTINCT hash) AS objects FROM h GROUP BY ALL")
def fanout_histogram(spark, sf_dir):
    return _hashed(spark, sf_dir).select("hash").distinct().groupBy(F.substring("hash", 1, 3).alias("prefix")).agg(F.count("*").alias("objects"))


@query("SELECT doc_id, sha256(encode(text) || CASE WHEN doc_id % 10 = 0 THEN 'x'::BLOB ELSE ''::BLOB END) AS digest, sha256(encode(text)) = digest AS is_intact FROM documents")
def integrity_check(spark, sf_dir):
    stored = _files(spark, sf_dir).withColumn("id", F.sha2("content", 256))
    damaged = F.when(F.col("doc_id") % 10 == 0, F.concat("content", F.encode(F.lit("x"), "UTF-8"))).otherwise(F.col("content"))
    return stored.select("doc_id", F.sha2(damaged, 256).alias("digest"), (F.sha2(damaged, 256) == F.col("id")).alias("is_intact"))


def _summaries(spark, sf_dir):
    sec, nsec = F.unix_timestamp(F.col("ts").cast("timestamp")), F.expr("CAST(pmod(unix_micros(CAST(ts AS TIMESTAMP)), 1000000) * 1000 AS INT)")
    bloom = F.when(F.col("event_id") % 7 != 0, F.substring(F.sha2(F.concat(F.lit("b"), F.col("event_id").cast("string")), 256), 1, 56))
    return _table(spark, sf_dir, "events").select("event_id", "event_type", sec.alias("sec"), nsec.alias("nsec"), F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 56).alias("root"), bloom.alias("bloom"))


@query("""SELECT event_id, event_type || '-' || strftime(ts, '%Y-%m-%dT%H%M%S') || '.' || lpad(CAST(epoch_us(ts) % 1000000 * 1000 AS VARCHAR), 9, '0') || 'Z.txt' AS name,
          epoch_us(ts) // 1000000 AS sec, event_type AS label, event_id % 7 <> 0 AS has_bloom,
          sha256('timestamp ' || (epoch_us(ts) // 1000000) || '.' || lpad(CAST(epoch_us(ts) % 1000000 * 1000 AS VARCHAR), 9, '0') || chr(10) || 'label ' || event_type || chr(10) || 'root ' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 56)
                 || chr(10) || CASE WHEN event_id % 7 <> 0 THEN 'bloom ' || substr(sha256('b' || event_id), 1, 56) || chr(10) ELSE '' END) AS text_sha256 FROM events""")
def summary_format(spark, sf_dir):
    rows = _summaries(spark, sf_dir).withColumn("text", formats.summary_text(F.col("sec"), F.col("nsec"), F.col("event_type"), F.col("root"), F.col("bloom")))
    back = formats.summary_fields(F.col("text"))
    return rows.select("event_id", formats.summary_name(F.col("event_type"), F.col("sec"), F.col("nsec")).alias("name"), back["ts"]["sec"].alias("sec"), back["label"].alias("label"), back["bloom"].isNotNull().alias("has_bloom"), F.sha2("text", 256).alias("text_sha256"))


@query("SELECT event_type AS label, max(epoch_us(ts) // 1000000) AS last_sec, count(*) AS snapshots FROM events GROUP BY event_type")
def summary_parse(spark, sf_dir):
    rows = _summaries(spark, sf_dir).select(formats.summary_text(F.col("sec"), F.col("nsec"), F.col("event_type"), F.col("root"), F.col("bloom")).alias("text"))
    fields = formats.summary_fields(F.col("text"))
    parsed = rows.select(fields["label"].alias("label"), fields["ts"].alias("ts"))
    return parsed.groupBy("label").agg(F.max("ts").alias("last"), F.count("*").alias("snapshots")).select("label", F.col("last.sec").alias("last_sec"), "snapshots")


@query("""SELECT doc_id, 'reg' AS kind, 33188 + doc_id % 64 AS mode, 1000 + doc_id % 3 AS uid, 1 + doc_id % 2 AS nlink, sha256(encode(text)) AS payload_sha256,
          CASE WHEN octet_length(encode(text)) < 4000 THEN 'idata' ELSE 'blocks' END AS section,
          sha256(encode('mode 0' || printf('%o', 33188 + doc_id % 64) || chr(0) || 'uid ' || (1000 + doc_id % 3) || chr(0) || 'gid 100' || chr(0) || 'mtim ' || doc_id || '.000000005' || chr(0) || 'ctim ' || doc_id || '.000000005' || chr(0)
                        || CASE WHEN doc_id % 2 = 1 THEN 'nlink 2' || chr(0) ELSE '' END || CASE WHEN octet_length(encode(text)) < 4000 THEN 'idata' ELSE 'blocks' END || chr(0)) || encode(text)) AS record_sha256 FROM documents""")
def inode_record(spark, sf_dir):
    time = F.struct(F.col("doc_id").alias("sec"), F.lit(5).alias("nsec"))
    section = F.when(chunk.is_inline(F.octet_length("content")), F.lit("idata")).otherwise(F.lit("blocks"))
    mode = (F.lit(33188) + F.col("doc_id") % 64).cast("int")
    made = _files(spark, sf_dir).select("doc_id", formats.inode_record(mode, 1000 + F.col("doc_id") % 3, F.lit(100), time, time, 1 + F.col("doc_id") % 2, section, F.col("content")).alias("record"))
    back = made.select("doc_id", "record", *[c.alias(n) for n, c in formats.inode_fields(F.col("record")).items()])
    shown = from_octal(octal(F.col("mode"))).cast("bigint")
    return back.select("doc_id", file_kind(F.col("mode")).alias("kind"), shown.alias("mode"), "uid", "nlink", F.sha2("payload", 256).alias("payload_sha256"), "section", F.sha2("record", 256).alias("record_sha256"))


@query("SELECT doc_id, octet_length(encode(text)) + 40 + 512 + (512 - (octet_length(encode(text)) + 40) % 512) % 512 AS archive_bytes FROM documents")
def tar_size(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", formats.tar_bytes(F.octet_length("content").cast("bigint")).alias("archive_bytes"))


@query()
def sha3_blocks(spark, sf_dir):
    """Block ids of the compatible profile, by SHA3-224."""
    found = chunk.hashed(chunk.blocks(_files(spark, sf_dir), "doc_id", "content", BLOCK), "sha3_224")
    return found.select("doc_id", "block", hexed(F.col("hash")).alias("id"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a snapshot would store: blocks and bytes, logical, distinct, and new against an earlier snapshot."""
    now = _hashed(spark, sf_dir)
    found = chunk.two_level(chunk.distinct_blocks(now, ["doc_id", "block"]), now.where("doc_id % 3 = 0"))
    new = F.when(F.col("is_new"), F.col("n_bytes"))
    return found.agg(
        F.sum("copies").alias("blocks"), F.sum(F.col("copies") * F.col("n_bytes")).alias("logical_bytes"), F.count("*").alias("distinct_blocks"),
        F.sum("n_bytes").alias("stored_bytes"), F.count(new).alias("new_blocks"), F.sum(new).alias("new_bytes"),
    )


query(f"""WITH {_BLOCKS}, u AS (SELECT hash, n_bytes, count(*) AS copies, hash NOT IN (SELECT hash FROM h WHERE doc_id % 3 = 0) AS is_new FROM h GROUP BY hash, n_bytes)
    SELECT CAST(sum(copies) AS BIGINT) AS blocks, CAST(sum(copies * n_bytes) AS BIGINT) AS logical_bytes, count(*) AS distinct_blocks, CAST(sum(n_bytes) AS BIGINT) AS stored_bytes,
           count(*) FILTER (is_new) AS new_blocks, CAST(sum(n_bytes) FILTER (is_new) AS BIGINT) AS new_bytes FROM u""")(flagship)
