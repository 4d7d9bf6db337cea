"""The queries opN_<name>, one for each operator, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm import bpe, chat, contamination, exact, html_text, language, licenses, lines, simhash, toxicity
from moraine.llm.common import documents


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scanned(documents(spark, sf_dir))
    return found.select("doc_id", F.array_join("families", ",").alias("families"), "n_paragraphs", F.round("probability", 6).alias("probability"), "n_predicted")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.scored(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    return chat.formatted(rows.unionByName(spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], rows.schema)))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduplicated(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("clean_text", 256).alias("text_sha256"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.identified(docs, language.fit(docs))


def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_licenses, op3_toxicity, op4_chat, op5_lines, op6_html, op7_language, op8_exact, op9_decontamination, op10_bpe)}

#: Regular expressions of the SQL below; DuckDB's engine knows \x escapes.
_CONTROL = r"<s>|</s>|\[/?INST\]|\[/?SYS\]|\[/?ROLE\]|\[=\]"

ORACLE_SQL = {
    "op8_exact": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') norm FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)""",
    "op4_chat": rf"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') text FROM conversations
                   UNION ALL SELECT -1, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
        t AS (SELECT *, length(text) + len(regexp_extract_all(text, '{_CONTROL}')) n,
                     CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 6
                     ELSE 20 + length(role) + len(regexp_extract_all(role, '{_CONTROL}')) END marks FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(3 + sum(n + marks) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op5_lines": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) k FROM documents),
        s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) i FROM l WHERE regexp_replace(line, '[\x20\x09-\x0D]', '', 'g') <> ''),
        w AS (SELECT doc_id, i, line || chr(10) || lead(line) OVER o || chr(10) || lead(line, 2) OVER o win FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        r AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) n FROM w WHERE win IS NOT NULL) WHERE n > 1),
        g AS (SELECT DISTINCT s.doc_id, s.k FROM s JOIN r ON s.doc_id = r.doc_id AND s.i BETWEEN r.i AND r.i + 2)
        SELECT l.doc_id, count(*) AS n_lines, count(g.k) AS n_removed, sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.k) FILTER (g.k IS NULL), '')) AS text_sha256
        FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.k = g.k GROUP BY l.doc_id""",
    "op9_decontamination": r"""
        WITH lower_words AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
        items AS (
          SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
        wins AS (
          SELECT DISTINCT item_id, least(len(w), 10) n, array_to_string(w[i:i + 9], ' ') win
          FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i FROM items WHERE len(w) > 0)),
        spots AS (
          SELECT d.doc_id, d.i, d.n, x.item_id FROM (
            SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') win
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM lower_words, (SELECT DISTINCT n FROM wins))) d
          JOIN wins x ON d.n = x.n AND d.win = x.win),
        hits AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) p FROM spots) GROUP BY doc_id),
        numbered AS (SELECT n, win, dense_rank() OVER (ORDER BY n, win) win_id FROM wins GROUP BY n, win),
        slots AS (SELECT win_id, n, unnest(range(0, n)) k, unnest(string_split(win, ' ')) word FROM numbered),
        places AS (SELECT doc_id, unnest(range(0, len(w))) p, unnest(w) word FROM lower_words),
        starts AS (SELECT DISTINCT doc_id, win_id, n, k, p - k + shift AS s FROM places JOIN slots USING (word), (VALUES (-1), (0), (1)) v(shift)),
        close AS (SELECT DISTINCT doc_id, win_id FROM (SELECT doc_id, win_id, n, s FROM starts GROUP BY ALL HAVING count(*) = n)),
        near AS (SELECT doc_id, count(*) n_near FROM (
          SELECT DISTINCT c.doc_id, x.item_id FROM close c JOIN numbered i USING (win_id) JOIN wins x ON x.n = i.n AND x.win = i.win
          EXCEPT SELECT doc_id, item_id FROM spots) GROUP BY doc_id),
        names AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) item FROM spots) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
        FROM lower_words d LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id) LEFT JOIN near USING (doc_id)""",
}
