"""Language identification by compression.

For each language a zstandard raw-content dictionary is filled with text of that language. A text
is cut into blocks, each block is compressed with every dictionary, and the language with the
smallest total wins. Blocks keep the dictionary in play over the whole of a long text, which
would otherwise soon compress from its own beginning alone. A narrow margin rejects the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import held_out, id_type, learnable, map_batches

UNKNOWN = "und"
#: Labelled rows that the dictionaries are filled from, for each language at most: the least by a hash of doc_id in each of so many slots.
SLOTS = 128
#: A text of more characters than these passages hold gives so many, evenly over its whole length; bytes of a dictionary at most, shared
#: evenly by the rows that have more than their share.
PASSAGES, PASSAGE_CHARS, DICT_BYTES = 4, 300, 110 << 10
BLOCK_BYTES = 4096
LEVEL = 5
#: A text is rejected if the runner-up is larger by less than this share of the smallest size.
MARGIN = 0.005
#: How steeply the score rises with the bits that the best language saves in each byte.
SLOPE = 40.0


#: Bytes that count, by value: a-z and all of multi-byte characters; the others become spaces.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain(text: str) -> bytes:
    """What is compressed of a text: lower case, ASCII letters and all that is not ASCII, runs of anything else as one space."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(LETTERS).split())


@dataclass(frozen=True)
class Model:
    """Dictionary bytes of each language, the most frequent language first."""

    dictionaries: dict[str, bytes]

    @property
    def languages(self) -> list[str]:
        return list(self.dictionaries)


def fit(docs: DataFrame, slots: int = SLOTS) -> Model:
    """Dictionaries from learnable rows (doc_id not held out) with a lang and a text.

    The sample is bounded: SLOTS rows a language, PASSAGES x PASSAGE_CHARS characters each, are fetched; which
    ones they are depends on hashes of doc_id over all rows. Frequencies count all rows.
    """
    known = docs.select("doc_id", "lang", "text").where(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN))
    mixed = F.xxhash64(F.col("doc_id").cast("string"))
    picked = known.groupBy("lang", F.pmod(mixed, F.lit(slots)).alias("slot")).agg(F.count("*").alias("n"), F.min(mixed).alias("first"))
    rows = picked.select("lang", "n", "first").collect()
    if not rows:
        return Model({})
    frequent: dict[str, int] = {}
    for r in rows:
        frequent[r["lang"]] = frequent.get(r["lang"], 0) + r["n"]
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(r["lang"], r["first"]) for r in rows], "lang string, mixed bigint")
    texts = known.select("lang", mixed.alias("mixed"), _passages(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    # The wanted rows are bounded by languages x slots, so they are safe to broadcast.
    got = texts.join(F.broadcast(wanted), ["lang", "mixed"]).groupBy("lang", "mixed").agg(F.min("text").alias("text")).orderBy("lang", "mixed").collect()
    filled: dict[str, list[bytes]] = {lang: [] for lang in sorted(frequent, key=lambda x: (-frequent[x], x))}
    for r in got:
        filled[r["lang"]].append(plain(r["text"]) + b" ")
    return Model({lang: text for lang, rows in filled.items() if (text := _shared(rows, DICT_BYTES)).strip()})


def _passages(text: Column) -> Column:
    """A text, or passages at even distances from its beginning to its end."""
    n = F.char_length(text)
    cut = [F.substring(text, (F.lit(k) * (n - PASSAGE_CHARS) / (PASSAGES - 1)).cast("int") + 1, F.lit(PASSAGE_CHARS)) for k in range(PASSAGES)]
    return F.when(n <= PASSAGES * PASSAGE_CHARS, text).otherwise(F.concat_ws(" ", *cut))


def _shared(rows: list[bytes], most: int) -> bytes:
    """The rows one after another in `most` bytes: short ones whole, longer ones cut to the same length."""
    share, left = most, most
    for k, n in enumerate(sorted(map(len, rows))):
        share = left // (len(rows) - k)
        if n > share:
            break
        left, share = left - n, n
    return b"".join(r[:share] for r in rows)


class Compressors:
    def __init__(self, model: Model):
        self.each = []
        for text in model.dictionaries.values():
            made = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=LEVEL)
            self.each.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> np.ndarray:
        """Compressed bytes of the whole text with each dictionary."""
        data = plain(text)
        return np.array([sum(len(c.compress(data[at : at + BLOCK_BYTES])) for at in range(0, len(data), BLOCK_BYTES)) for c in self.each])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def decide(languages: list[str], sizes: np.ndarray, n_bytes: int, margin: float = MARGIN) -> tuple[str, float, bool]:
    """(language, score, rejected) from the sizes; ties go to the language that is more frequent."""
    best = int(np.argmin(sizes))
    if len(sizes) == 1:
        return languages[0], 1.0, False
    saved = np.delete(sizes, best) - sizes[best]
    score = 1 / (1 + float(np.exp(-SLOPE * np.minimum(saved / max(n_bytes, 1), 10)).sum()))
    return languages[best], score, bool(saved.min() < margin * sizes[best])


def identified(docs: DataFrame, model: Model, margin: float = MARGIN, keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each document (and the columns in keep).

    lang_pred is one of the model's languages; "und" with score 0 where the text is null or has no
    letter, or nothing was learned. rejected: the margin is narrow, or lang_pred is "und". Null
    ids are not held out; every row comes back once, repeated or not; ties go to the more frequent language; texts of
    any length are read whole; other columns are ignored; an empty table gives an empty table.
    """
    keep = keep or []
    languages = model.languages
    cached: list[Compressors] = []
    schema = docs.select("doc_id", *keep).schema
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema.fields[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cached:
            cached.append(Compressors(model))
        for batch in batches:
            found = []
            for text in batch.column(2).to_pylist():
                if not text or not languages or not has_letter(text):
                    found.append((UNKNOWN, 0.0, True))
                else:
                    found.append(decide(languages, cached[0].sizes(text), len(text.encode("utf-8", "replace")), margin))
            lang, score, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[3:], batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", *keep, "held_out", "lang_pred", "score", "rejected"],
            )

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("_text"), *keep)
    return map_batches(rows, run, f"doc_id {id_type(docs)}, {kinds}held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents that language identification does not reject, with all their columns.

    Null, empty and letterless texts are rejected; rows with null ids and repeated rows are judged each by its text;
    columns may have any names; an empty table gives an empty table.
    """
    model = model or fit(docs)
    # Columns travel under names of their own, so that none clashes with the result's.
    names = {c: f"_column_{k}" for k, c in enumerate(docs.columns) if c != "doc_id"}
    rows = docs.select("doc_id", docs["text"], *[docs[c].alias(n) for c, n in names.items()])
    found = identified(rows, model, keep=list(names.values())).where(~F.col("rejected"))
    return found.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])
