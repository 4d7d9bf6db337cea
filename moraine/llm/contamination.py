"""Benchmark decontamination with a distributed positional inverted index.

Index: tasks read documents and write self-contained segments of about SEGMENT_TOKENS tokens to the
shared folder, one Parquet row each: the segment's terms, for each term the ascending positions of all
its tokens (delta coded), and the documents' places. Every token of every document is posted. Positions
of different documents lie GAP apart, so no match runs from one into another. Segments are bounded
whatever the corpus holds, so the list of a frequent word is never gathered in one place.

Search: the benchmark's windows are sent as arrays of BLOCK_BYTES, about, in a block; a larger
benchmark is taken block by block. In each segment a window starts from the posting list of its rarest
term there, shifted by the term's offset, and the starts are intersected with the lists of the other
terms, from rare to frequent, for many windows at once.

An exact match of a window is a start from which each term stands in its own place; a near match is a
start (it may lie up to `slop` outside the text) from which each term stands within `slop` of its place.
Both are properties of the text alone, so they do not depend on segments, blocks or frequencies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import id_type, kept_rows, map_batches, staged

WINDOW = 10
SLOP = 1
SEGMENT_TOKENS = 400_000
#: Positions between documents; more than a window and its slop on both sides.
GAP = 64
#: Bytes of the window numbers of one broadcast block, about (terms, items and the index of terms take as much again), and windows of the piece of an item that goes to one block.
BLOCK_BYTES, PIECE_WINDOWS = 8 << 20, 1 << 12
#: Candidate starts that are looked at in one numpy step.
CANDIDATES = 1 << 20
#: Bytes by value: A-Z as a-z; digits, a-z and all of multi-byte characters as they are; others end a word.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. Null has none."""
    return (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()


@dataclass
class Benchmark:
    """Distinct windows of a block of items, as rows of term numbers, with the items of each."""

    window: int = WINDOW
    terms: dict[bytes, int] = field(default_factory=dict)
    windows: dict[bytes, list[int]] = field(default_factory=dict)  # term numbers as bytes: place in names
    names: dict[str, int] = field(default_factory=dict)

    def add(self, item_id: object, found: list[bytes]) -> None:
        coded = np.array([self.terms.setdefault(w, len(self.terms)) for w in found], np.int32)
        name = self.names.setdefault("" if item_id is None else str(item_id), len(self.names))
        for at in range(max(1, len(found) - self.window + 1) if found else 0):
            items = self.windows.setdefault(coded[at : at + self.window].tobytes(), [])
            if name not in items:
                items.append(name)

    def packed(self) -> Packed:
        table = np.full((len(self.windows), self.window), -1, np.int32)
        for row, window in zip(table, self.windows):
            terms = np.frombuffer(window, np.int32)
            row[: len(terms)] = terms
        ends = np.cumsum([len(x) for x in self.windows.values()], dtype=np.int64)
        items = np.array([x for some in self.windows.values() for x in some], np.int32)
        return Packed(b" ".join(self.terms), table, ends, items, list(self.names))


@dataclass(frozen=True)
class Packed:
    """What is sent to the tasks: terms by number, windows one a row (short ones filled with -1), where the items of each end, items, and their names."""

    terms: bytes
    table: np.ndarray
    ends: np.ndarray
    items: np.ndarray
    names: list[str]

    def items_of(self, windows: np.ndarray) -> list[str]:
        starts = np.append(0, self.ends)
        return sorted({self.names[i] for w in windows.tolist() for i in self.items[starts[w] : starts[w + 1]].tolist()})


def pieces(benchmark: DataFrame, window: int = WINDOW, piece_windows: int = PIECE_WINDOWS) -> DataFrame:
    """(item_id, piece, windows, found): items in pieces of piece_windows windows at most, which overlap by a window less one word."""
    lower = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = benchmark.select("item_id", F.regexp_extract_all(lower, F.lit(r"([0-9a-z\x{80}-\x{10FFFF}]+)"), F.lit(1)).alias("found"))
    n = F.greatest(F.size("found") - (window - 1), F.lit(1))
    cut = each.where(F.size("found") > 0).select("item_id", "found", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(piece_windows))).alias("piece"))
    windows = F.least(F.col("n") - F.col("piece"), F.lit(piece_windows))
    return cut.select("item_id", "piece", windows.alias("windows"), F.slice("found", F.col("piece") + 1, windows + (window - 1)).alias("found"))


SEGMENT = "segment string, terms binary, counts binary, deltas binary, doc_ids array<{kind}>, n_words array<int>"


def index(docs: DataFrame, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """The segments over all tokens of docs, staged in the shared folder."""
    kind = id_type(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, id_kind = TaskContext.get().partitionId(), 0, None
        vocab: dict[bytes, int] = {}
        tokens, ids, sizes, held = [], [], [], 0

        def segment() -> pa.RecordBatch:
            nonlocal vocab, tokens, ids, sizes, held, number
            base = np.cumsum([0, *(n + GAP for n in sizes[:-1])])
            flat = np.concatenate(tokens) if tokens else np.empty(0, np.int32)
            position = np.arange(len(flat)) + np.repeat(base - np.cumsum([0, *sizes[:-1]]), sizes)
            order = np.argsort(flat, kind="stable")
            counts = np.bincount(flat, minlength=len(vocab)).astype(np.int32)
            deltas = np.diff(position[order], prepend=0).astype(np.int32)
            if len(counts):
                starts = np.cumsum(counts) - counts
                deltas[starts] = position[order][starts]
            row = [[f"{task}-{number}"], [b" ".join(vocab)], [counts.tobytes()], [deltas.tobytes()]]
            columns = [pa.array(row[0]), *(pa.array(x, pa.binary()) for x in row[1:]), pa.array([ids], pa.list_(id_kind)), pa.array([sizes], pa.list_(pa.int32()))]
            number += 1
            vocab, tokens, ids, sizes, held = {}, [], [], [], 0
            return pa.RecordBatch.from_arrays(columns, ["segment", "terms", "counts", "deltas", "doc_ids", "n_words"])

        for batch in batches:
            id_kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(text)
                add = vocab.setdefault
                tokens.append(np.array([add(w, len(vocab)) for w in found], np.int32))
                ids.append(doc_id)
                sizes.append(len(found))
                held += len(found) + GAP
                if held >= segment_tokens:
                    yield segment()
        if ids:
            yield segment()

    segments = map_batches(docs.select("doc_id", F.col("text").cast("string")), run, SEGMENT.format(kind=kind))
    return staged(segments, "postings", "zstd")


def search(table: np.ndarray, counts: np.ndarray, postings: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, start, exact) of all matches, some at a time. table: windows of term numbers whose lists, of counts[term] each, follow one another in postings."""
    first = np.cumsum(counts) - counts
    span = int(postings.max()) + 4 * GAP if len(postings) else GAP
    # Terms and positions in one ascending array: a list is looked up by binary search within it.
    keys = np.repeat(np.arange(len(counts)), counts) * span + postings
    size = (table >= 0).sum(1)
    rarity = np.where(table >= 0, counts[table], np.iinfo(np.int64).max)
    order = np.argsort(rarity, axis=1, kind="stable")
    rarest = rarity.min(1)
    shifts = np.arange(-slop, slop + 1)
    for rows in _portions(np.flatnonzero(rarest > 0), rarest * len(shifts), CANDIDATES):
        at = order[rows, 0]
        n = rarest[rows]
        window = np.repeat(rows, n)
        place = postings[np.repeat(first[table[rows, at]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] - np.repeat(at, n)
        if slop:
            # Each posting stands for the starts that it is within slop of.
            place, window = (place[:, None] + shifts).ravel(), np.repeat(window, len(shifts))
        exact = np.ones(len(window), bool)
        for k in range(table.shape[1]):
            # Windows of fewer terms are done; they stay as they are.
            live = k < size[window]
            offset = order[window, k]
            wanted = np.where(live, table[window, offset], 0) * span + place + offset
            found = np.searchsorted(keys, wanted - slop)
            nearest = keys[np.minimum(found, len(keys) - 1)]
            close = (found < len(keys)) & (nearest <= wanted + slop) | ~live
            if slop:
                same = np.searchsorted(keys, wanted)
                exact &= (same < len(keys)) & (keys[np.minimum(same, len(keys) - 1)] == wanted) | ~live
            window, place, exact = window[close], place[close], exact[close]
            if not len(window):
                break
        if len(window):
            # A start that two postings gave is one.
            once = np.unique(window * span + place + GAP, return_index=True)[1]
            yield window[once], place[once], exact[once]


def _portions(rows: np.ndarray, weights: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The rows in runs whose weights add up to about most."""
    if len(rows):
        yield from np.split(rows, np.flatnonzero(np.diff(np.cumsum(weights[rows]) // most)) + 1)


def search_segment(items: Packed, numbers: dict[bytes, int], terms: list[bytes], counts: np.ndarray, deltas: np.ndarray, n_words: np.ndarray, slop: int) -> tuple[np.ndarray, dict, dict]:
    """For a segment: spans (start, length) of exact matches, and by document number the windows that match exactly and those that match nearly."""
    ends = np.cumsum(counts)
    local = np.full(len(numbers) + 1, len(terms), np.int64)  # benchmark term to its list here, the last is of fillers
    for k, term in enumerate(terms):
        t = numbers.get(term)
        if t is not None:
            local[t] = k
    table = local[items.table]
    rows = np.flatnonzero(((table < len(terms)) | (items.table < 0)).all(1))
    if not len(rows):
        return np.empty((0, 2), np.int64), {}, {}
    used, table = np.unique(np.where(items.table[rows] < 0, -1, table[rows]), return_inverse=True)
    table = table.reshape(len(rows), -1) - (used[0] < 0)
    lists = [np.cumsum(deltas[ends[k] - counts[k] : ends[k]], dtype=np.int64) for k in used[used >= 0].tolist()]
    size, base = (table >= 0).sum(1), np.cumsum(n_words + GAP) - (n_words + GAP)
    spans, exact_in, near_in = [], {}, {}
    for window, start, exact in search(table, np.array([len(x) for x in lists]), np.concatenate(lists), slop):
        owner = np.searchsorted(base - GAP // 2, start, "right") - 1
        for into, which in ((exact_in, exact), (near_in, ~exact)):
            for d, w in np.unique(np.stack([owner[which], rows[window[which]]], 1), axis=0).tolist():
                into.setdefault(d, []).append(w)
        spans.append(np.stack([start[exact], size[window[exact]]], 1))
    return np.concatenate(spans) if spans else np.empty((0, 2), np.int64), exact_in, near_in


def matches(segments: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """One row for each document and benchmark block (doc_id, segment, place, n_words, spans (start and end word of covered runs), items, near), and the number of blocks."""
    spark, block_windows = segments.sparkSession, max(1, block_bytes // (4 * window))
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    bench = pieces(benchmark, window, min(PIECE_WINDOWS, block_windows))
    n_blocks = -(-(bench.agg(F.sum("windows")).first()[0] or 0) // block_windows) or 1
    out = None
    for block in range(n_blocks):
        # Pieces are dealt out by a hash of all that they are, so blocks hold about the same.
        some = bench if n_blocks == 1 else bench.where(F.pmod(F.xxhash64("item_id", "piece", "found"), F.lit(n_blocks)) == block)
        items = Benchmark(window)
        for r in some.toLocalIterator():
            items.add(r["item_id"], [w.encode("utf-8", "replace") for w in r["found"]])
        sent = spark.sparkContext.broadcast(items.packed())

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            numbers = {t: k for k, t in enumerate(items.terms.split(b" "))} if items.terms else {}
            for batch in batches:
                for k in range(batch.num_rows):
                    name, terms, counts, deltas = (batch.column(c)[k].as_py() for c in range(4))
                    ids, n = batch.column(4).slice(k, 1).flatten(), batch.column(5).slice(k, 1).flatten().to_numpy().astype(np.int64)
                    spans, exact, near = search_segment(items, numbers, terms.split(b" ") if terms else [], np.frombuffer(counts, np.int32), np.frombuffer(deltas, np.int32), n, slop)
                    base = np.cumsum(n + GAP) - (n + GAP)
                    runs = _runs(spans, base, n)
                    named = [pa.array([items.items_of(np.array(of.get(d, ()), np.int64)) for d in range(len(n))], pa.list_(pa.string())) for of in (exact, near)]
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([name] * len(n)), pa.array(range(len(n)), pa.int32()), pa.array(n), pa.array([runs.get(d) for d in range(len(n))], pa.list_(pa.int32())), *named],
                        ["doc_id", "segment", "place", "n_words", "spans", "items", "near"],
                    )

        found = map_batches(segments, run, f"doc_id {kind}, segment string, place int, n_words bigint, spans array<int>, items array<string>, near array<string>")
        out = found if out is None else out.unionByName(found)
    return out, n_blocks


def _runs(spans: np.ndarray, base: np.ndarray, n_words: np.ndarray) -> dict[int, list[int]]:
    """Covered runs of each document, [start, end, start, end, ...] in its words."""
    if not len(spans):
        return {}
    cover = np.zeros(int(base[-1] + n_words[-1]) + 2, np.int32)
    np.add.at(cover, spans[:, 0], 1)
    np.add.at(cover, spans[:, 0] + spans[:, 1], -1)
    on = np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(on == 1), np.flatnonzero(on == -1)
    owner = np.searchsorted(base, starts, "right") - 1
    out: dict[int, list[int]] = {}
    for d, a, b in zip(owner.tolist(), starts.tolist(), ends.tolist()):
        out.setdefault(d, []).extend((a - int(base[d]), b - int(base[d])))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP, block_bytes: int = BLOCK_BYTES, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, spans, items.

    A window is `window` consecutive words of an item; an item with fewer words is one window, one without
    words has none. A document word inside any exact occurrence is hit. items: ids, as strings in order,
    of items with an exact occurrence; a null item_id counts as an empty string, a repeated one as one item.
    n_near: items with a near match (see above) and no exact one in the document. Null texts have no words;
    repeated rows and null doc_ids each keep their row; texts of any length are posted whole; other columns
    are ignored; empty tables give no rows or no hits.
    """
    if window > GAP // 2 or slop > GAP // 4:
        raise ValueError("a window and its slop must fit between documents")
    segments = index(docs, segment_tokens)
    found, n_blocks = matches(segments, benchmark, window, slop, block_bytes)
    # With one block this grouping would be an idle shuffle: each document has one row.
    if n_blocks > 1:
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("items", "near")]
        found = found.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("spans").alias("all_spans"), *lists)
        found = found.withColumns({"items": F.array_sort(F.array_distinct("items")), "spans": _merged(F.col("all_spans"))})
    spans = F.coalesce("spans", F.array().cast("array<int>"))
    hit = F.aggregate(F.sequence(F.lit(0), F.size(spans)), F.lit(0).cast("bigint"), lambda s, k: s + F.coalesce(F.get(spans, k) * F.when(k % 2 == 0, -1).otherwise(1), F.lit(0)))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"),
        F.size(F.array_except("near", "items")).cast("bigint").alias("n_near"), spans.alias("spans"), "items",
    )


def _merged(all_spans):
    """The union of covered runs of several blocks."""
    pairs = F.array_sort(F.flatten(F.transform(all_spans, lambda s: F.transform(F.sequence(F.lit(0), (F.size(s) / 2).cast("int") - 1), lambda k: F.struct(F.get(s, k * 2).alias("a"), F.get(s, k * 2 + 1).alias("b"))))))
    empty = F.array().cast("array<int>")
    return F.aggregate(
        F.filter(pairs, lambda p: p["a"].isNotNull()), empty,
        lambda out, p: F.when((F.size(out) > 0) & (p["a"] <= F.element_at(out, -1)), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.greatest(p["b"], F.element_at(out, -1))))).otherwise(F.concat(out, F.array(p["a"], p["b"]))),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark window, with all their columns.

    A document is told by (doc_id, text), so that rows that share an id are judged apart. Null and empty texts hold no
    window and stay, as do all rows where the benchmark is empty; rows with null ids and repeated rows are judged each
    by its text; texts are read whole; columns may have any names; an empty table gives an empty table.
    """
    sha = F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256)
    named = docs.select(F.struct(docs["doc_id"].alias("id"), sha.alias("sha")).alias("doc_id"), docs["text"])
    dirty = contaminated(named, benchmark).where("contaminated").select("doc_id.id", "doc_id.sha", F.lit(False).alias("kept"), F.lit(1).alias("copies")).distinct()
    return kept_rows(docs, staged(dirty, "contaminated"), {"id": docs["doc_id"], "sha": sha})
