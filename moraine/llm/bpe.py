"""BPE encoding and decoding of whole texts, with tree concatenation for long ones.

Texts of up to LEAF_CHARS are encoded where they are read. A longer text is halved until its
pieces fit; the pieces travel to different tasks and are encoded in parallel. Then neighbours
are joined pairwise up the tree. At each join a window around the seam is encoded again and grows
until both of its ends agree with the sides:

- an end is certain where it lies on a hard boundary, at which the pre-tokenizer cuts in any context
  (a letter or digit before another kind of character, or anything before a white space);
- inside a run of one kind of character, which the pre-tokenizer never cuts, it is certain when the
  window's outermost token is the side's token at that place. A token sequence of a run is its
  encoding if and only if each pair of neighbours is the encoding of its own bytes, and all pairs
  then come from one of the three encodings.

If neither holds, the window grows, in the end to both sides whole.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import id_type, map_batches

#: Characters of a text that is encoded in one piece, at most.
LEAF_CHARS = 1 << 16
#: Tokens on each side of a seam that the first window holds.
FIRST_WINDOW = 8
#: The pre-tokenizer's pattern (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only byte-level BPE files without a normalizer or prefix space are supported")
        symbols, vocab = _byte_symbols(), spec["model"]["vocab"]
        last = -1
        for pair in spec["model"]["merges"]:
            made = vocab["".join(pair.split(" ") if isinstance(pair, str) else pair)]
            if made <= last:
                raise ValueError("ids do not follow the order of the merges")
            last = made
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(symbols[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        self.engine = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.size = {i: len(t) for t, i in ranks.items()} | {i: len(t.encode()) for t, i in self.special.items()}
        self.names = {i: str(i) for i in self.size}

    def plain(self, text: str) -> list[int]:
        """The encoding of a text in one piece; strings of special tokens become those tokens."""
        return self.engine.encode(text, allowed_special="all")

    def decode(self, ids: list[int]) -> str:
        """Special tokens are kept; bytes that are no UTF-8 become U+FFFD."""
        return self.engine.decode_bytes(ids).decode("utf-8", "replace")

    def halves(self, text: str, leaf_chars: int = LEAF_CHARS) -> list[str]:
        """The leaves of the tree over a text: a power of two of pieces of nearly the same length, none longer than leaf_chars."""
        n = 1
        while len(text) > n * leaf_chars:
            n *= 2
        cuts = [len(text) * k // n for k in range(n + 1)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:])]

    def concatenated(self, leaves: list[tuple[str, list[int]]]) -> list[int]:
        """The encoding of the whole text from its leaves and their encodings, joined pairwise up the tree."""
        parts = [(text.encode("utf-8"), ids) for text, ids in leaves]
        while len(parts) > 1:
            parts = [self._join(*parts[k], *parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0][1] if parts else []

    def tree(self, text: str, leaf_chars: int = LEAF_CHARS) -> list[int]:
        """The same as plain(), by way of the tree."""
        return self.concatenated([(t, self.plain(t)) for t in self.halves(text, leaf_chars)])

    def _join(self, left: bytes, a: list[int], right: bytes, b: list[int]) -> tuple[bytes, list[int]]:
        whole, seam = left + right, len(left)
        if not left or not right:
            return whole, a + b
        near, far = FIRST_WINDOW, FIRST_WINDOW
        while True:
            # The window starts before token i of the left side and ends before token j of the right side, on whole characters.
            i, start = max(0, len(a) - near), 0
            start = seam - sum(self.size[t] for t in a[i:])
            while i and _inside(whole, start):
                i -= 1
                start -= self.size[a[i]]
            j = min(len(b), far)
            end = seam + sum(self.size[t] for t in b[:j])
            while j < len(b) and _inside(whole, end):
                end += self.size[b[j]]
                j += 1
            window = self.plain(whole[start:end].decode("utf-8"))
            # A special token's string may lie across an end, so none may begin near it.
            left_ok = i == 0 or not self._special_near(whole, start) and (_hard(whole, start) or window[:1] == a[i : i + 1] and _one_kind(whole[start:seam]))
            right_ok = j == len(b) or not self._special_near(whole, end) and (_hard(whole, end) or window[-1:] == b[j - 1 : j] and _one_kind(whole[seam:end]) and _one_kind(whole[max(start, end - 8) : end + 1], cut=True))
            if left_ok and right_ok:
                return whole, a[:i] + window + b[j:]
            near, far = near * (1 if left_ok else 2), far * (1 if right_ok else 2)

    def _special_near(self, whole: bytes, at: int) -> bool:
        for token in self.special:
            mark = token.encode()
            if mark in whole[max(0, at - len(mark) + 1) : at + len(mark) - 1]:
                return True
        return False


def _inside(whole: bytes, at: int) -> bool:
    return at < len(whole) and whole[at] & 0xC0 == 0x80


def _kind(byte: int) -> str:
    c = chr(byte)
    return "white" if c in " \t\n\x0b\x0c\r" else "letter" if byte < 128 and c.isalpha() else "digit" if byte < 128 and c.isdigit() else "mark" if 32 < byte < 127 else ""


def _hard(whole: bytes, at: int) -> bool:
    """Whether the pre-tokenizer cuts here in any context. Only ASCII characters count as known."""
    before, after = _kind(whole[at - 1]), _kind(whole[at])
    return before in ("letter", "digit") and after not in ("", before) or before == "mark" and after == "white"


def _one_kind(run: bytes, cut: bool = False) -> bool:
    """Whether the run is of one kind of character, so that the pre-tokenizer leaves it whole. cut: it may begin inside a character."""
    if run.isascii():
        kinds = {_kind(x) for x in set(run)}
        return len(kinds) == 1 and kinds <= {"letter", "digit", "mark"} and b"'" not in run
    return run.decode("utf-8", "ignore" if cut else "strict").isalpha()


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def _digests(c: Codec, ids: list[int]) -> tuple[int, str, str]:
    names = c.names
    return len(ids), hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(c.decode(ids).encode("utf-8")).hexdigest()


def encoded(docs: DataFrame, path: str | None = None, output: str = "digests", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Encode every whole text with the tokenizer file at path, which each machine has.

    output "digests": doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the
    text that decoding gives back). "ids": doc_id, ids. A null text counts as empty; repeated rows, null
    ids and equal texts each keep their row. Other columns are ignored; an empty table gives an empty table.
    """
    path = path or default_path()
    kind = id_type(docs)
    columns = {"digests": ["n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"], "ids": ["ids array<int>"]}[output]
    names = [x.split()[0] for x in columns]

    def arrays(found: list[list[int]]) -> list[pa.Array]:
        if output == "ids":
            return [pa.array(found, pa.list_(pa.int32()))]
        n, ids, text = zip(*(_digests(codec(path), x) for x in found)) if found else ((), (), ())
        return [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [codec(path).plain(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays(found)], ["doc_id", *names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                leaves = codec(path).halves(text, leaf_chars)
                for at in range(0, len(leaves), 64):
                    some = leaves[at : at + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(some), pa.string()), pa.array(range(at, at + len(some)), pa.int32()), pa.array(some, pa.string())], ["key", "leaf", "text"])

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([codec(path).plain(t) for t in batch.column(2).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], ["key", "leaf", "text", "ids"])

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("leaf")
        ids = codec(path).concatenated(list(zip(table.column("text").to_pylist(), table.column("ids").to_pylist())))
        return pa.Table.from_arrays([table.column("key").slice(0, 1).combine_chunks(), *arrays([ids])], ["key", *names])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    short = map_batches(rows.where(F.char_length("text") <= leaf_chars), whole, ", ".join([f"doc_id {kind}", *columns]))
    long = rows.where(F.char_length("text") > leaf_chars)
    keyed = long.select(F.sha2("text", 256).alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    leaves = map_batches(keyed, cut, "key string, leaf int, text string").repartition("key", "leaf")
    leaves = map_batches(leaves, leaf, "key string, leaf int, text string, ids array<int>")
    joined = leaves.groupBy("key").applyInArrow(join, ", ".join(["key string", *columns]))
    return short.unionByName(long.select("doc_id", F.sha2("text", 256).alias("key")).join(joined, "key").select("doc_id", *names))


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids. Null ids give an empty text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec(path).decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return map_batches(ids.select("doc_id", "ids"), run, f"doc_id {id_type(ids)}, text string")
