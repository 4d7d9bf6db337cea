"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

After Wang and Manning, "Baselines and Bigrams" (2012): a text's n-grams are hashed and counted, and a
count becomes a rate of so many in a thousand characters, so that a long text is not told by what any long
text holds. Each rate is multiplied by the log ratio of the n-gram's smoothed sums in the two classes,
for either class, and a logistic regression is trained on the products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import held_out, id_type, learnable, map_batches

ORDERS = (3, 4, 5)
BITS = 18
#: Labelled rows of each class to learn from, at most, and characters of one of them (longer ones are left out of the sample).
SAMPLE_ROWS, SAMPLE_CHARS = 2500, 20_000
#: Added to each n-gram's sum of rates in a class.
SMOOTHING = 0.3
#: A rate is a count in so many characters, of a text that is longer by PAD than it is, and RATE_CAP at most.
PER, PAD, RATE_CAP = 1000, 300, 6.0
#: N-grams count that are in this share of the sampled texts at least, and the ridge of their coefficients. Of GRID, the
#: pair with the best cross_validated() F1 over the rows of sf0.1 that are not held out.
LEAST_SHARE, DECAY = 0.025, 1.0
GRID = [(share, decay) for share in (0.015, 0.02, 0.025, 0.03) for decay in (0.1, 0.3, 1.0)]
EPOCHS, RATE = 200, 0.5
#: Log-odds that are taken off every score, so that clean documents are left alone. Cross-validated in the same way: at 0
#: precision 0.958, recall 0.903; at 0.4 0.977, 0.869; at 0.8 0.990, 0.854.
CAUTION = 0.8
#: Characters whose n-grams are hashed in one numpy step.
STEP = 1 << 20


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of every bucket: ratio times coefficient
    bias: float


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a whole text's n-grams, ascending, and how often each occurs. The text is lower-cased and has a space at each end."""
    codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    held = np.zeros(1 << BITS, np.int64) if len(codes) > STEP else None
    for at in range(0, len(codes), STEP):
        part, found = codes[at : at + STEP + max(ORDERS) - 1], []
        rolling = part * np.uint64(0x9E3779B97F4A7C15)
        for n in range(2, max(ORDERS) + 1):
            if len(part) < n:
                break
            rolling = (rolling[:-1] ^ (rolling[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + part[n - 1 :]
            if n in ORDERS:
                mixed = (rolling[:STEP] ^ (rolling[:STEP] >> np.uint64(32))) * np.uint64(0x94D049BB133111EB + 2 * n)
                found.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
        flat = np.concatenate(found) if found else np.empty(0, np.int64)
        if held is None:
            return np.unique(flat, return_counts=True)
        held += np.bincount(flat, minlength=1 << BITS)
    places = np.flatnonzero(held)
    return places, held[places]


def buckets(text: str | None) -> np.ndarray:
    return counted(text)[0]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and their rates."""
    places, counts = counted(text)
    return places, np.minimum(counts * PER / (len(text or "") + PAD), RATE_CAP)


def train(texts: list[str], labels: list[int], share: float | None = None, least_share: float = LEAST_SHARE, decay: float = DECAY) -> Model:
    """Fit on texts with labels 0 and 1. share: of label 1 among all labelled rows, if the sample does not show it."""
    return _train(_small(texts), labels, share, least_share, decay)


def _small(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features of many texts, in half the room."""
    return [(places.astype(np.int32), rates.astype(np.float32)) for places, rates in map(features, texts)]


def _train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], share: float | None, least_share: float, decay: float) -> Model:
    """rows is emptied."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        # One class only: its share decides.
        p = min(max(float(y.mean()) if len(y) else 0.0, 1e-3), 1 - 1e-3)
        return Model(np.zeros(1 << BITS), float(np.log(p / (1 - p))))
    n, sums, seen_in = len(y), np.full((2, 1 << BITS), SMOOTHING), np.zeros(1 << BITS, np.int64)
    for (places, rates), label in zip(rows, y):
        sums[int(label)][places] += rates
        seen_in[places] += 1
    ratio = np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())
    used = seen_in >= max(1, least_share * n)
    if not used.any():
        used[0] = True
    # The products of rates and ratios, by text and once more by n-gram, so that both sums run over neighbours.
    sizes, r, order = np.array([int(used[places].sum()) for places, _ in rows]), ratio[used].astype(np.float32), (np.cumsum(used) - 1).astype(np.int32)
    column, value, at = np.empty(sizes.sum(), np.int32), np.empty(sizes.sum(), np.float32), 0
    for places, rates in rows:
        kept = used[places]
        column[at : (end := at + int(kept.sum()))] = order[places[kept]]
        value[at:end] = rates[kept] * r[column[at:end]]
        at = end
    rows.clear()  # the features of a whole sample are large, and nobody needs them any more
    row, filled = np.repeat(np.arange(n, dtype=np.int32), sizes), np.flatnonzero(sizes)
    row_starts = (np.cumsum(sizes) - sizes)[filled]
    by_column = np.argsort(column, kind="stable")
    row_of, value_of = row[by_column], value[by_column]
    held = np.bincount(column, minlength=len(r))
    some = np.flatnonzero(held)
    column_starts = (np.cumsum(held) - held)[some]
    del by_column, row
    w, bias, seen = np.zeros(len(r)), 0.0, np.full(len(r) + 1, 1e-6)
    for _ in range(EPOCHS):  # full-batch AdaGrad: the same data give the same weights
        z = np.full(n, bias)
        z[filled] += np.add.reduceat(value * w.astype(np.float32)[column], row_starts) if len(filled) else 0.0
        gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        slope = np.append(decay * w / n, gap.sum())
        slope[some] += np.add.reduceat(value_of * gap.astype(np.float32)[row_of], column_starts) if len(some) else 0.0
        seen += slope**2
        step = RATE * slope / np.sqrt(seen) * 0.1
        w -= step[:-1]
        bias -= step[-1]
    weights = np.zeros(1 << BITS)
    weights[used] = w * r
    if share is not None:
        mine = y.mean()
        bias += np.log(share / (1 - share)) - np.log(mine / (1 - mine))
    return Model(weights, float(bias) - CAUTION)


def cross_validated(texts: list[str], labels: list[int], grid: list[tuple[float, float]] = GRID, folds: int = 3) -> list[tuple[float, float, float, float, float]]:
    """(least_share, decay, precision, recall, F1) of each pair of the grid, each text scored by a model that has not seen it.

    The folds go round by place. `python -m moraine.llm.toxicity FOLDER` runs this over the rows of a folder's tables that are not held out.
    """
    rows, y = _small(texts), np.array(labels)
    fold, out = np.arange(len(y)) % folds, []
    for least_share, decay in grid:
        marked = np.zeros(len(y), bool)
        for k in range(folds):
            model = _train([r for r, f in zip(rows, fold) if f != k], y[fold != k].tolist(), None, least_share, decay)
            marked[fold == k] = [_logit(model, *rows[i]) >= 0 for i in np.flatnonzero(fold == k)]
        right = int((marked & (y == 1)).sum())
        precision, recall = right / max(1, int(marked.sum())), right / max(1, int((y == 1).sum()))
        out.append((least_share, decay, precision, recall, 2 * precision * recall / max(precision + recall, 1e-9)))
    return out


def sampled(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[str], list[int], float | None]:
    """Texts and labels to learn from, and the share of label 1 among all labelled rows (None if it is 0 or 1).

    The sample is bounded: `rows` texts of each class, of SAMPLE_CHARS at most, the least by a hash of doc_id among
    those rows that are not held out; the share counts all of these. Null or other labels and null ids are passed
    over; of several labels of one document the highest counts, of several texts the least.
    """
    known = labels.where(learnable(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.char_length("text") <= SAMPLE_CHARS)
    there, order = known.join(texts.select("doc_id"), "doc_id", "left_semi"), F.xxhash64(F.col("doc_id").cast("string"))
    picked = [r for k in sorted(shares) for r in there.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(rows).collect()]
    if not picked:
        return [], [], None
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in picked], known.schema)
    # The chosen ids are bounded by 2 x rows, so they are safe to broadcast.
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id")
    share = shares.get(1, 0) / sum(shares.values())
    return sample["text"].tolist(), sample["toxic"].tolist(), share if 0 < share < 1 else None


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learn labels.toxic of rows that are not held out, from the sample of sampled()."""
    return train(*sampled(docs, labels, rows))


def _logit(model: Model, places: np.ndarray, rates: np.ndarray) -> float:
    return float((model.weights[places] * rates).sum()) + model.bias


def score(model: Model, text: str | None) -> float:
    return 1 / (1 + np.exp(-min(max(_logit(model, *features(text)), -40.0), 40.0)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each document.

    A null or empty text scores by the bias alone, as its two spaces hold no n-gram. Texts of any length are read
    whole. A score of exactly 0.5 predicts 1. Null ids are not held out; every row comes back once, repeated or not;
    other columns are ignored; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [score(model, t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return map_batches(rows, run, f"doc_id {id_type(docs)}, held_out boolean, score double, predicted int")


if __name__ == "__main__":
    import sys

    from pyspark.sql import SparkSession

    tables = [SparkSession.builder.getOrCreate().read.parquet(f"{sys.argv[1]}/{name}.parquet") for name in ("documents", "labels")]
    for found in cross_validated(*sampled(*tables)[:2]):
        print("least share %g, decay %g: precision %.3f, recall %.3f, F1 %.3f" % found)
