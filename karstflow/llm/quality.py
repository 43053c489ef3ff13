"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are read from whole texts in tasks. The trees are fitted on a bounded sample of the
labelled rows (``SAMPLE``), flattened into arrays and sent to the tasks (some 100 KB), where numpy
walks all rows of a batch through a tree level by level. Scoring is one scan: no shuffle.

Cases: null and empty texts are scored from zero statistics; repeated documents are each scored;
labels that are null or neither 0 nor 1 are not learned from; a document with several labels counts
with their mean, rounded down; with no label, or one class only, every score is that class's
smoothed share; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import byte_batches, fold

#: Labelled rows that the trees are fitted on, taken by a hash of the id. The only bound; scoring reads all rows.
SAMPLE = 20_000
BINS, DEPTH, TREES, RATE, LEAST, RIDGE = 64, 4, 80, 0.15, 20, 1.0

NAMES = (
    "log_bytes log_words mean_word sd_word letters uppers digits blanks newlines stops commas exclaims bars symbols dashes wide "
    "distinct_words distinct_pairs top_word log_lines distinct_lines word_edges words_per_stop entropy long_words"
).split()
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n", b".", b",", b"!", b"|", b"#$%&*@^~<>{}[]\\", b"-_="]
TABLES = np.zeros((len(CLASSES) + 1, 256), bool)
for _i, _c in enumerate(CLASSES):
    TABLES[_i, list(_c)] = True
TABLES[-1, 128:] = True


def sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums over rows given by offsets; an empty row's sum is 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[offs[1:]] - total[offs[:-1]]


def run_stats(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, the largest count and the entropy (bits) of the values of each row."""
    key = np.sort((rows.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    count, row = np.diff(np.append(at, len(key))), (key[at] >> np.uint64(40)).astype(np.int64)
    most, total = np.zeros(n), np.bincount(row, count, n)
    np.maximum.at(most, row, count)
    share = count / np.maximum(total[row], 1)
    return np.bincount(row, minlength=n).astype(float), most, np.bincount(row, -share * np.log2(np.maximum(share, 1e-12)), n)


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of ``NAMES`` for each text."""
    n = len(offs) - 1
    size = np.diff(offs).astype(float)
    some = np.maximum(size, 1)
    shares = [sums(t[data], offs) for t in TABLES]
    starts, ends = T.edges(data, offs)
    rows = T.row_of(offs, starts)
    length = (ends - starts).astype(float)
    words = np.bincount(rows, minlength=n).astype(float)
    least = np.maximum(words, 1)
    mean = np.bincount(rows, length, n) / least
    sd = np.sqrt(np.maximum(np.bincount(rows, length**2, n) / least - mean**2, 0))
    hashes = T.word_hashes(data, starts, ends)
    distinct, most, entropy = run_stats(hashes, rows, n)
    pair = rows[1:] == rows[:-1]
    pairs = T.mix(hashes[1:][pair] * np.uint64(3) + hashes[:-1][pair])
    pair_rows = rows[1:][pair]
    distinct_pairs, _, _ = run_stats(pairs, pair_rows, n)
    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offs[:-1][size > 0], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    line_rows = T.row_of(offs, line_starts)
    lines = np.bincount(line_rows, minlength=n).astype(float)
    distinct_lines, _, _ = run_stats(T.word_hashes(data, line_starts, line_ends), line_rows, n)
    last = data[ends - 1] if len(ends) else np.empty(0, np.uint8)
    odd = np.bincount(rows, TABLES[9][last] | (last == 33), n)
    columns = [
        np.log1p(size), np.log1p(words), mean, sd, *(x / some for x in shares), distinct / least, distinct_pairs / np.maximum(words - 1, 1), most / least,
        np.log1p(lines), distinct_lines / np.maximum(lines, 1), odd / least, words / (shares[5] + 1), entropy, np.bincount(rows, length > 20, n) / least,
    ]
    return np.column_stack(columns)


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch with its rows' statistics, worked out over some MB of text at a time."""
    for batch in batches:
        data, offs = T.buffers(batch["text"])
        parts = [statistics(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in T.spans(offs, 2 * T.CHUNK)]
        yield batch, np.concatenate(parts) if parts else np.empty((0, len(NAMES)))


class Trees:
    """Boosted trees as arrays: feature and threshold of each inner node, value of each leaf."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss with ``BINS`` quantile bins for each feature."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    feature, threshold, value = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves))
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, feature[:0], threshold[:0], value[:0])
    n_rows, n_features = x.shape
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T)]) + np.arange(n_features) * BINS
    total = np.full(n_rows, base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n_rows, np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (n_features * BINS) + binned).ravel()
            hist = [np.bincount(key, np.repeat(w, n_features), width * n_features * BINS).reshape(width, n_features, BINS) for w in (g, h, np.ones(n_rows))]
            (gl, hl, nl), (gt, ht, nt) = [c.cumsum(axis=2) for c in hist], [c.sum(axis=2, keepdims=True) for c in hist]
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(nl < LEAST) | (nt - nl < LEAST)] = -np.inf
            flat = gain.reshape(width, -1)
            best = flat.argmax(axis=1)
            for k in range(width):
                f, b = divmod(int(best[k]), BINS)
                if flat[k, best[k]] > 1e-6 and b < len(cuts[f]):
                    feature[t, first + k], threshold[t, first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n_rows), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        total += value[t, leaf]
    return Trees(base, feature, threshold, value)


def training_rows(documents: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, text and y of the sampled labelled documents outside the held-out fold, one row for each id."""
    y = F.col(label).cast("int")
    known = labels.where(y.isin(0, 1) & (fold(F.col("doc_id")) != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.floor(F.avg(y)).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # SAMPLE bounds it


def train(documents: DataFrame, labels: DataFrame, label: str = "quality") -> Trees:
    def read(batches):
        for batch, x in describe(batches):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"], pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = training_rows(documents, labels, label).mapInArrow(read, "doc_id long, y int, x array<double>")
    got = rows.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).select("doc_id", "r.x", "r.y").toArrow().sort_by("doc_id")
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(NAMES))
    return fit(x, got["y"].to_numpy().astype(float))


def score_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    byte_batches(documents.sparkSession)
    trees = train(documents, labels)

    def score(batches):
        for batch, x in describe(batches):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(trees.score(x))], ["doc_id", "held_out", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
