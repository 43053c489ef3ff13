"""Toxicity: a classifier chain of linear models over hashed words and word beginnings.

Categories are predicted one after another: each logistic model reads which selected features a
text holds and the probabilities of the categories before it. In training those probabilities are
out-of-fold, so a later model learns from what an earlier one says of texts it hasn't seen.

The models are fitted on a bounded sample of the labelled rows (``SAMPLE``): one pass counts
features by category in tasks (sums by feature, pre-aggregated), the ``KEPT`` features that tell
a category apart best are chosen, and a second pass brings each sampled text's chosen features.
Scoring is one scan over whole texts with one weight table for each category: no shuffle.

Cases: a null or empty text scores from the intercepts; repeated documents are each scored; null
labels and labels other than 0 and 1 are not learned from; a document with several labels counts
with their largest; with no labels or one class only, a category's probability is its smoothed
share; an empty table gives no rows. Extra columns pass through in ``keep_clean``, which reads
nothing but text; a column of a result's name gets no mix-up, since results use fresh names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import byte_batches, fold, fresh, settle

#: Labelled rows that the models are fitted on, taken by a hash of the id. The only bound; scoring reads all rows.
SAMPLE = 10_000
#: Features are hashed to so many places; so many are kept for a category; a kept one is in so many texts of its class.
PLACES, KEPT, LEAST = 1 << 20, 2048, 3
BEGINNINGS = (4, 5, 6)
FOLDS, STEPS, RIDGE = 3, 120, 1e-3


def features(data: np.ndarray, offs: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) pairs, each once: the words and word beginnings of each text; only places ``wanted``, if given."""
    starts, ends = T.edges(data, offs)
    rows = T.row_of(offs, starts)
    keys = []
    for k, n in enumerate((0, *BEGINNINGS)):
        mine = slice(None) if not n else np.flatnonzero(ends - starts > n)
        s = starts[mine]
        hashes = T.word_hashes(data, s, ends[mine] if not n else s + n)
        place = T.mix(hashes + np.uint64(k)) >> np.uint64(44)
        row = rows[mine]
        if wanted is not None:
            hit = wanted[place.astype(np.int64)]
            place, row = place[hit], row[hit]
        keys.append((row.astype(np.uint64) << np.uint64(20)) | place)
    key = np.unique(np.concatenate(keys))
    return (key >> np.uint64(20)).astype(np.int64), (key & np.uint64(PLACES - 1)).astype(np.int64)


def read(batch: pa.RecordBatch, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    data, offs = T.buffers(batch["text"])
    parts = []
    for i, j in T.spans(offs):
        row, place = features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], wanted)
        parts.append((row + i, place))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64))


class Linear:
    """A logistic model: weights by feature place, weights of earlier probabilities, intercept."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, earlier: np.ndarray, intercept: float):
        self.places, self.weights, self.earlier, self.intercept = places, weights, earlier, intercept

    def table(self) -> np.ndarray:
        out = np.zeros(PLACES, np.float32)
        out[self.places] = self.weights
        return out

    def __call__(self, row: np.ndarray, place: np.ndarray, n: int, earlier: np.ndarray, table: np.ndarray) -> np.ndarray:
        z = np.bincount(row, table[place], n) + self.intercept + earlier @ self.earlier
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(row: np.ndarray, col: np.ndarray, n: int, width: int, earlier: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Ridge-penalised logistic regression by accelerated gradient steps on presence features."""
    share = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share / (1 - share)))
    w, v, b = np.zeros(width), np.zeros(earlier.shape[1]), start
    if n == 0 or y.min() == y.max():
        return w, v, b
    weight = np.where(y == 1, np.sqrt((1 - share) / share), 1.0) if share < 0.5 else np.ones(n)  # a rare class counts for more, not for half
    most = np.bincount(row, minlength=n).max(initial=1) + earlier.shape[1] + 1
    rate = 4.0 / min(most, 64)
    ww, vv, bb = w, v, b
    for step in range(STEPS):
        z = np.bincount(row, ww[col], n) + earlier @ vv + bb
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        nw = ww - rate * (np.bincount(col, g[row], width) * 20 + RIDGE * ww)
        nv = vv - rate * (earlier.T @ g + RIDGE * vv)
        nb = bb - rate * g.sum()
        m = step / (step + 3)
        ww, vv, bb = nw + m * (nw - w), nv + m * (nv - v), nb + m * (nb - b)
        w, v, b = nw, nv, nb
    return w, v, float(b)


class Chain:
    """The fitted chain; ``categories`` in the order of prediction."""

    def __init__(self, categories: list[str], models: list[Linear]):
        self.categories, self.models = categories, models
        self.tables = None

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        if self.tables is None:
            self.tables = [m.table() for m in self.models]
            self.wanted = np.any([t != 0 for t in self.tables], axis=0)
        row, place = read(batch, self.wanted)
        out = np.empty((batch.num_rows, 0))
        for model, table in zip(self.models, self.tables):
            out = np.column_stack([out, model(row, place, batch.num_rows, out, table)])
        return out


def train(documents: DataFrame, labels: DataFrame, categories: dict[str, object]) -> Chain:
    """Fit the chain; ``categories``: name -> 0/1 column of ``labels``. Rows of fold 0 of 5 are held out."""
    byte_batches(documents.sparkSession)
    names = list(categories)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.cast("int").alias(k) for k, c in categories.items()))
    known = known.where(fold(F.col("doc_id")) != 0).where(" AND ".join(f"`{k}` IN (0, 1)" for k in names))
    known = known.groupBy("doc_id").agg(*(F.max(k).alias(k) for k in names)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    known = known.select("doc_id", F.array(*names).alias("y"))
    sample = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")  # SAMPLE bounds it

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place = read(batch)
            y = np.array(batch["y"].to_pylist(), float).reshape(-1, len(names))
            found, at = np.unique(place, return_inverse=True)
            n = np.bincount(at, minlength=len(found)).astype(np.int64)
            pos = np.column_stack([np.bincount(at, y[row, k], len(found)) for k in range(len(names))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n), pa.array(list(pos), pa.list_(pa.int64()))], ["place", "n", "pos"])

    counts = sample.mapInArrow(tally, "place long, n long, pos array<long>")
    sums = counts.groupBy("place").agg(F.sum("n").alias("n"), *(F.sum(F.col("pos")[k]).alias(f"p{k}") for k in range(len(names))))
    sums = settle(sums, "sums")  # PLACES rows at most
    totals = known.agg(F.count("*"), *(F.sum(F.col("y")[k]) for k in range(len(names)))).first()
    places = set()
    for k in range(len(names)):
        one, zero = float(totals[k + 1] or 0) + 1, float(totals[0] - (totals[k + 1] or 0)) + 1
        ratio = F.log((F.col(f"p{k}") + 0.5) / one) - F.log((F.col("n") - F.col(f"p{k}") + 0.5) / zero)
        spread = F.sqrt(1 / (F.col(f"p{k}") + 0.5) + 1 / (F.col("n") - F.col(f"p{k}") + 0.5))
        strong = sums.where(F.greatest(F.col(f"p{k}"), F.col("n") - F.col(f"p{k}")) >= LEAST).select("place", (F.abs(ratio) / spread).alias("z"), F.abs(ratio).alias("r"))
        places |= {r.place for r in strong.where("z >= 2.2 AND r >= 1.5").orderBy(F.desc("z"), "place").limit(KEPT).select("place").collect()}
    places = np.array(sorted(places), np.int64)
    wanted = np.zeros(PLACES, bool)
    wanted[places] = True

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place = read(batch, wanted)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(place.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], lists, batch["y"]], ["doc_id", "x", "y"])

    rows = sample.mapInArrow(gather, "doc_id long, x array<int>, y array<int>")
    got = rows.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).select("doc_id", "r.x", "r.y").toArrow().sort_by("doc_id")
    n = got.num_rows
    lists = got["x"].combine_chunks() if n else pa.array([], pa.list_(pa.int32()))
    row = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False)) if n else np.empty(0, np.int64)
    col = np.searchsorted(places, lists.flatten().to_numpy()) if n else np.empty(0, np.int64)
    y = np.array(got["y"].to_pylist(), float).reshape(n, len(names))
    part = T.mix(got["doc_id"].to_numpy().astype(np.uint64)).astype(np.uint64) % np.uint64(FOLDS) if n else np.empty(0)
    earlier, models = np.empty((n, 0)), []
    for k in range(len(names)):
        w, v, b = fit(row, col, n, len(places), earlier, y[:, k])
        models.append(Linear(places, w, v, b))
        seen = np.empty(n)
        for f in range(FOLDS):
            out, test = part != f, part == f
            place_in = np.cumsum(out) - 1
            mine = out[row]
            fw, fv, fb = fit(place_in[row[mine]], col[mine], int(out.sum()), len(places), earlier[out], y[out, k])
            z = np.bincount(row, fw[col], n) + earlier @ fv + fb
            seen[test] = (1 / (1 + np.exp(-np.clip(z, -30, 30))))[test]
        earlier = np.column_stack([earlier, seen])
    return Chain(names, models)


def with_scores(documents: DataFrame, chain: Chain) -> tuple[DataFrame, list[str]]:
    """``documents`` with one probability column for each category, and the columns' names."""
    byte_batches(documents.sparkSession)
    out, names = documents, []
    for c in chain.categories:
        names.append(fresh(out, f"p_{c}"))
        out = out.withColumn(names[-1], F.lit(None).cast("double"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = chain(batch)
            for k, name in enumerate(names):
                at = batch.schema.get_field_index(name)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(p[:, k]))
            yield batch

    return out.mapInArrow(score, out.schema), names


def label_categories() -> dict[str, object]:
    """The chain over the two columns of the labels table: junk first, then toxic."""
    return {"junk": 1 - F.col("quality").cast("int"), "toxic": F.col("toxic")}


def score_toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out (not learned from), p_junk, p_toxic and toxic of every document."""
    chain = train(documents, labels, label_categories())
    scored, (junk, toxic) = with_scores(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), chain)
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col(junk).alias("p_junk"), F.col(toxic).alias("p_toxic"), (F.col(toxic) > threshold).alias("toxic"))


def keep_clean(documents: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """The documents that the chain doesn't call toxic, with their own columns."""
    chain = train(documents if learn_from is None else learn_from, labels, label_categories())
    scored, names = with_scores(documents, chain)
    return scored.where(F.col(names[-1]) <= threshold).select(*documents.columns)
