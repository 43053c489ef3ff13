"""MinHash near-dedup: a chosen-path set similarity join, reduced to groups of linked documents.

A document's set are its distinct five-word shingles; documents with Jaccard similarity of at least
3/4 are linked. Documents with equal sets form one class, and only classes travel. Each of ``TREES``
independent trees branches a class by ``BRANCH`` chosen minwise tokens at each node, so a node holds
the classes that share its path of tokens. Nodes of up to ``LEAF`` classes are compared
exhaustively. Of a larger node one pivot, the member nearest to the node's majority, is compared with
all others; a node whose members are then in one group is done. In any other, if up to ``REST`` classes
are outside the pivot's group, they are compared with the whole node on full sets, in blocks of
``BLOCK`` by ``SLICE`` classes over an inverted index; else the node is branched again. At ``DEPTH``
the rest is compared in blocks whatever its size. ``REST`` and ``DEPTH`` choose between two complete
ways, so they change the work and not the outcome. So a group of thousands of near copies costs a star
of links, not all pairs, and no node is cut short.
At similarity 3/4 one tree misses a pair with a chance under 1/9 at any depth, all trees 3e-8;
a 128-bit sketch only drops comparisons 4.8 standard deviations below 3/4.

Every comparison that passes the sketch is confirmed on the full shingle sets read from the texts
again. Groups are the components of the confirmed links: smallest-label steps with shortcuts, all
as joins. A task holds a node of up to ``HELD`` classes; larger ones, at most one for ``HELD`` rows, are
never dealt out by node: their majorities and pivots are aggregates, which sum up where the rows lie.

Cases: a null or empty text, or one of white space, has an empty set and is linked with nothing;
fewer than five words are one shingle, told apart from longer ones; rows that repeat an id and a
text are the same document, rows that repeat an id with another text are judged by their own text;
a null id takes part and gets its group's smallest id, null if the whole group has none; an empty
table gives no rows. ``drop_near_copies`` keeps one row of each group, the one with the smallest
(id, text hash), null ids last (any one of rows that repeat both), and all rows with an empty set; it
keeps extra columns, which are not read elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import byte_batches, fresh, settle, sized

TREES, BRANCH, HASHES, LEAF, DEPTH = 8, 2, 128, 64, 10
REST, BLOCK, SLICE = 4096, 1024, 8192
#: Members of one node that a task holds, 0.5 MB.
HELD = 1 << 14
#: Sketch bits that agree: 112 of 128 on average at similarity 3/4, standard deviation 3.7.
NEAR_BITS = 94
MULTIPLIERS = T.seeds(HASHES, 3) | np.uint64(1)
NODE = T.seeds(HASHES, 4)
ROW = "node long, cid long, s1 long, s2 long"


def sets_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, offsets): each text's distinct shingles in ascending order."""
    n = len(offs) - 1
    starts, ends = T.edges(data, offs)
    hashes, rows = T.shingles(T.word_hashes(data, starts, ends), T.row_of(offs, starts), n)
    cuts = np.searchsorted(rows, np.arange(n + 1))
    for a, b in zip(cuts[:-1], cuts[1:]):
        hashes[a:b].sort()
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[keep], np.searchsorted(rows[keep], np.arange(n + 1))


def keys_of(hashes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit key of each set, as two signed integers."""
    out = []
    with np.errstate(over="ignore"):
        for salt in T.seeds(2, 5):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(hashes ^ salt), dtype=np.uint64)])
            out.append(T.mix(total[cuts[1:]] - total[cuts[:-1]] + salt).view(np.int64))
    return out[0], out[1]


def minima(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The minwise tokens of each set, a row of ``HASHES``; an empty set's are 0."""
    out = np.zeros((len(cuts) - 1, HASHES), np.uint32)
    some = np.flatnonzero(cuts[1:] > cuts[:-1])
    if len(some):
        at = cuts[:-1][some]
        with np.errstate(over="ignore"):
            for i, m in enumerate(MULTIPLIERS):
                out[some, i] = np.minimum.reduceat(((hashes * m) >> np.uint64(32)).astype(np.uint32), at)
    return out


def binary_rows(rows: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(rows).view(np.uint8)
    offs = np.arange(len(rows) + 1, dtype=np.int32) * (data.shape[1] if len(rows) else 0)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offs), pa.py_buffer(data)])


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = T.buffers(batch["text"])
        for i, j in T.spans(offs, T.CHUNK):
            hashes, cuts = sets_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            k1, k2 = keys_of(hashes, cuts)
            tokens = minima(hashes, cuts)
            bits = np.packbits((tokens & 1).astype(np.uint8), axis=1).view(np.int64)
            columns = [pa.array(x) for x in (np.diff(cuts).astype(np.int64), k1, k2, bits[:, 0].copy(), bits[:, 1].copy())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"][i:j], batch["h"][i:j], *columns, binary_rows(tokens)], ["doc_id", "h", "n_shingles", "k1", "k2", "s1", "s2", "tokens"])


def token_rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(T.buffers(batch["tokens"])[0], np.uint32).reshape(batch.num_rows, HASHES)


def row_batch(node, cid, s1, s2) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (node, cid, s1, s2)], ["node", "cid", "s1", "s2"])


def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first nodes of all trees: tree t branches by tokens BRANCH * t and following."""
    for batch in batches:
        tokens, cid, s1, s2 = token_rows(batch), *(batch[c].to_numpy() for c in ("cid", "s1", "s2"))
        nodes = [T.mix(tokens[:, i].astype(np.uint64) ^ NODE[i]).view(np.int64) for i in range(TREES * BRANCH)]
        yield row_batch(nodes, *([x] * len(nodes) for x in (cid, s1, s2)))


def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The child nodes: a node's own hash chooses the tokens that its classes are branched by."""
    for batch in batches:
        tokens, node, cid, s1, s2 = token_rows(batch), *(batch[c].to_numpy() for c in ("node", "cid", "s1", "s2"))
        nodes, at = [], np.arange(len(node))
        for b in range(BRANCH):
            chosen = T.mix(node.view(np.uint64) + np.uint64(b + 1))
            i = (chosen % np.uint64(HASHES)).astype(np.int64)
            nodes.append(T.mix(chosen ^ T.mix(tokens[at, i].astype(np.uint64) ^ NODE[i])).view(np.int64))
        yield row_batch(nodes, *([x] * BRANCH for x in (cid, s1, s2)))


def agree(a1, a2, b1, b2) -> np.ndarray:
    return 128 - np.bitwise_count((a1 ^ b1).view(np.uint64)).astype(np.int64) - np.bitwise_count((a2 ^ b2).view(np.uint64))


FOUND = "node long, a long, b long, near boolean, s1 long, s2 long"


def found_batch(node, a, b, near=None, s1=None, s2=None) -> pa.RecordBatch:
    """Pairs have no node; a large node's members name it and its pivot (b)."""
    columns = [pa.nulls(len(a), kind) if x is None else pa.array(x, kind) for x, kind in zip((node, a, b, near, s1, s2), [pa.int64()] * 3 + [pa.bool_()] + [pa.int64()] * 2)]
    return pa.RecordBatch.from_arrays(columns, ["node", "a", "b", "near", "s1", "s2"])


def star(s1: np.ndarray, s2: np.ndarray) -> tuple[int, np.ndarray]:
    """The member whose first 64 sketch bits are nearest to the majority's, and which members are near to it."""
    bits = np.unpackbits(s1.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    most = 2 * bits.sum(axis=0, dtype=np.int64) > len(s1)
    p = int(np.argmax((bits == most).sum(axis=1)))
    return p, agree(s1, s2, s1[p], s2[p]) >= NEAR_BITS


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes in order, of up to HELD members each: all near pairs of a node of up to LEAF classes; a larger
    node's members with its pivot. The last node of a batch is held until the next batch shows where it ends."""
    held = [np.empty(0, np.int64)] * 4

    def whole(node, cid, s1, s2):
        cuts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        sizes = np.diff(np.append(cuts, len(node)))
        size = np.repeat(sizes, sizes)
        for i, n in zip(cuts[sizes > LEAF], sizes[sizes > LEAF]):
            mine = slice(i, i + n)
            p, near = star(s1[mine], s2[mine])
            yield found_batch(node[mine], cid[mine], np.full(n, cid[i + p]), near, s1[mine], s2[mine])
        at = np.flatnonzero((size > 1) & (size <= LEAF))
        for d in range(1, LEAF):
            at = at[at + d < len(node)]
            at = at[node[at + d] == node[at]]
            if not len(at):
                break
            near = agree(s1[at], s2[at], s1[at + d], s2[at + d]) >= NEAR_BITS
            i, j = cid[at][near], cid[at + d][near]
            if len(i):
                yield found_batch(None, np.minimum(i, j), np.maximum(i, j))

    for batch in batches:
        rows = [np.concatenate([old, batch[c].to_numpy()]) for old, c in zip(held, ("node", "cid", "s1", "s2"))]
        if len(rows[0]):
            last = int(np.searchsorted(rows[0], rows[0][-1], "left"))
            held = [x[last:] for x in rows]
            if last:
                yield from whole(*(x[:last] for x in rows))
    if len(held[0]):
        yield from whole(*held)


def visit(rows: DataFrame) -> DataFrame:
    """What ``walk`` finds in all nodes of one level."""
    hot = settle(rows.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > HELD).select("node"), "hot")
    if not (n := hot.count()):
        return rows.repartition("node").sortWithinPartitions("node", "cid").mapInArrow(walk, FOUND)
    cold = rows.join(sized(hot, n), "node", "left_anti").repartition("node").sortWithinPartitions("node", "cid").mapInArrow(walk, FOUND)
    return cold.unionByName(hot_stars(settle(rows.join(sized(hot, n), "node", "left_semi"), "hot"), n))


def hot_stars(members: DataFrame, n: int) -> DataFrame:
    """``star`` of the ``n`` nodes that hold too many members for a task."""
    votes = members.groupBy("node").agg(F.count("*").alias("n"), *(F.sum(F.shiftrightunsigned("s1", i).bitwiseAND(1)).alias(f"v{i}") for i in range(64)))
    bit = lambda i: F.when(F.col(f"v{i}") * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    most = bit(0)
    for i in range(1, 64):
        most = most.bitwiseOR(bit(i))
    most = settle(votes.select("node", most.alias("most")), "majorities")
    near = members.join(sized(most, n), "node").withColumn("near", 64 - F.bit_count(F.col("s1").bitwiseXOR(F.col("most"))))
    best = near.groupBy("node").agg(F.max(F.struct("near", (-F.col("cid")).alias("neg"), "s1", "s2")).alias("p"))
    best = settle(best.select("node", (-F.col("p.neg")).alias("b"), F.col("p.s1").alias("p1"), F.col("p.s2").alias("p2")), "pivots")
    apart = F.bit_count(F.col("s1").bitwiseXOR(F.col("p1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("p2")))
    return members.join(sized(best, n), "node").select("node", F.col("cid").alias("a"), "b", (apart <= 128 - NEAR_BITS).alias("near"), "s1", "s2")


def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs with 100 * intersection >= 75 * union of the full sets."""
    for batch in batches:
        ids = [batch[c].to_numpy() for c in ("a", "b")]
        known, first = np.unique(np.concatenate(ids), return_index=True)
        texts = pa.chunked_array([batch["text_a"], batch["text_b"]]).take(pa.array(first))
        sets = text_sets(texts)
        x, y = (np.searchsorted(known, i) for i in ids)
        linked = []
        for i, j in zip(x, y):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            linked.append(100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) and both > 0)
        linked = np.array(linked, bool)
        yield pa.RecordBatch.from_arrays([pa.array(i[linked]) for i in ids], ["a", "b"])


def text_sets(texts: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    data, offs = T.buffers(texts)
    sets: list[np.ndarray] = []
    for i, j in T.spans(offs, T.CHUNK):
        hashes, cuts = sets_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        sets += np.split(hashes, cuts[1:-1])
    return sets


class RestBlock:
    """A block of a node's rest, indexed by shingle; other members are compared with all of it at once."""

    def __init__(self):
        self.cids, self.labels, self.sets, self.index = [], [], [], None

    def add(self, batch: pa.RecordBatch) -> None:
        self.cids.append(batch["cid"].to_numpy()), self.labels.append(batch["l"].to_numpy())
        self.sets += text_sets(batch["text"])

    def links(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """For each class of the block one confirmed link to each group among the batch's members."""
        if self.index is None:
            self.size = np.array([len(x) for x in self.sets])
            flat, owner = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), self.size)
            order = np.argsort(flat, kind="stable")
            self.owner = owner[order]
            self.index, first = np.unique(flat[order], return_index=True)
            self.cuts = np.append(first, len(flat))
            self.cids, self.labels = np.concatenate(self.cids), np.concatenate(self.labels)
        cids, labels, sets = batch["cid"].to_numpy(), batch["l"].to_numpy(), text_sets(batch["text"])
        out = []
        for cid, label, own in zip(cids, labels, sets):
            at = np.searchsorted(self.index, own)
            at = at[(at < len(self.index)) & (self.index[np.minimum(at, len(self.index) - 1)] == own)]
            both = np.bincount(self.owner[ragged(self.cuts[at], self.cuts[at + 1] - self.cuts[at])], minlength=len(self.size))
            hit = np.flatnonzero((100 * both >= 75 * (self.size + len(own) - both)) & (both > 0) & (self.labels != label))
            out += [(r, label, cid) for r in hit]
        found = np.array(out, np.int64).reshape(-1, 3)
        _, first = np.unique(found[:, :2], axis=0, return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(self.cids[found[first, 0]] if len(first) else found[:, 0]), pa.array(found[first, 2])], ["a", "b"])


def ragged(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The positions of runs [start, start + n), one after another."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(n) else 0) + np.repeat(starts - (ends - n), n)


def compare_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (node, block, slice, role): a block's rest comes first, then the members of its slice."""
    now, block = None, None
    for batch in batches:
        keys = np.column_stack([batch[c].to_numpy() for c in ("node", "block", "slice", "role")])
        cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]])) if len(keys) else []
        for i, j in zip(cuts[:-1], cuts[1:]):
            if tuple(keys[i, :3]) != now:
                now, block = tuple(keys[i, :3]), RestBlock()
            part = batch.slice(i, j - i)
            if keys[i, 3] == 0:
                block.add(part)
            elif block.sets:
                yield block.links(part)


def components(links: DataFrame) -> DataFrame:
    """(cid, label) of every linked class: label is the smallest cid that links lead to."""
    edges = settle(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    n = edges.count()
    files = 4 + n // 100_000  # so few edges need no more tasks
    labels = settle(edges.groupBy(F.col("a").alias("cid")).agg(F.least(F.col("a"), F.min("b")).alias("label")).coalesce(files), "labels")
    while True:
        near = sized(labels.withColumnRenamed("cid", "b"), n)
        seen = edges.join(near, "b").groupBy(F.col("a").alias("cid")).agg(F.min("label").alias("near")).coalesce(files)
        nearer = seen.join(sized(labels, n), "cid").select("cid", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        further = sized(labels.select(F.col("cid").alias("label"), F.col("label").alias("further")), n)
        step = nearer.join(further, "label").select("cid", "old", F.least("label", "further").alias("label"))
        step = settle(step.coalesce(files), "labels")
        moved = step.where("label < old").limit(1).count()
        labels = step.select("cid", "label")
        if not moved:
            return labels


class Join:
    """One run of the similarity join over ``documents``; ``rows`` and ``classes`` are written tables."""

    def __init__(self, documents: DataFrame):
        self.spark = documents.sparkSession
        byte_batches(self.spark)
        self.texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
        kinds = "doc_id long, h long, n_shingles long, k1 long, k2 long, s1 long, s2 long, tokens binary"
        self.rows = settle(self.texts.select("doc_id", "h", "text").mapInArrow(sketch, kinds), "sketches")
        place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
        same = self.rows.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min(place).alias("first"), *(F.first(c).alias(c) for c in ("s1", "s2", "tokens")))
        self.classes = settle(same.withColumn("cid", F.monotonically_increasing_id()), "classes")

    def read_texts(self, found: DataFrame) -> None:
        """Write down the texts of all classes that any comparison can need."""
        needed = found.select(F.col("a").alias("cid")).union(found.where("node IS NULL").select("b")).distinct()
        needed = self.classes.select("cid", F.col("first.doc_id").alias("of"), F.col("first.h").alias("of_h")).join(needed, "cid")
        rows = self.texts.join(needed, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("of_h")))
        self.known = settle(rows.groupBy("cid").agg(F.first("text").alias("text")), "texts")  # a row may stand several times

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        pairs = settle(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs")
        texts, n = self.known, pairs.count()
        if n * 2 <= 20_000:  # few pairs: only their texts are shuffled
            texts = texts.join(sized(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct(), 2 * n), "cid", "left_semi")
        both = pairs.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a")
        both = both.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")
        return settle(both.select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a long, b long"), "links")

    def labels(self) -> DataFrame:
        """(cid, label) of all linked classes."""
        rows = settle(self.classes.select("cid", "s1", "s2", "tokens").mapInArrow(roots, ROW), "level")
        links = labels = None
        for depth in range(DEPTH + 1):
            found = settle(visit(rows), "found")
            if depth == 0:
                self.read_texts(found)
            pairs = found.where("node IS NULL OR near").select("a", "b")
            new = self.confirmed(pairs if labels is None else unlinked(pairs, labels))
            links = new if links is None else links.union(new)
            labels = components(links)
            open_ = self.unfinished(found.where("node IS NOT NULL"), labels)
            if open_ is None:
                break
            near = self.rest_links(open_ if depth == DEPTH else open_.where(F.col("rest") <= REST))
            links = links.union(near)
            deep = open_.where(F.lit(depth < DEPTH) & (F.col("rest") > REST)).select("node", F.col("a").alias("cid"), "s1", "s2")
            if deep.isEmpty():
                labels = labels if near.isEmpty() else components(links)
                break
            rows = settle(deep.join(self.classes.select("cid", "tokens"), "cid").select("node", "cid", "s1", "s2", "tokens").mapInArrow(branch, ROW), "level")
        return labels

    def unfinished(self, members: DataFrame, labels: DataFrame) -> DataFrame | None:
        """Members (with label l) of the nodes that hold classes outside their pivot's group; how many those and all are."""
        of = labels.select(F.col("cid").alias("a"), F.col("label").alias("l"))
        rows = settle(members.join(sized(of, labels.count()), "a", "left").withColumn("l", F.coalesce("l", "a")), "members")
        nodes = rows.groupBy("node").agg(F.count("*").alias("size"), F.max(F.when(F.col("a") == F.col("b"), F.col("l"))).alias("pl"), F.min("l").alias("least"), F.max("l").alias("most"))
        nodes = settle(nodes.where("least < most").select("node", "size", "pl"), "nodes")  # the others are one group each
        if not (n := nodes.count()):
            return None
        rows = settle(rows.join(sized(nodes, n), "node").select("node", "a", "l", "s1", "s2", "size", (F.col("l") != F.col("pl")).alias("out")), "unfinished")
        rest = settle(rows.where("out").groupBy("node").agg(F.count("*").alias("rest")), "rests")
        return rows.join(sized(rest, n), "node")

    def rest_links(self, rows: DataFrame) -> DataFrame:
        """Confirmed links between a node's rest and all its members: the rest in blocks, the members in slices."""
        rows = rows.withColumns({"blocks": F.ceil(F.col("rest") / BLOCK).cast("int"), "slices": F.ceil(F.col("size") / SLICE).cast("int")})
        all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        part = lambda salt, c: F.pmod(F.xxhash64(F.lit(salt), "a"), F.col(c)).cast("int")
        rest = rows.where("out").select("node", part("b", "blocks").alias("block"), all_of("slices").alias("slice"), F.lit(0).alias("role"), F.col("a").alias("cid"), "l")
        others = rows.select("node", all_of("blocks").alias("block"), part("s", "slices").alias("slice"), F.lit(1).alias("role"), F.col("a").alias("cid"), "l")
        met = rest.unionByName(others).join(self.known, "cid").repartition("node", "block", "slice").sortWithinPartitions("node", "block", "slice", "role", "cid")
        return settle(met.select("node", "block", "slice", "role", "cid", "l", "text").mapInArrow(compare_rest, "a long, b long"), "links")

    def groups(self) -> DataFrame:
        """doc_id, h (the text's hash), n_shingles and the first row (doc_id, h) of each row's group; no first for an empty set."""
        classes = self.classes.select("k1", "k2", "cid", "first").join(self.labels(), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        first = settle(classes.groupBy("label").agg(F.min("first").alias("first")), "firsts")
        classes = classes.drop("first").join(sized(first, first.count()), "label").select("k1", "k2", "first")
        rows = self.rows.select("doc_id", "h", "n_shingles", "k1", "k2")
        full = rows.where("n_shingles > 0").join(classes, ["k1", "k2"]).select("doc_id", "h", "n_shingles", "first")
        return full.unionByName(rows.where("n_shingles = 0").select("doc_id", "h", "n_shingles"), allowMissingColumns=True)


def unlinked(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs that are not in one group yet."""
    for c in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("cid").alias(c), F.col("label").alias(f"l{c}")), c, "left")
    return pairs.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def near_groups(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links lead to) and kept (it is that id)."""
    least = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    rows = Join(documents).groups().select("doc_id", "n_shingles", least.alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(documents: DataFrame) -> DataFrame:
    """One row of each group, and the rows with an empty set, with their own columns."""
    of_id, of_h, name = (fresh(documents, c) for c in ("gone_id", "gone_h", "text_hash"))
    groups = settle(Join(documents).groups().where("first IS NOT NULL").select("doc_id", "h", (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.h") == F.col("h"))).alias("is_first")), "groups")
    key = (F.col("doc_id").alias(of_id), F.col("h").alias(of_h))
    gone = groups.where("NOT is_first").select(*key).distinct()
    again = settle(groups.where("is_first").groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").select(*key), "again")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(of_id)) & (F.col(name) == F.col(of_h))
    rows = documents.withColumn(name, F.xxhash64(F.col("text").cast("string"))).join(gone, same, "left_anti")
    if n := again.count():  # first rows that stand several times: any one of them stays
        others = [c for c in documents.columns if c != "doc_id"]
        once = rows.join(sized(again, n), same, "left_semi").groupBy("doc_id", name).agg(F.first(F.struct(*others)).alias("r")).select("doc_id", name, "r.*")
        rows = rows.join(sized(again, n), same, "left_anti").unionByName(once)
    return rows.select(*documents.columns)
