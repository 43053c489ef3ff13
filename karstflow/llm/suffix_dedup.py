"""Suffix-array dedup: repeated passages of at least ``min_len`` bytes, by longest-previous-factor arrays.

A full suffix sort of a corpus doesn't distribute, so suffixes are dealt into buckets in which all
equal passages are sure to meet. Each window of ``min_len`` bytes elects one anchor, its smallest
``GRAM``-byte hash (leftmost of equals): equal windows elect equal anchors at equal offsets.
1. Anchor hashes are counted over all texts (pre-aggregated in tasks, then summed).
2. Occurrences of hashes that stand more than once are kept, each with a 128-bit hash of its block: all
   bytes that its windows can reach. Of equal blocks the first and the last occurrence go on and
   stand for all, which have the last one's matches; so a block's copies are no load, however many.
3. These blocks are cut from their texts and the windows of an anchor's bucket are put in suffix order: by anchor
   and offset, as only those of one offset can be equal, then by bytes. LCPs come along runs of the text.
   Blocks without another of their anchor mostly follow each other in copied texts: where the first and the
   last occurrences keep their distance, they are cut as one stretch each, whose bytes so go out once.
   From the order, the LCP of neighbours and the previous and next smaller text positions come the
   longest previous factor (LPF) and, mirrored, the longest next factor of each suffix. A window is an earlier match's copy if its LPF reaches ``min_len``.
4. A bucket takes up to ``GROUP`` of an anchor's blocks; an anchor with more (a passage in very
   many surroundings) is dealt into several buckets. Each leaves one window of those that are equal, its
   first, and these few of all buckets are matched by 128-bit window hashes over the cluster.
Spans go back to their documents by (doc_id, text hash), where they are merged and cut out.

``keep_first`` removes later copies and keeps the first in order of (doc_id, text hash, position);
without it every copy goes. Matches are of bytes and never cross documents; strings are judged on
the input, not on what is left.

Cases: null and empty texts and those under ``min_len`` bytes lose nothing; texts of equal bytes
are copies of each other (with keep_first the smallest id's stays; a null id comes first); rows that
repeat both id and text count as copies without keep_first, and as one document with it; an empty
table gives no rows; extra columns pass through in ``without_repeats``, which drops the bytes of
a character that a cut has split and sets ``n_chars``, if there, to the new length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import byte_batches, fresh, settle, sized

MIN_LEN, GRAM = 200, 64
#: Window starts handled at once (their arrays stay in the cache); index bits below the hash in the election.
STEP, BITS = 1 << 17, 20
#: Blocks of one anchor in a bucket (0.7 MB of segments).
GROUP = 2048
#: Suffixes put in order at once; twice as many of one bucket are taken offset by offset, as equal ones share theirs.
SUFFIXES = 1 << 16
#: Bytes of suffixes compared with others at once.
COMPARED = 1 << 18
#: Anchors of a stretch; a longer copy takes several.
STRETCH = 128
BYTE_2 = T.seeds(256, 7)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values (block-wise prefix and suffix minima)."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


class Anchors:
    """The anchors of a batch of texts: row, position and end of the row's bytes, hash, block hashes, and the
    first and last window (as offsets from the anchor, 0 or less) that elected it."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, min_len: int, blocks: bool = True):
        reach = min_len - GRAM
        out: list[list[np.ndarray]] = []
        low = np.uint64((1 << BITS) - 1)
        for s in range(0, max(0, len(data) - min_len + 1), STEP):
            e = min(s + STEP, len(data) - min_len + 1)
            r0, r1 = max(0, s - reach), min(len(data), e + reach + min_len)
            up, down = T.powers(r1 - r0 + 1)
            total = np.zeros(r1 - r0 + 1, np.uint64)
            with np.errstate(over="ignore"):
                np.cumsum(T.BYTE[data[r0:r1]] * up[: r1 - r0], out=total[1:])
                q = s - r0
                n = e - s + reach
                gram = T.mix((total[q + GRAM : q + GRAM + n] - total[q : q + n]) * down[q : q + n])
            elected = (sliding_min((gram & ~low) | np.arange(n, dtype=np.uint64), reach + 1) & low).astype(np.int64)
            first, last = np.searchsorted(offs, s, "right") - 1, np.searchsorted(offs, e, "left")
            ends = np.clip(offs[first + 1 : last + 1], s, None)
            cuts = np.minimum(np.concatenate([[s], ends]), e)
            end_of = np.repeat(offs[first + 1 : last + 1], np.diff(cuts)[: last - first])
            valid = np.flatnonzero(np.arange(s, e) + min_len <= end_of)
            if not len(valid):
                continue
            chosen = elected[valid]
            new = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
            at = chosen[new] + s
            w0, w1 = valid[new] + s - at, valid[np.append(new[1:], len(valid)) - 1] + s - at
            columns = [at, gram[chosen[new]].view(np.int64), w0, w1]
            if blocks:
                row = np.searchsorted(offs, at, "right") - 1
                a, b = np.maximum(offs[row], at - reach), np.minimum(offs[row + 1], at + min_len)
                with np.errstate(over="ignore"):
                    shape = (at - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (b - a).astype(np.uint64)
                    columns.append(T.mix((total[b - r0] - total[a - r0]) * down[a - r0] + shape).view(np.int64))
                    np.cumsum(BYTE_2[data[r0:r1]] * up[: r1 - r0], out=total[1:])
                    columns.append(T.mix((total[b - r0] - total[a - r0]) * down[a - r0] + shape).view(np.int64))
            out.append(columns)
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 6
        again = np.zeros(len(columns[0]), bool)  # an anchor of two steps is met twice
        again[1:] = columns[0][1:] == columns[0][:-1]
        if again.any():
            columns[3][np.flatnonzero(again) - 1] = columns[3][again]
            columns = [c[~again] for c in columns]
        self.at, self.hash, self.first, self.last = columns[:4]
        self.block, self.block_2 = columns[4:6] if blocks else (None, None)
        self.row = np.searchsorted(offs, self.at, "right") - 1
        self.pos = self.at - offs[self.row]


def spans_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offs = T.buffers(batch["text"])
    for i, j in T.spans(offs, 4 * T.CHUNK):
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def neighbours(pos: np.ndarray, lcp: np.ndarray, least: int = 1) -> np.ndarray:
    """For suffixes in order with text positions ``pos`` and ``lcp`` with the one before: the LCP with the
    nearest one before in order that has a smaller position (0: none, or under ``least``). Links jump over links
    until all fit; as an LCP only shrinks on the way, those that share less than ``least`` have no need to go on."""
    before, shared = np.arange(len(pos)) - 1, np.where(lcp >= least, lcp, 0)
    shared[:1] = 0
    bad = np.flatnonzero(shared)
    while len(bad := bad[(shared[bad] > 0) & (pos[before[bad]] > pos[bad])]):
        over = before[bad]
        shared[bad] = np.minimum(shared[bad], shared[over])
        before[bad] = before[over]
    return shared


def longest_previous_factors(pos: np.ndarray, lcp: np.ndarray, least: int = 1) -> np.ndarray:
    """LPF of suffixes in order: the longest prefix that also starts at a smaller text position (0 if under ``least``)."""
    after = np.append(lcp[1:], 0)[::-1]
    return np.maximum(neighbours(pos, lcp, least), neighbours(pos[::-1], after, least)[::-1])


def common_prefixes(data: np.ndarray, x: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """The LCP, ``width`` at most, of the suffixes at x and at y. Suffixes that follow each other at one distance
    share their bytes (so an LCP is at most one shorter than that of the suffix before): each is compared once."""
    out = np.empty(len(x), np.int64)
    if not len(x):
        return out
    by = np.argsort((y - x) * (len(data) + 1) + x)
    x, apart = x[by], (y - x)[by]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(apart) != 0) | (np.diff(x) > width)]))
    last = np.append(first[1:], len(x))
    size = x[last - 1] + width - x[first]
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // COMPARED, prepend=-1)).tolist()
    for i, j in zip(cuts, [*cuts[1:], len(first)]):
        n, rows = size[i:j], slice(first[i], last[j - 1])
        shift = x[first[i:j]] - (np.cumsum(n) - n)
        at = np.arange(n.sum()) + np.repeat(shift, n)
        differs = np.append(np.flatnonzero(data[at] != data[at + np.repeat(apart[first[i:j]], n)]), len(at) + width)
        here = x[rows] - np.repeat(shift, last[i:j] - first[i:j])
        out[by[rows]] = np.minimum(differs[np.searchsorted(differs, here)] - here, width)
    return out


def suffix_order(data: np.ndarray, start: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes (``width`` bytes from ``start``, given by position) by group, bytes and position, and
    each one's LCP with the one before of its group (0 for the first)."""
    order = np.argsort(group, kind="stable")
    held = group[order]
    new = np.diff(held, prepend=-1) != 0
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(order)))
    more = np.flatnonzero(np.repeat(size > 2, size))
    if len(more):
        rows = np.lib.stride_tricks.sliding_window_view(data, width)[start[order[more]]]
        by = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
        order[more] = order[more][by[np.argsort(held[more][by], kind="stable")]]
    lcp = np.zeros(len(order), np.int64)
    rest = np.flatnonzero(~new)
    lcp[rest] = common_prefixes(data, start[order[rest - 1]], start[order[rest]], width)
    # the first byte that differs orders a group of two
    two = first[size == 2]
    two = two[lcp[two + 1] < width]
    x, y = order[two], order[two + 1]
    turned = data[start[y] + lcp[two + 1]] < data[start[x] + lcp[two + 1]]
    order[two[turned]], order[two[turned] + 1] = y[turned], x[turned]
    return order, lcp


OCCURRENCE = "doc_id long, h long, pos int, a long, b long, b2 long"
BLOCK = ["a", "b", "b2"]
SEGMENT = [*BLOCK, "later"]
SPANS = "array<struct<s:int,e:int>>"


def merged(s: np.ndarray, e: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping and touching spans (sorted by s) as one."""
    out: list[list[int]] = []
    for a, b in zip(s.tolist(), e.tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


class Repeats:
    """One run over ``documents`` (doc_id, text)."""

    def __init__(self, documents: DataFrame, min_len: int, keep_first: bool):
        self.texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
        self.spark, self.min_len, self.keep_first = documents.sparkSession, min_len, keep_first

    def counted(self) -> DataFrame:
        """Anchor hashes that stand more than once."""
        min_len = self.min_len

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [Anchors(data, offs, min_len, blocks=False).hash for _, _, data, offs in spans_of(batch)]
                a, n = np.unique(np.concatenate(found) if found else np.empty(0, np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n.astype(np.int32))], ["a", "n"])

        byte_batches(self.spark)
        return settle(self.texts.select("text").mapInArrow(count, "a long, n int").groupBy("a").agg(F.sum("n").alias("n")).where("n > 1").select("a"), "anchors")

    def occurrences(self) -> DataFrame:
        min_len = self.min_len

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, data, offs in spans_of(batch):
                    x = Anchors(data, offs, min_len)
                    row = pa.array(x.row)
                    yield pa.RecordBatch.from_arrays(
                        [batch["doc_id"][i:j].take(row), batch["h"][i:j].take(row), pa.array(x.pos.astype(np.int32)), pa.array(x.hash), pa.array(x.block), pa.array(x.block_2)],
                        ["doc_id", "h", "pos", *BLOCK],
                    )

        found = self.texts.select("doc_id", "h", "text").mapInArrow(find, OCCURRENCE)
        return settle(found.join(self.counted(), "a"), "occurrences")

    def asked_texts(self, asked: DataFrame) -> DataFrame:
        """doc_id, h, text and the list ``asked`` of all that is asked of the text (by doc_id, h)."""
        # plain columns of one form on both sides and no nulls: a text is shuffled once, for the grouping and the join
        by = (F.coalesce("doc_id", F.lit(0).cast("long")).alias("of"), F.isnull("doc_id").alias("no_id"), F.col("h"))
        keys = ["of", "no_id", "h"]
        lists = asked.select(*by, "asked").groupBy(*keys).agg(F.collect_list("asked").alias("asked"))  # at most the anchors of one text, twice
        # a row that repeats would give equal segments, and its second would make the first's windows copies
        once = self.texts.select(*by, "text").groupBy(*keys).agg(F.first("text").alias("text"))
        return once.join(lists, keys).select(F.when(~F.col("no_id"), F.col("of")).alias("doc_id"), "h", "text", "asked")

    def segments(self, blocks: DataFrame) -> DataFrame:
        """The first and the last occurrence of each block, of anchors with more than one such: its bytes and its windows."""
        min_len = self.min_len
        reach = min_len - GRAM
        # occurrences in one place are of repeated rows, which keep_first takes as one document
        twice = F.col("first") != F.col("last") if self.keep_first else F.col("n") > 1
        both = F.array(F.struct(F.lit(False).alias("later"), "first.*"), F.struct(F.lit(True).alias("later"), "last.*"))
        blocks = blocks.select(*BLOCK, F.when(twice, both).otherwise(F.slice(both, 1, 1)).alias("places"))
        several = settle(blocks.groupBy("a").agg(F.sum(F.size("places")).alias("n_blocks"), (F.count("*") == 1).alias("alone")).where("n_blocks > 1"), "several")
        hot = several.where(F.col("n_blocks") > GROUP)
        n = hot.count()  # an anchor's blocks aren't dealt out by the anchor where they are many
        asked = blocks.join(several.where(F.col("n_blocks") <= GROUP), "a")
        if n:
            asked = blocks.join(sized(hot.select("a"), n), "a", "left_anti").join(several, "a").unionByName(blocks.join(sized(hot, n), "a"))
        salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("n_blocks") / GROUP)).cast("int")
        # copies at one distance in one pair of texts; null where the anchor has other blocks
        one, two = F.col("places")[0], F.col("places")[1]
        link = F.when(F.col("alone"), F.xxhash64(one["doc_id"], one["h"], two["doc_id"], two["h"], two["pos"] - one["pos"]))
        asked = asked.select(*BLOCK, salt.alias("salt"), (F.col("n_blocks") > GROUP).alias("hot"), link.alias("link"), F.explode("places").alias("place"))
        once = self.asked_texts(asked.select("place.doc_id", "place.h", F.struct("place.pos", *BLOCK, "place.later", "salt", "hot", "link").alias("asked")))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch["asked"]
                n_asked = lists.value_lengths().to_numpy(zero_copy_only=False)
                asked_row = np.repeat(np.arange(batch.num_rows), n_asked)
                flat = lists.flatten()
                want_pos = flat.field("pos").to_numpy()
                later = flat.field("later").to_numpy(zero_copy_only=False)
                alone = flat.field("link").is_valid().to_numpy(zero_copy_only=False)
                link = flat.field("link").fill_null(0).to_numpy()
                for i, j, data, offs in spans_of(batch):
                    x = Anchors(data, offs, min_len, blocks=False)
                    mine = np.flatnonzero((asked_row >= i) & (asked_row < j))
                    if not len(mine):
                        continue
                    mine = mine[np.lexsort((want_pos[mine], later[mine], link[mine], alone[mine], asked_row[mine]))]
                    row, pos = asked_row[mine] - i, want_pos[mine].astype(np.int64)
                    at = offs[row] + pos
                    k = np.searchsorted(x.at, at)
                    # both sides of a copy part into stretches at the same anchors, as their distance is one
                    new = np.ones(len(mine), bool)
                    new[1:] = ~alone[mine[1:]] | (np.diff(row) != 0) | (np.diff(alone[mine]) != 0) | (link[mine[1:]] != link[mine[:-1]]) | (later[mine[1:]] != later[mine[:-1]])
                    new[1:] |= np.diff(pos) > reach + min_len
                    begin = np.flatnonzero(new)
                    new |= (np.arange(len(mine)) - np.repeat(begin, np.diff(np.append(begin, len(mine))))) % STRETCH == 0
                    begin = np.flatnonzero(new)
                    end = np.append(begin[1:], len(mine))
                    left, right = np.maximum(offs[row[begin]], at[begin] - reach), np.minimum(offs[row[begin] + 1], at[end - 1] + min_len)
                    blob = [data[l:r].tobytes() for l, r in zip(left, right)]
                    off = at - np.repeat(left, end - begin)
                    pick, head, doc = pa.array(mine), pa.array(mine[begin]), pa.array(asked_row[mine[begin]])
                    places = [pa.array(c.astype(np.int32)) for c in (off, x.first[k], x.last[k])]
                    anchors = pa.StructArray.from_arrays([*(flat.field(c).take(pick) for c in BLOCK), *places], [*BLOCK, "off", "w0", "w1"])
                    yield pa.RecordBatch.from_arrays(
                        [*(flat.field(c).take(head) for c in ("a", "later", "salt", "hot")), batch["doc_id"].take(doc), batch["h"].take(doc), pa.array(want_pos[mine[begin]]),
                         pa.ListArray.from_arrays(pa.array(np.append(begin, len(mine)).astype(np.int32)), anchors), pa.array(blob, pa.binary())],
                        ["a", "later", "salt", "hot", "doc_id", "h", "pos", "anchors", "bytes"],
                    )

        byte_batches(self.spark)
        kinds = "a long, later boolean, salt int, hot boolean, doc_id long, h long, pos int, anchors array<struct<a:long,b:long,b2:long,off:int,w0:int,w1:int>>, bytes binary"
        return settle(once.mapInArrow(cut, kinds), "segments")

    def covers(self, segments: DataFrame) -> DataFrame:
        """(a, b, b2, of_first, of_later): the spans of a block, from its anchor, that lie in repeated windows, in
        its first occurrence and in all later ones."""
        min_len, keep_first = self.min_len, self.keep_first
        byte_batches(self.spark)
        dealt = segments.repartition("a", "salt").sortWithinPartitions("a", "salt", "doc_id", "h", "pos", "later")
        found = settle(dealt.mapInArrow(bucket(min_len, keep_first), f"a long, b long, b2 long, later boolean, spans {SPANS}, open array<int>"), "covers")
        covers = found.where("size(spans) > 0").select(*SEGMENT, "spans")
        if not segments.where("hot").isEmpty():
            hot = segments.where("hot").select(F.inline("anchors"), "later", "doc_id", "h", "pos", "bytes")
            covers = covers.unionByName(self.across(hot.join(found.where("size(open) > 0").select(*SEGMENT, "open"), SEGMENT)))
        of = {name: F.flatten(F.collect_list(F.when(kind, F.col("spans")))).alias(name) for name, kind in (("of_first", ~F.col("later")), ("of_later", F.col("later")))}
        return covers.groupBy(*BLOCK).agg(*of.values())  # two lists of each at most

    def across(self, segments: DataFrame) -> DataFrame:
        """The spans of windows with an equal (earlier) one in another bucket of their anchor; ``open``: the
        windows (offsets) without an equal one before them in their own."""
        min_len = self.min_len

        def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for i in range(0, whole.num_rows, 512):
                    batch = whole.slice(i, 512)
                    data, offs = T.buffers(batch["bytes"])
                    n = batch["open"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                    seg, o = np.repeat(np.arange(len(n)), n), batch["open"].flatten().to_numpy().astype(np.int64)
                    at = offs[seg] + batch["off"].to_numpy().astype(np.int64)[seg] + o
                    keys = []
                    with np.errstate(over="ignore"):
                        up, down = T.powers(len(data) + 1)
                        for table in (T.BYTE, BYTE_2):
                            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[data] * up[: len(data)], dtype=np.uint64)])
                            keys.append(pa.array(T.mix((total[at + min_len] - total[at]) * down[at]).view(np.int64)))
                    pick = pa.array(seg)
                    yield pa.RecordBatch.from_arrays([*(batch[c].take(pick) for c in (*SEGMENT, "doc_id", "h", "pos")), pa.array(o.astype(np.int32)), *keys], [*SEGMENT, "doc_id", "h", "pos", "o", "f", "g"])

        rows = settle(segments.mapInArrow(suffixes, "a long, b long, b2 long, later boolean, doc_id long, h long, pos int, o int, f long, g long"), "windows")
        place = F.struct("doc_id", "h", "pos")
        same = rows.groupBy("a", "o", "f", "g").agg(F.count("*").alias("n"), F.min(place).alias("least")).where("n > 1")
        hits = rows.join(same, ["a", "o", "f", "g"])  # a window comes once from each bucket at most
        if self.keep_first:
            hits = hits.where(place != F.col("least"))
        return hits.groupBy(*SEGMENT).agg(F.collect_list(F.struct(F.col("o").alias("s"), (F.col("o") + min_len).alias("e"))).alias("spans"))  # at most one for each window of a block

    def spans(self) -> DataFrame:
        """of, of_h and the (unmerged) spans of each text that loses bytes."""
        found = self.occurrences()
        place = F.struct("doc_id", "h", "pos")
        blocks = settle(found.groupBy(*BLOCK).agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last")), "blocks")
        covers = self.covers(self.segments(blocks))
        # written down, so both sides of the next join are shuffled for it and a hot block's rows can be split
        known = settle(blocks.join(covers, BLOCK), "known")
        rows = found.join(known, BLOCK).withColumn("spans", F.when(place == F.col("first"), F.col("of_first")).otherwise(F.col("of_later"))).where("size(spans) > 0")
        moved = F.transform("spans", lambda x: F.struct((x["s"] + F.col("pos")).alias("s"), (x["e"] + F.col("pos")).alias("e")))
        rows = rows.select("doc_id", "h", moved.alias("spans"))
        return rows.groupBy(F.col("doc_id").alias("of"), F.col("h").alias("of_h")).agg(F.flatten(F.collect_set("spans")).alias("cuts"))  # at most the windows of one text, however often its row stands


def windows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the batch's segments, their anchors with the row of each, and of each window (``min_len``
    bytes) that elected an anchor its start, its anchor and its offset from that."""
    data, offs = T.buffers(batch["bytes"])
    of = np.repeat(np.arange(batch.num_rows), batch["anchors"].value_lengths().to_numpy(zero_copy_only=False))
    anchors = batch["anchors"].flatten()
    off, w0, w1 = (anchors.field(c).to_numpy().astype(np.int64) for c in ("off", "w0", "w1"))
    n = w1 - w0 + 1
    seg = np.repeat(np.arange(len(n)), n)
    o = w0[seg] + np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
    return data, anchors, of, offs[of[seg]] + off[seg] + o, seg, o


def bucket(min_len: int, keep_first: bool):
    """Suffix order and LPF over whole buckets of segments that share an anchor, some buckets at a time."""

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, anchors, of, start, seg, o = windows_of(batch)
        # equal windows have equal anchors at equal offsets: only those are put in order of bytes
        _, met, same = np.unique(anchors.field("a").to_numpy(), return_index=True, return_inverse=True)
        group = np.argsort(np.argsort(met))[same][seg] * min_len + o + min_len
        if len(seg) <= 2 * SUFFIXES:
            parts = [np.arange(len(seg))]
        else:
            by_offset = np.argsort(o, kind="stable")
            parts = np.split(by_offset, np.flatnonzero(np.diff(o[by_offset])) + 1)
        before, hits = [], []
        for part in parts:
            # segments stand in order of bucket, then place in the texts: so does each suffix within its group
            order, lcp = suffix_order(data, start[part], group[part], min_len)
            pos = part[order]
            hit = longest_previous_factors(pos, lcp, min_len) >= min_len
            before.append(pos[hit])
            if not keep_first:
                hit |= longest_previous_factors(-pos, lcp, min_len) >= min_len
            hits.append(pos[hit])
        hot = np.flatnonzero(batch["hot"].to_numpy(zero_copy_only=False)[of[seg]])
        open_ = np.setdiff1d(hot, np.concatenate(before)) if len(hot) else hot
        # an anchor's windows all overlap, as their offsets are less than min_len apart: so their union is one span
        hits = np.sort(np.concatenate(hits))
        first = np.flatnonzero(np.diff(seg[hits], prepend=-1))
        last = np.append(first[1:], len(hits))[: len(first)] - 1
        spans = pa.StructArray.from_arrays([pa.array(o[hits[first]].astype(np.int32)), pa.array((o[hits[last]] + min_len).astype(np.int32))], ["s", "e"])
        every = np.arange(len(of) + 1)
        lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(seg[x], every).astype(np.int32)), v) for x, v in ((hits[first], spans), (open_, pa.array(o[open_].astype(np.int32))))]
        return pa.RecordBatch.from_arrays([*(anchors.field(c) for c in BLOCK), batch["later"].take(pa.array(of)), *lists], [*SEGMENT, "spans", "open"])

    def solved(rows: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole buckets, of ``SUFFIXES`` suffixes or some more: each of a hot anchor by itself, as buckets of one
        anchor don't stand in the order of places."""
        hot = rows["hot"].to_numpy(zero_copy_only=False)[starts]
        lists = rows["anchors"]
        flat = lists.flatten()
        total = np.append(0, np.cumsum(flat.field("w1").to_numpy().astype(np.int64) - flat.field("w0").to_numpy() + 1))
        ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
        full = total[ends[starts]] // SUFFIXES
        cuts = starts[np.flatnonzero(hot | np.concatenate([[True], hot[:-1] | (full[1:] != full[:-1])]))]
        for i, j in zip(cuts, np.append(cuts[1:], rows.num_rows)):
            yield solve(rows.slice(i, j - i))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            rows = batch if held is None else pa.concat_batches([held, batch])
            if not rows.num_rows:
                continue
            a, salt = rows["a"].to_numpy(), rows["salt"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (salt[1:] != salt[:-1])]))
            if len(starts) > 1:
                yield from solved(rows.slice(0, starts[-1]), starts[:-1])
            held = rows.slice(starts[-1])
        if held is not None and held.num_rows:
            yield from solved(held, np.zeros(1, np.int64))

    return run


def cut_out(column: pa.Array, cuts: pa.Array) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """Each text's remaining bytes and the merged spans that went."""
    data, offs = T.buffers(column)
    for i in range(len(column)):
        text = data[offs[i] : offs[i + 1]].tobytes()
        spans = cuts[i].values
        if spans is None or not len(spans):
            yield text, []
            continue
        s, e = spans.field("s").to_numpy(), spans.field("e").to_numpy()
        s, e = np.maximum(s, 0), np.minimum(e, len(text))
        order = np.argsort(s, kind="stable")
        gone = merged(s[order], e[order])
        ends = [0, *(x[1] for x in gone)]
        yield b"".join(text[a:b] for a, b in zip(ends, [*(x[0] for x in gone), len(text)])), gone


def with_cuts(documents: DataFrame, min_len: int, keep_first: bool) -> tuple[DataFrame, str]:
    """``documents`` with a column of the spans to cut, null where nothing goes."""
    h, name, of, of_h = (fresh(documents, c) for c in ("text_hash", "cuts", "cut_of", "cut_of_hash"))
    spans = Repeats(documents, min_len, keep_first).spans().select(F.col("of").alias(of), F.col("of_h").alias(of_h), F.col("cuts").alias(name))
    rows = documents.withColumn(h, F.xxhash64(F.col("text").cast("string")))
    rows = rows.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.col(h) == F.col(of_h)), "left")
    byte_batches(documents.sparkSession)
    return rows.select(*documents.columns, name), name


def repeat_digest(documents: DataFrame, min_len: int = MIN_LEN, keep_first: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    rows, name = with_cuts(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), min_len, keep_first)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(len(left) + (gone := sum(b - a for a, b in spans)), gone, len(spans), hashlib.sha256(left).hexdigest()) for left, spans in cut_out(batch["text"], batch[name])]
            columns = list(zip(*got)) if got else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(documents: DataFrame, min_len: int = MIN_LEN, keep_first: bool = True) -> DataFrame:
    """The documents with repeated passages cut from their texts, with their own columns."""
    rows, name = with_cuts(documents, min_len, keep_first)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            old = batch.column(at)
            new = [left.decode("utf-8", "ignore") if spans else t.as_py() for t, (left, spans) in zip(old, cut_out(old, batch[name]))]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, old.type))

    changed = F.col(name).isNotNull()
    out = rows.mapInArrow(rewrite, rows.schema)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*documents.columns)
