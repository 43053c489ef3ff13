"""LM scoring by deleted interpolation.

A token's probability mixes three maximum-likelihood estimates: of the bigram, of the word and a
uniform one over V + 1 words, with weights that depend on how often the context word was seen
(log2 buckets). The weights are learned by expectation-maximisation: one fifth of the training rows
is deleted from the counts, and the mixture is fitted to the held-out bigrams under what is left.
Final scores use all training counts.

Counting and lookup work on packed keys. Documents are dealt into blocks of some MB by a hash; a
block sends each of its distinct words and bigrams (64-bit hashes) once, with its count, to the key's
bucket, as sorted differences. A bucket sums the counts of all blocks and answers each block's keys in
their order. So what is shuffled is at most one key for each block and word, a frequent word is no hot
key, and no count leaves the cluster: the driver sees N, V and a histogram of bounded size. A block
sends to at most 2^``FAN`` buckets; more buckets than that are reached in levels: a group of blocks sums
its messages for one range of keys first and passes them on, split by the next bits, and the answers
return the same way. So the messages grow with the blocks and not with blocks times buckets. The
blocks are read twice more: the held-out ones for the histogram of estimates that
expectation-maximisation runs on, and all of them for the scores.

Cases: a null or empty text is one end token; rows that repeat an id are all scored and all counted;
a null id belongs to no fold: it is learned from and not held out; with no training rows N and V are
0 and all words unknown; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import byte_batches, fold, settle

#: Text bytes of a block, and of all texts for each bucket of keys.
BLOCK_BYTES, BUCKET_BYTES = 12 << 20, 16 << 20
#: Bits of a key that one level of messages is split by, at most.
FAN = 10
#: Context buckets (0: unseen), and the histogram's grid: steps of 1 / GRID in log10 of a ratio to the uniform estimate.
CONTEXTS, GRID, STEPS = 24, 20, 60
KEEP, HELD, TEST = 0, 1, 2
END, BEGIN = T.seeds(2, 6)


def pack(values: np.ndarray) -> bytes:
    """64-bit values, plane by plane of their bytes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return len(values).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:], max_output_size=max(1, n * 8)), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys, as differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


class Block:
    """The tokens of one block's documents, gathered batch by batch."""

    def __init__(self, number: int):
        self.number, self.tokens, self.lengths, self.columns = number, [], [], []

    def add(self, batch: pa.RecordBatch, keep: tuple[str, ...] = ()) -> None:
        data, offs = T.buffers(batch["text"])
        for i, j in T.spans(offs, 4 * T.CHUNK):
            d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            starts, ends = T.edges(d, o)
            words, rows = T.word_hashes(d, starts, ends), T.row_of(o, starts)
            n = np.bincount(rows, minlength=j - i)
            after = np.cumsum(n)
            self.tokens.append(np.insert(words, after, END))
            self.lengths.append(n + 1)
        self.columns.append([batch[c] for c in keep])

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Each token's key and its bigram's; the first token's context is BEGIN."""
        tokens = np.concatenate(self.tokens) if self.tokens else np.empty(0, np.uint64)
        self.n_tokens = np.concatenate(self.lengths) if self.lengths else np.empty(0, np.int64)
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        self.first = np.cumsum(self.n_tokens) - self.n_tokens
        before[self.first] = BEGIN
        with np.errstate(over="ignore"):
            return tokens, T.mix(before * np.uint64(0x9E3779B97F4A7C15) + tokens)


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows of one block within each batch."""
    for batch in batches:
        numbers = batch["block"].to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1], [True]])) if len(numbers) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield int(numbers[a]), batch.slice(a, b - a)


MESSAGE = "child int, bucket int, kind int, keys binary, kept binary, held binary"
STATS = ["v_kept", "n_kept", "v", "n"]
ANSWER = "child int, bucket int, kind int, kept binary, held binary, " + ", ".join(f"{c} long" for c in STATS)


def message_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 3 + [pa.binary()] * 3
    columns = list(zip(*rows)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["child", "bucket", "kind", "keys", "kept", "held"])


def answer_batch(rows: list[tuple], stats: list[int] | None = None) -> pa.RecordBatch:
    kinds = [pa.int32()] * 3 + [pa.binary()] * 2
    rows = rows if stats is None else [*rows, (-1, 0, 0, None, None)]
    columns = list(zip(*rows)) if rows else [[]] * 5
    zeros = [0] * (len(rows) - (stats is not None))
    return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), *(pa.array(zeros + ([] if stats is None else [x]), pa.int64()) for x in stats or [0] * 4)], ["child", "bucket", "kind", "kept", "held", *STATS])


def split(child: int, kind: int, keys: np.ndarray, kept: np.ndarray, held: np.ndarray, bits: int) -> list[tuple]:
    """Messages for ascending keys, one for each run of equal top ``bits`` bits."""
    top = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1], [True]])) if len(keys) else []
    return [(child, int(top[i]), kind, pack_keys(keys[i:j]), pack(kept[i:j]), pack(held[i:j])) for i, j in zip(cuts[:-1], cuts[1:])]


def asker(bits: int, n_blocks: int):
    """Sends each block's distinct keys, with counts, to the keys' buckets (their top ``bits`` bits)."""

    def send(block: Block) -> pa.RecordBatch:
        rows = []
        for kind, keys in enumerate(block.keys()):
            found, n = np.unique(keys, return_counts=True)
            none = np.zeros(len(n), np.int64)
            part = block.number // n_blocks
            rows += split(block.number, kind, found, n if part == KEEP else none, n if part == HELD else none, bits)
        return message_batch(rows)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for number, rows in blocks_of(batches):
            if block is not None and block.number != number:
                yield send(block)
                block = None
            block = block or Block(number)
            block.add(rows)
        if block is not None:
            yield send(block)

    return ask


class Sums:
    """The keys of messages for one bucket, and their counts over all of them."""

    def __init__(self, messages: list[tuple]):
        keys = [unpack_keys(m[3]) for m in messages]
        self.cuts = np.cumsum([0, *map(len, keys)])
        self.keys, self.at = np.unique(np.concatenate(keys) if keys else np.empty(0, np.uint64), return_inverse=True)
        self.kept, self.held = np.zeros(len(self.keys), np.int64), np.zeros(len(self.keys), np.int64)
        for m, a, b in zip(messages, self.cuts[:-1], self.cuts[1:]):
            self.kept[self.at[a:b]] += unpack(m[4]).astype(np.int64)  # a message has a key once
            self.held[self.at[a:b]] += unpack(m[5]).astype(np.int64)

    def answers(self, messages: list[tuple], kept: np.ndarray, held: np.ndarray) -> list[tuple]:
        """The given counts of all keys, as each message asks for them."""
        return [(*m[:3], pack(kept[self.at[a:b]]), pack(held[self.at[a:b]])) for m, a, b in zip(messages, self.cuts[:-1], self.cuts[1:])]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple]]]:
    """(place, kind, rows) of rows sorted by place and kind; place is the first column."""
    now, rows = None, []
    for batch in batches:
        for place, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (place, row[2]):
                if rows:
                    yield (*now, rows)
                now, rows = (place, row[2]), []
            rows.append(tuple(row))
    if rows:
        yield (*now, rows)


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums a bucket's counts over all blocks and answers each message; the words' buckets report sizes, too."""
    for _, kind, rows in grouped(batches):
        sums = Sums(rows)
        kept, both = sums.kept, sums.kept + sums.held
        stats = [int(x) for x in (np.count_nonzero(kept), kept.sum(), np.count_nonzero(both), both.sum())] if kind == 0 else [0] * 4
        yield answer_batch(sums.answers(rows, sums.kept, sums.held), stats)


def pass_on(groups: int, bits: int):
    """Sums the messages of one group of blocks for one range of keys and splits them by more bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, kind, rows in grouped(batches):
            sums = Sums(rows)
            yield message_batch(split(place % groups, kind, sums.keys, sums.kept, sums.held, bits))

    return run


def hand_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers the messages of one group of blocks from the answers to the group's own messages."""
    for _, _, rows in grouped(batches):
        asked, got = [r for r in rows if r[3] is not None], sorted((r for r in rows if r[3] is None), key=lambda r: r[1])
        sums = Sums(asked)
        kept, held = (np.concatenate([unpack(r[c]) for r in got]) for c in (4, 5))
        if len(kept) != len(sums.keys):
            raise RuntimeError(f"asked for {len(sums.keys)} keys and got {len(kept)}: the messages changed between two reads")
        yield answer_batch(sums.answers(asked, kept, held))


def counted(messages: DataFrame, n_children: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(answers to the messages of ``n_children`` blocks, the sizes' parts) over 2^bits buckets, in as many levels as FAN asks for."""
    levels = -(-bits // FAN)
    step = -(-bits // levels)
    bits = step * levels
    dealt = lambda df, groups, shift=0: df.withColumn("place", (F.shiftright("bucket", shift) * groups + F.col("group")).cast("int"))
    columns = ["child", "bucket", "kind", "keys", "kept", "held"]
    sent, spans = [], []
    for level in range(1, levels):
        groups = 1 << (bits - step * level)
        span = -(-n_children // groups)
        messages = settle(dealt(messages.withColumn("group", F.floor(F.col("child") / span).cast("int")), groups), "messages")
        sent.append(messages), spans.append(groups)
        rows = messages.select("place", *columns).repartitionById(1 << bits, F.col("place")).sortWithinPartitions("place", "kind", "child")
        messages, n_children = rows.mapInArrow(pass_on(groups, step * (level + 1)), MESSAGE), groups
    rows = messages.select(F.col("bucket").alias("place"), *columns).repartitionById(1 << bits, F.col("place")).sortWithinPartitions("place", "kind", "child")
    answers = settle(rows.mapInArrow(answer, ANSWER), "answers")
    sizes = answers.where("child < 0")
    answers = answers.where("child >= 0")
    for messages, groups in zip(sent[::-1], spans[::-1]):
        known = dealt(answers.withColumn("group", F.col("child")), groups, step).withColumn("keys", F.lit(None).cast("binary"))
        rows = messages.select("place", *columns).unionByName(known.select("place", *columns)).repartitionById(1 << bits, F.col("place")).sortWithinPartitions("place", "kind", "child", "bucket")
        answers = settle(rows.mapInArrow(hand_back, ANSWER), "answers")
    return answers, sizes


class Sizes:
    """N and V of all training rows and of those kept when the held-out fold is deleted."""

    def __init__(self, v_kept: int, n_kept: int, v: int, n: int):
        self.v_kept, self.n_kept, self.v, self.n = v_kept, n_kept, v, n


def estimates(block: Block, answers: list[list[tuple[bytes, bytes]]], kept_only: bool, n: int, v: int):
    """Of each token: its count, the context's bucket and the three estimates."""
    counts = []
    for keys, blobs in zip(block.keys(), answers):
        found, at = np.unique(keys, return_inverse=True)
        kept, held = (np.concatenate([unpack(b[i]) for b in blobs]).astype(np.int64) if blobs else np.empty(0, np.int64) for i in (0, 1))
        if len(kept) != len(found):
            raise RuntimeError(f"block {block.number} asked for {len(kept)} keys and now has {len(found)}: its rows changed between two reads")
        counts.append((kept if kept_only else kept + held)[at])
    word, pair = counts
    context = np.empty_like(word)
    context[1:] = word[:-1]
    ends = block.first + block.n_tokens - 1
    context[block.first] = word[ends]  # as many texts begin as end
    bucket = np.minimum(np.frexp(context.astype(float))[1], CONTEXTS - 1)
    return word, bucket, pair / np.maximum(context, 1), word / max(n, 1), 1.0 / (v + 1)


def with_answers(batches: Iterator[pa.RecordBatch], keep: tuple[str, ...] = ()) -> Iterator[tuple[Block, list[list[tuple[bytes, bytes]]]]]:
    """Each block with its answers, which come before its documents."""
    block, answers = None, None
    for number, rows in blocks_of(batches):
        if block is None or block.number != number:
            if block is not None:
                yield block, answers
            block, answers = Block(number), [[], []]
        is_doc = rows["is_doc"].to_numpy(zero_copy_only=False)
        n = int(np.count_nonzero(~is_doc))
        for kind, *counts in zip(*(rows[c].slice(0, n).to_pylist() for c in ("kind", "kept", "held"))):
            answers[kind].append(tuple(counts))
        if n < len(is_doc):
            block.add(rows.slice(n), keep)
    if block is not None:
        yield block, answers


def cells(sizes: Sizes):
    """The histogram of held-out tokens over (context bucket, word estimate, bigram estimate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, answers in with_answers(batches):
            _, bucket, p2, p1, p0 = estimates(block, answers, True, sizes.n_kept, sizes.v_kept)
            grid = [np.where(p > 0, np.round(np.log10(np.maximum(p, 1e-300) / p0) * GRID) + 1000, 0).astype(np.int64) for p in (p1, p2)]
            found, n = np.unique((bucket.astype(np.int64) << 32) | (grid[0] << 16) | grid[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["cell", "n"])

    return run


def learn_weights(cell: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Expectation-maximisation for each context bucket: weights of (bigram, word, uniform).
    A bucket without held-out tokens takes its lower neighbour's; the unseen context has no bigram estimate."""
    ratio = lambda g: np.where(g > 0, 10.0 ** ((g - 1000) / GRID), 0.0)
    parts = np.column_stack([ratio(cell & 0xFFFF), ratio((cell >> 16) & 0xFFFF), np.ones(len(cell))])
    bucket = cell >> 32
    weights = np.empty((CONTEXTS, 3))
    last = np.array([0.0, 0.9, 0.1])
    for b in range(CONTEXTS):
        mine = bucket == b
        w = np.array([0.0, 0.9, 0.1]) if b == 0 else np.array([0.3, 0.6, 0.1])
        if mine.any():
            p, count = parts[mine], n[mine].astype(float)
            for _ in range(STEPS):
                share = p * w
                share /= share.sum(axis=1, keepdims=True)
                w = count @ share + np.array([0.0 if b == 0 else 1e-3, 1e-3, 1e-3])
                w /= w.sum()
            last = w
        weights[b] = last
    return weights


def scorer(sizes: Sizes, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, answers in with_answers(batches, ("doc_id", "held_out")):
            word, bucket, p2, p1, p0 = estimates(block, answers, False, sizes.n, sizes.v)
            if not len(word):
                continue
            w = weights[bucket]
            score = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)
            base = np.log10((word + 0.5) / (sizes.n + 0.5 * (sizes.v + 1)))
            total = lambda x: np.add.reduceat(x, block.first)  # noqa: E731  every document has a token
            ids, held = (pa.concat_arrays([c[k] for c in block.columns]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [ids, held, pa.array(block.n_tokens), pa.array(total((word > 0).astype(np.int64))), pa.array(np.full(len(ids), sizes.n)), pa.array(total(base)), pa.array(total(score))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def score_texts(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = documents.sparkSession
    part = fold(F.col("doc_id"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("part", F.when(part == 1, TEST).when(part == 0, HELD).otherwise(KEEP)).withColumn("held_out", F.col("part") == TEST)
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 1
    n_blocks = max(1, -(-size // (2 * BLOCK_BYTES)))  # of each part; the kept one has three fifths
    bits = max(2, int(-(-size // BUCKET_BYTES)).bit_length())
    rows = rows.withColumn("block", (F.col("part") * n_blocks + F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks))).cast("int"))
    dealt = 3 * n_blocks  # each block is a partition of its own, so what a task reads stays the same at any size
    byte_batches(spark)
    asked = rows.select("block", "text").repartitionById(dealt, F.col("block"))
    asked = asked.mapInArrow(asker(-(-bits // -(-bits // FAN)), n_blocks), MESSAGE)
    answers, parts = counted(asked, dealt, bits)
    sizes = Sizes(*(x or 0 for x in parts.agg(*(F.sum(c) for c in STATS)).first()))
    answers = answers.select(F.col("child").alias("block"), F.lit(False).alias("is_doc"), "kind", "bucket", "kept", "held")

    def met(docs: DataFrame, known: DataFrame) -> DataFrame:
        both = docs.select("block", F.lit(True).alias("is_doc"), "doc_id", "held_out", "text").unionByName(known, allowMissingColumns=True)
        return both.repartitionById(dealt, F.col("block")).sortWithinPartitions("is_doc", "kind", "bucket")

    held = met(rows.where(F.col("part") == HELD), answers.where(f"block >= {HELD * n_blocks} AND block < {TEST * n_blocks}"))
    got = held.mapInArrow(cells(sizes), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().sort_by("cell")
    weights = learn_weights(got["cell"].to_numpy(), got["n"].to_numpy())
    return met(rows, answers).mapInArrow(
        scorer(sizes, weights), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
