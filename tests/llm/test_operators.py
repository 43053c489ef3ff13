"""The training-data operators against brute force, and on odd inputs."""

import hashlib
import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from karstflow.llm import chat, decontaminate, language_model, near_dedup, quality, sentence_pieces, suffix_dedup, text, topk, toxicity, url_rules
from karstflow.llm.queries import RULES

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = DOC + ", of long, matches int, cuts string, text_hash long, p_toxic string, piece_ids string, gone_id long, round_trip int, cut_of string"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "so", "ta", "vi") for b in ("ba", "do", "fe", "gi", "hu", "jo", "ki", "la")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Null, empty, blank, short, long, repeated, near-repeated, multi-byte and periodic texts."""
    rng = random.Random(1)
    base = sentence(rng, 120)
    near = base.split()
    near[60] = "CHANGED"
    passage = sentence(rng, 45)
    out = [None, "", "  \n\t ", "one", "One", "two words", base, base, " ".join(near), base.upper(), sentence(rng, 3000), "é😀 " * 90, "x" * 900, "ab" * 300]
    out += [sentence(rng, 20) + " " + passage + " " + sentence(rng, 20) for _ in range(4)] + [passage]
    return out + [sentence(rng, rng.randint(3, 80)) for _ in range(25)]


@pytest.fixture(scope="module")
def documents(spark, texts):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[6], (None, texts[6], None, None, None), (None, "alone in the world with no id", None, None, None), (3, "another text of the same id", "en", "s", 5)]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def odd(spark, documents):
    """The documents with extra columns that have the operators' own column names."""
    out = documents
    for c in ODD.split(", ")[5:]:
        from pyspark.sql import functions as F

        name, kind = c.split()
        out = out.withColumn(name, F.lit("7").cast(kind))
    return out


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


# ---- kernels ----


def test_word_kernels_cut_like_the_rule(texts):
    data, offs = text.buffers(pa.array(texts))
    starts, ends = text.edges(data, offs)
    rows = text.row_of(offs, starts)
    got = [[] for _ in texts]
    for s, e, r in zip(starts, ends, rows):
        got[r].append(bytes(data[s:e]).decode())
    assert [[w.lower() if w.isascii() else w for w in g] for g in got] == [[w for w in words(t)] for t in texts]
    hashes = text.word_hashes(data, starts, ends)
    flat = [w for t in texts for w in words(t)]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


def test_lpf_against_brute_force():
    rng = random.Random(2)
    for _ in range(30):
        t = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60)))
        sa = sorted(range(len(t)), key=lambda i: t[i:])
        lcp = [0] + [next((k for k in range(len(t)) if t[a + k : a + k + 1] != t[b + k : b + k + 1] or a + k >= len(t) or b + k >= len(t)), 0) for a, b in zip(sa, sa[1:])]
        got = suffix_dedup.longest_previous_factors(np.array(sa), np.array(lcp))
        for p, v in zip(sa, got):
            want = max((k for q in range(p) for k in range(len(t) - p + 1) if t[q : q + k] == t[p : p + k] and q + k <= len(t)), default=0)
            assert v == want


def test_suffix_order_in_groups_against_brute_force(monkeypatch):
    """Groups of one, two and more suffixes; LCPs along runs of one distance, in pieces of any size, and short ones left out."""
    rng = random.Random(5)
    for n in range(60):
        monkeypatch.setattr(suffix_dedup, "COMPARED", rng.choice([1, 50, 1 << 18]))
        t = bytes(rng.choice(b"a\0") for _ in range(30)) * rng.randint(1, 3) + bytes(rng.choice(b"ab") for _ in range(60))
        data, width = np.frombuffer(t, np.uint8), rng.randint(1, 16)
        start = np.array(sorted(rng.sample(range(len(t) - width + 1), rng.randint(0, 60))), dtype=np.int64)
        group = np.array([rng.randrange(rng.choice([1, 20, 60])) for _ in start], dtype=np.int64)
        want = sorted(range(len(start)), key=lambda i: (group[i], t[start[i] : start[i] + width], i))
        shared = [0] * len(want)
        for k in range(1, len(want)):
            x, y = want[k - 1 : k + 1]
            if group[x] == group[y]:
                shared[k] = next((i for i in range(width) if t[start[x] + i] != t[start[y] + i]), width)
        order, lcp = suffix_dedup.suffix_order(data, start, group, width)
        assert order.tolist() == want and lcp.tolist() == shared
        whole = suffix_dedup.longest_previous_factors(order, lcp)
        for least in (1, 2, width):
            assert np.array_equal(suffix_dedup.longest_previous_factors(order, lcp, least), np.where(whole >= least, whole, 0))


def test_copies_are_compared_once():
    """Two long copies: the suffix order reads their bytes a few times, not ``width`` bytes for each suffix."""

    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                Counted.read += key.size
            return np.asarray(self)[key]

    copy = np.random.default_rng(6).integers(97, 123, 5000).astype(np.uint8)
    start = np.arange(4801)
    data = np.concatenate([copy, copy]).view(Counted)
    order, lcp = suffix_dedup.suffix_order(data, np.concatenate([start, start + 5000]), np.concatenate([start, start]), 200)
    assert np.array_equal(order[::2] + 4801, order[1::2]) and lcp[1::2].tolist() == [200] * 4801 and not lcp[::2].any()
    assert Counted.read <= 4 * len(data)


def test_myers_against_brute_force():
    def least(item, window):
        row = [0] * (len(window) + 1)
        for i, a in enumerate(item, 1):
            new = [i]
            for j, b in enumerate(window, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
            row = new
        return min(row)

    rng = random.Random(3)
    for _ in range(200):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 20)))
        window = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
        assert decontaminate.best_distance(item, window, 5) == min(6, least(item, window))


def test_kernels_in_steps(monkeypatch):
    """Texts longer than the kernels' chunks give the hashes, shingle sets and anchors of a run in one piece."""
    rng = random.Random(16)
    texts = [sentence(rng, n) for n in (700, 3, 900, 0, 400)] + ["é" * 3000, "word" * 2000 + " end"]
    data, offs = text.buffers(pa.array(texts))
    starts, ends = text.edges(data, offs)

    def found():
        out = [text.word_hashes(data, starts, ends), sentence_pieces.exact_hashes(data, starts, ends), *near_dedup.sets_of(data, offs)]
        x = suffix_dedup.Anchors(data, offs, 200)
        return [*out, x.at, x.hash, x.first, x.last, x.block, x.block_2, x.row, x.pos]

    whole = found()
    for chunk, step in ((512, 150), (100, 1000), (4096, 333)):
        monkeypatch.setattr(text, "CHUNK", chunk)
        monkeypatch.setattr(suffix_dedup, "STEP", step)
        assert all(np.array_equal(a, b) for a, b in zip(whole, found()))
    monkeypatch.undo()
    parts = [language_model.Block(0), language_model.Block(0)]
    parts[0].add(pa.RecordBatch.from_pydict({"text": texts}))
    for t in texts:
        parts[1].add(pa.RecordBatch.from_pydict({"text": [t]}))
    assert all(np.array_equal(a, b) for a, b in zip(*(p.keys() for p in parts)))


# ---- op 1 ----


def test_sentence_pieces(spark, documents, empty, texts):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    more = ["日本語テキスト\n\n  a   b", "x" * 700, "▁mark ▁▁", " lead", "trail ", "don't (a[0]) => {b}", "\u0000\u0001", "a" + "é" * 300]
    model = sentence_pieces.transducer()
    data, offs = text.buffers(sentence_pieces.without_marks(pa.array(more)))
    ids, cuts = model.encode(data, offs)
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == library.encode(more)
    rows = sentence_pieces.encode_texts(documents).collect()
    assert len(rows) == documents.count() and all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in rows)
    by_id = {r.doc_id: list(r.piece_ids) for r in rows if r.doc_id not in (None, 3)}
    assert by_id == {i: library.encode(texts[i] or "") for i in by_id}
    encoded = spark.createDataFrame([(r.doc_id, list(r.piece_ids)) for r in rows] + [(99, None)], "doc_id long, piece_ids array<int>")
    back = {(r.doc_id, r.text) for r in sentence_pieces.decode_texts(encoded).collect()}
    assert back == {(r.doc_id, r.text or "") for r in documents.collect()} | {(99, "")}
    assert sentence_pieces.encode_texts(empty).count() == 0


def small_unigram(path, rule, fallback):
    """A unigram model of our own: pieces of the public vocabulary with scores by a rule, one character only within longer pieces."""
    import public_tokenizers
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model, source = proto.ModelProto(), proto.ModelProto()
    source.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    rng = random.Random(14)
    for p in source.pieces:
        if p.type == 1 and (p.piece in ("q", "é") or not rng.random() < 0.7 and len(p.piece) > 1):
            continue
        if p.type == 6 and not fallback:
            continue
        new = model.pieces.add()
        new.piece, new.type, new.score = p.piece, p.type, -rng.uniform(2, 6) - 1.1 * len(p.piece) ** 0.5 if p.type == 1 else 0.0
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback, model.trainer_spec.unk_id = 1, fallback, 0
    model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.escape_whitespaces = True, True
    model.normalizer_spec.remove_extra_whitespaces = rule is not None
    if rule:
        spec = proto.NormalizerSpec()
        spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
        model.normalizer_spec.precompiled_charsmap, model.normalizer_spec.name = spec.precompiled_charsmap, rule
    path.write_bytes(model.SerializeToString())
    return str(path)


@pytest.mark.parametrize("rule,fallback", [(None, True), ("nmt_nfkc", True), ("nmt_nfkc_cf", False)])
def test_unigram_models(spark, tmp_path, rule, fallback):
    """The library's ids, where the shortest path has many to choose from and a character map rewrites the text."""
    import sentencepiece

    path = small_unigram(tmp_path / "own.model", rule, fallback)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(15)
    cases = ["international questions, queue", "  Two   blanks ", "ﬁne ＡＢＣ ①② ｶﾞ か\u3099 e\u0301tude é", "tab\there\u3000wide", "", " ", None, "▁mark ▁", "😀😀 q", "don't stop", "x" * 300 + " end", "Straße İstanbul", "a\u200bb\u00adc"]
    cases += [" ".join(rng.choice(["quality", "Encoding", "theory", "été", "naïve", "12345", "ｆｕｌｌ", "ﬂow", "unquestionable", "日本語"]) for _ in range(12)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string").repartition(2)
    rows = {r.doc_id: r for r in sentence_pieces.encode_texts(docs, path).collect()}
    assert {i: list(r.piece_ids) for i, r in rows.items()} == {i: library.encode(t or "") for i, t in enumerate(cases)}
    back = {r.doc_id: r.text for r in sentence_pieces.decode_texts(sentence_pieces.encode_texts(docs, path), path).collect()}
    assert all(rows[i].round_trip == (back[i] == (t or "")) for i, t in enumerate(cases))
    assert rows[7].round_trip is False and rows[9].round_trip is True


# ---- op 2 ----


@pytest.mark.parametrize("fan", [10, 1])
def test_language_model(documents, empty, monkeypatch, fan):
    """Counts, base and interpolated scores by brute force; buckets reached at once and in levels."""
    monkeypatch.setattr(language_model, "FAN", fan)
    monkeypatch.setattr(language_model, "BUCKET_BYTES", 4096)
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 4096)
    learned, learn = [], language_model.learn_weights
    monkeypatch.setattr(language_model, "learn_weights", lambda *x: learned.append(learn(*x)) or learned[-1])
    rows = language_model.score_texts(documents).collect()
    docs = documents.collect()
    assert Counter(r.doc_id for r in rows) == Counter(d.doc_id for d in docs)
    part = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 5
    train = [[None, *words(d.text), 0] for d in docs if part(d.doc_id) != 1]
    counts, pairs = Counter(w for t in train for w in t[1:]), Counter(p for t in train for p in zip(t, t[1:]))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for d in docs:
        tokens = [None, *words(d.text), 0]
        score = 0.0
        for a, b in zip(tokens, tokens[1:]):
            before = counts[0] if a is None else counts[a]
            w = learned[0][min(before.bit_length(), language_model.CONTEXTS - 1)]
            score += math.log10(w[0] * pairs[a, b] / max(before, 1) + w[1] * counts[b] / n + w[2] / (v + 1))
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens[1:])
        want[d.doc_id, part(d.doc_id) == 1, len(tokens) - 1, sum(counts[t] > 0 for t in tokens[1:]), n, round(base, 6), round(score, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in rows) == want
    assert language_model.score_texts(empty).count() == 0


def test_large_counts_stay_apart():
    """Kept and held counts of more than 32 bits don't run into each other."""
    keys = np.array([5, 9, 1 << 63], np.uint64)
    kept, held = np.array([1 << 33, 0, 7]), np.array([3, 1 << 34, 0])
    rows = language_model.split(0, 0, keys, kept, held, 2) + language_model.split(1, 0, keys[:2], kept[:2], held[:2], 2)
    sums = language_model.Sums([r for r in rows if r[1] == 0])
    assert sums.kept.tolist() == [1 << 34, 0] and sums.held.tolist() == [6, 1 << 35]
    got = sums.answers([r for r in rows if r[1] == 0], sums.kept, sums.held)
    assert [language_model.unpack(x[3]).tolist() for x in got] == [[1 << 34, 0]] * 2


def test_mixture_is_a_distribution():
    """EM's weights add up to 1, favour the estimate that explains the tokens, and give the unseen context no bigram."""
    cell = np.array([(0 << 32) | (1060 << 16) | 0, (3 << 32) | (1000 << 16) | 1080])
    w = language_model.learn_weights(cell, np.array([100, 100]))
    assert np.allclose(w.sum(axis=1), 1) and w[0, 0] == 0 and w[0, 1] > 0.9 and w[3, 0] > 0.9


# ---- op 3 and 8 ----


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        toxic, junk = int(i % 4 == 0), int(i % 3 == 0)
        t = sentence(rng, 40) if not junk else (rng.choice(WORDS).upper() + "!! ") * 40
        docs.append((i, t + (" " + " ".join(rng.choice(["vile", "wretch", "vilest"]) for _ in range(3)) if toxic else ""), "en", "s", 1))
        labels.append((i, 1 - junk, toxic))
    labels += [(None, 1, 1), (1000, None, 1), (1001, 5, 0), (5, 1, 0)]
    return spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, labelled, documents, empty):
    docs, labels = labelled
    rows = toxicity.score_toxicity(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 400 and len(held) > 40 and sum(r.toxic != (r.doc_id % 4 == 0) for r in held) <= 1
    kept = toxicity.keep_clean(odd(spark, docs), labels)
    assert kept.columns == odd(spark, docs).columns and 285 <= kept.count() <= 305
    assert toxicity.score_toxicity(documents, labels).count() == documents.count()
    assert toxicity.score_toxicity(documents, labels.limit(0)).where("toxic").count() == 0
    assert toxicity.score_toxicity(empty, labels).count() == 0


def test_chain_against_a_scalar_walk(labelled, texts):
    """Each link's logistic model worked out feature by feature, with the earlier links' probabilities."""
    docs, labels = labelled
    chain = toxicity.train(docs, labels, toxicity.label_categories())
    cases = [t for t in texts] + [r.text for r in docs.limit(40).collect()]
    got = chain(pa.RecordBatch.from_pydict({"text": pa.array(cases)}))

    def places(t):
        out = set()
        for w in words(t):
            raw = w.encode()
            for k, n in enumerate((0, *toxicity.BEGINNINGS)):
                if not n or len(raw) > n:
                    data = np.frombuffer(raw[:n] if n else raw, np.uint8)
                    h = text.word_hashes(data, np.array([0]), np.array([len(data)]))
                    with np.errstate(over="ignore"):
                        out.add(int(text.mix(h + np.uint64(k))[0]) >> 44)
        return out

    for t, row in zip(cases, got):
        mine, earlier = places(t), []
        for model, p in zip(chain.models, row):
            weights = dict(zip(model.places.tolist(), model.weights.tolist()))
            z = model.intercept + sum(weights.get(x, 0.0) for x in mine) + sum(a * b for a, b in zip(model.earlier, earlier))
            assert abs(1 / (1 + math.exp(-max(-30, min(30, z)))) - p) < 1e-5
            earlier.append(p)
    assert len(chain.models[1].earlier) == 1 and chain.models[1].earlier[0] != 0


def test_trees_against_a_scalar_walk():
    rng = np.random.default_rng(17)
    x = rng.normal(size=(600, 6)).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] * x[:, 2] > 0.2)).astype(float)
    trees = quality.fit(x, y)
    want = []
    for row in x:
        z = trees.base
        for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            while node < 2**quality.DEPTH - 1:
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            z += value[node - (2**quality.DEPTH - 1)]
        want.append(1 / (1 + math.exp(-z)))
    got = trees.score(x)
    assert np.allclose(got, want) and ((got > 0.5) == y).mean() > 0.9


def test_quality(labelled, documents, empty):
    docs, labels = labelled
    held = [r for r in quality.score_quality(docs, labels).collect() if r.held_out]
    assert len(held) > 40 and sum(r.predicted != (r.doc_id % 3 != 0) for r in held) <= 1
    odd_rows = quality.score_quality(documents, labels).collect()
    assert len(odd_rows) == documents.count() and all(0 <= r.score <= 1 for r in odd_rows)
    assert quality.score_quality(documents, labels.limit(0)).select("score").distinct().count() == 1
    assert quality.score_quality(empty, labels).count() == 0


# ---- op 4 ----


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.choice([-0.5, 0.0, 0.0, 0.25], size=6)]) for i in range(60)]
    rows += [(100, None), (101, [1.0, None]), (102, [float("nan")]), (103, [float("inf")]), (104, []), (105, [2.0]), (40, rows[7][1]), (None, [1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), topk.F.col("vec_id") % 20 == 0, k=5).collect()
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for i, q in whole:
        if i % 20 == 0:
            best = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i))[:5]
            want.update((i, n, j, -s) for n, (s, j) in enumerate(best, 1))
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), topk.F.col("vec_id") % 20 == 0).count() == 0


def nearest(rows, k):
    """Brute force: (query's id, rank, id, score) for ids divisible by 4."""
    out = Counter()
    for i, q in rows:
        if i % 4 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i)[:k]
            out.update((i, n, j, -s) for n, (s, j) in enumerate(found, 1))
    return out


def test_top_k_scans(spark, monkeypatch):
    """Queries of several scans: vectors of several lengths, many ties, repeated ids and rows."""
    monkeypatch.setattr(topk, "QUERY_CELLS", 60)
    rng = random.Random(6)
    rows = [(rng.randrange(40), [rng.choice([-1, 0, 0, 1]) / 64 for _ in range(rng.choice([0, 3, 9]))]) for _ in range(120)]
    rows += rows[:30]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), topk.F.col("vec_id") % 4 == 0, k=4).collect()
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == nearest([(i, [int(64 * x) for x in v]) for i, v in rows], 4)


@pytest.mark.parametrize("large", [1, 3000, 1 << 29])
@pytest.mark.parametrize("limits", [(8192, 1 << 21, 1 << 16), (7, 20, 30), (50, 1 << 21, 1)])
def test_top_k_search(large, limits, monkeypatch):
    """Scores of 16, 32 and 64 bits, on both sides of the blocks' limits."""
    for name, value in zip(("BLOCK", "CELLS", "TILE"), limits):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(7)
    rows = [(rng.randrange(150), [rng.choice([-1, 0, 1]) * rng.choice([1, large]) for _ in range(rng.choice([0, 1, 6, 30]))]) for _ in range(200)]
    asked = [(i, n, v) for n, (i, v) in enumerate(rows) if i % 4 == 0]
    asked = pa.table({"vec_id": [x[0] for x in asked], "row": [x[1] for x in asked], "v": pa.array([x[2] for x in asked], pa.list_(pa.int64()))})
    batches = pa.table({"vec_id": [i for i, _ in rows], "v": pa.array([v for _, v in rows], pa.list_(pa.int64()))}).to_batches(max_chunksize=33)
    got = Counter()
    for batch in topk.searcher(asked, 6)(iter(batches)):
        for r in batch.to_pylist():
            found = sorted(zip(r["score"], r["vec_id"]), key=lambda x: (-x[0], x[1]))
            got.update((r["query_id"], n, j, s) for n, (s, j) in enumerate(found, 1))
    assert got == nearest(rows, 6)


SMALL_HEAP = """
import sys
from pyspark.sql import SparkSession, functions as F
from karstflow.llm.topk import top_k
conf = {"spark.driver.memory": "600m", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": sys.argv[1]}
spark = SparkSession.builder.master("local[2]").config(map=conf).getOrCreate()
v = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.when((i == F.col("id") % 512) | (i == 7 * F.col("id") % 512), 0.5).otherwise(0.0).cast("float"))
found = top_k(spark.range(8192).select(F.col("id").alias("vec_id"), v.alias("embedding")), F.lit(True), k=3).collect()
terms, same = [frozenset((i % 512, 7 * i % 512)) for i in range(8192)], {}
for i, x in enumerate(terms):
    same.setdefault(x, []).append(i)
assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == [(i, n, j) for i in range(8192) for n, j in enumerate([x for x in same[terms[i]] if x != i][:3], 1)]
print("all found")
"""


def test_top_k_memory(tmp_path):
    """8,192 queries against a block of 32 MB in a heap of 600 MB, which has no room for the block once for each 256 queries."""
    run = subprocess.run([sys.executable, "-c", SMALL_HEAP, str(tmp_path)], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, timeout=600)
    assert "all found" in run.stdout, run.stderr[-3000:]


# ---- op 5 ----


def groups(rows):
    """(doc id, n, component) by brute force for a list of (id, text)."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else min(least[r], least[r] if d is None else d)
    return Counter((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def test_near_groups(documents, empty):
    got = near_dedup.near_groups(documents).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == groups([(d.doc_id, d.text) for d in documents.collect()])
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dedup.near_groups(empty).count() == 0


def test_a_cloud_of_near_copies(spark):
    """A node far larger than a leaf, whose members are linked to some others only."""
    rng = random.Random(6)
    base = [sentence(rng, 1) for _ in range(70)]
    rows = []
    for i in range(260):
        w = list(base)
        for k in rng.sample(range(70), rng.choice([0, 1, 1, 2, 3, 5])):
            w[k] = f"x{i}y{k}"
        rows.append((i, " ".join(w)))
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == groups(rows)


@pytest.mark.parametrize("limits", [{"HELD": 100}, {"REST": 20}, {"REST": 20, "DEPTH": 1}, {"HELD": 100, "REST": 0}])
def test_node_limits_leave_the_groups(spark, monkeypatch, limits):
    """Hot nodes off the tasks, and rests branched on or compared at once: the same groups."""
    for k, v in limits.items():
        monkeypatch.setattr(near_dedup, k, v)
    rng = random.Random(18)
    base, boiler = [sentence(rng, 1) for _ in range(80)], sentence(rng, 40)
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(80), rng.choice([0, 1, 2, 3, 4])):
            w[k] = f"x{i}y{k}"
        rows.append((i, " ".join(w)))
    rows += [(i, boiler + " " + sentence(rng, 30)) for i in range(200, 330)]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == groups(rows)


def test_one_row_of_each_group(spark):
    """Repeated rows, near copies under the smallest id, and groups of null ids leave one row each."""
    rng = random.Random(19)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    rows = [(1, a), (1, a), (1, a + " end"), (2, a), (None, b), (None, b), (None, b + " end"), (None, c), (7, c), (8, ""), (8, ""), (9, None)]
    kept = near_dedup.drop_near_copies(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, extra int").repartition(3)).collect()
    by_text = Counter((r.doc_id, "a" if r.text and r.text.startswith(a) else "b" if r.text and r.text.startswith(b) else r.text) for r in kept)
    assert by_text == Counter({(1, "a"): 1, (None, "b"): 1, (7, c): 1, (8, ""): 2, (9, None): 1})
    assert all(rows[r.extra] == (r.doc_id, r.text) for r in kept)


def test_drop_near_copies(spark, documents):
    docs = odd(spark, documents)
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    assert {0, 1, 2, 3, 6} <= left and not left & {4, 7, 8, 9}


# ---- op 6 ----


def cuts(rows, n, keep_first):
    """Kept bytes of each (order, text): windows of n bytes that start elsewhere (earlier) too are cut."""
    seen = {}
    for order, t in rows:
        for p in range(len(t) - n + 1):
            seen.setdefault(t[p : p + n], []).append((order, p))
    out = []
    for order, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - n + 1):
            places = seen[t[p : p + n]]
            if min(places) < (order, p) if keep_first else len(places) > 1:
                gone[p : p + n] = b"\1" * n
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def test_repeats(documents, empty):
    docs = documents.collect()
    got = suffix_dedup.repeat_digest(documents).collect()
    want = cuts([(i, (d.text or "").encode()) for i, d in enumerate(docs)], 200, False)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((d.doc_id, *w) for d, w in zip(docs, want))
    assert suffix_dedup.repeat_digest(empty).count() == 0


@pytest.mark.parametrize("group, stretch", [(2048, 128), (3, 2)])
def test_first_copies_stay(spark, texts, group, stretch, monkeypatch):
    """Whole anchors in one bucket and anchors dealt into several, long and short stretches give the same cuts."""
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "STRETCH", stretch)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    by_text = {r.text: r.h for r in docs.select("text", suffix_dedup.F.xxhash64("text").alias("h")).collect()}
    for keep_first in (True, False):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_digest(docs, 80, keep_first).collect()}
        want = cuts([((i, by_text[t]), (t or "").encode()) for i, t in enumerate(texts)], 80, keep_first)
        assert got == dict(enumerate(want))


@pytest.mark.parametrize("group", [2048, 1])
def test_repeated_rows_keep_a_first_copy(spark, group, monkeypatch):
    """Rows that repeat both id and text are one document: what they share with others stays in the first."""
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = random.Random(12)
    passage = sentence(rng, 50)
    once = [(i, sentence(rng, 30) + " " + passage + " " + sentence(rng, 30)) for i in (3, 5, 8)] + [(9, sentence(rng, 90))]
    docs = spark.createDataFrame(once + once[:1] * 2 + once[1:2], "doc_id long, text string").repartition(3)
    by_text = {r.text: r.h for r in docs.select("text", suffix_dedup.F.xxhash64("text").alias("h")).collect()}
    want = dict(zip((i for i, _ in once), cuts([((i, by_text[t]), t.encode()) for i, t in once], 200, True)))
    got = suffix_dedup.repeat_digest(docs, 200, True).collect()
    assert Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == Counter({(i, want[i]): n for i, n in ((3, 3), (5, 2), (8, 1), (9, 1))})
    left = {r.doc_id: r.text for r in suffix_dedup.without_repeats(docs).collect()}
    assert [i for i in sorted(left) if passage in left[i]] == [3]


def test_texts_are_shuffled_once(spark, monkeypatch):
    """The texts that segments are cut from are grouped and joined in one shuffle; null ids keep their texts apart from id 0."""
    passage = sentence(random.Random(4), 60)
    rows = [(None, passage + " one"), (0, passage + " two"), (0, passage + " two"), (0, passage + " one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plans, real = [], suffix_dedup.settle
    monkeypatch.setattr(suffix_dedup, "settle", lambda df, name: (name == "segments" and plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, name))[1])
    monkeypatch.setattr(suffix_dedup, "sized", lambda df, rows: df)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = suffix_dedup.repeat_digest(docs, 200, True).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    texts = re.split(r"\n +\+- Sort(?:Aggregate|MergeJoin)?.*asked|\n +\+- ObjectHashAggregate", plans[0])[0]  # the plan begins with the texts' side of the join
    assert texts.count("partial_first") == 1 and texts.count("Exchange hashpartitioning") == 1, plans[0]
    by_text = {r.text: r.h for r in docs.select("text", suffix_dedup.F.xxhash64("text").alias("h")).collect()}
    once = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, by_text[r[1]]))
    want = dict(zip(once, cuts([(n, t.encode()) for n, (_, t) in enumerate(once)], 200, True)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((i, *want[i, t]) for i, t in rows)


def test_without_repeats(spark, documents):
    docs = odd(spark, documents)
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    rows = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert rows[0].text is None and rows[7].text == "" and rows[7].n_chars == 0


# ---- op 7 ----


def test_decontamination(spark, documents, empty, texts):
    item = " ".join(texts[30].split()[:3]) + " " + texts[18]
    edited = "Before.  " + item.replace("ka", "kx", 3).upper() + "\n after"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "  "), (4, "short item"), (5, item), (None, "z" * 60)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item), (2, edited), (3, texts[20] or "x"), (4, None), (5, ""), (6, "a short item here"), (7, "y" + "z" * 80), (8, item[: len(item) // 2])], "doc_id long, text string")
    got = {r.doc_id: (r.contaminated, r.n_items, r.min_distance) for r in decontaminate.contaminated(docs, bench).collect()}
    n = edited.lower().count("kx")
    assert got == {1: (True, 2, 0), 2: (True, 2, n), 3: (False, 0, None), 4: (False, 0, None), 5: (False, 0, None), 6: (True, 1, 0), 7: (True, 1, 0), 8: (False, 0, None)}
    clean = decontaminate.clean_documents(odd(spark, documents), bench.limit(0))
    assert clean.columns == odd(spark, documents).columns and clean.count() == documents.count()
    assert decontaminate.contaminated(empty, bench).count() == 0


@pytest.mark.parametrize("chars", [4_000_000, 700])
def test_decontamination_against_brute_force(spark, monkeypatch, chars):
    """All items at once and in blocks, short and long, edited up to and beyond their budgets, in long and repeated texts."""
    monkeypatch.setattr(decontaminate, "ITEM_CHARS", chars)
    rng = random.Random(13)
    items = [(i, sentence(rng, n)) for i, n in enumerate([1, 2, 3, 4, 5, 8, 13, 20, 30, 40] * 2)] + [(3, "Repeated  item\there"), (3, "repeated item here"), (None, "no id at all")]

    def spoil(t, n):
        t = list(t)
        for _ in range(n):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], ["#"], [t[k], "#"]])
        return "".join(t)

    docs = [(None, None), (0, ""), (1, "Repeated item HERE, no id at all")]
    for i, (_, t) in enumerate(items):
        for n in range(4):
            docs.append((10 * i + n, sentence(rng, rng.choice([0, 3, 30])) + " " + spoil(t, n * max(1, len(t) // 40)) + " " + sentence(rng, rng.choice([0, 4]))))
    docs += [docs[5], (9000, sentence(rng, 4000) + " " + items[9][1] + " " + sentence(rng, 4000))]

    def least(item, text):
        row = np.zeros(len(text) + 1, int)
        codes = np.array([ord(c) for c in text], int)
        for i, c in enumerate(item, 1):
            new = np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))
            new = np.concatenate([[i], new])
            row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
        return row.min()

    plain = decontaminate.plain
    want = Counter()
    for d, t in docs:
        hits = []
        for i, item in items:
            item = plain(item)
            if t and (n := least(item, plain(t))) <= int(len(item) * 0.06):
                hits.append((i, n))
        ids = tuple(sorted((i for i, _ in hits), key=lambda x: (x is None, x)))
        want[d, len(hits) > 0, len(hits), ids, min((n for _, n in hits), default=None)] += 1
    rows = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r.doc_id, r.contaminated, r.n_items, tuple(r.item_ids), r.min_distance) for r in rows) == want


# ---- op 9 ----


def judge(url, rules, default="allow"):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest, re.S)[0]
        path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "https://WWW.Example.com/en/x?y#z", "http://example.com/de/", "http://a.net/es/1", "http://net/fr/", "ftp://x.org", "http://notexample.com/en/", "http://example.com", "a://b.com/://c", "http://www.example.com?/en/", "http://fr.net/fr"]
    urls += [f"http://h{i % 7}.example.{'com' if i % 2 else 'net'}/{'en' if i % 3 else 'es'}/{i}" for i in range(60)] + ["http://hot.com/en/"] * 40
    urls += ["http://a.com/" + "p" * 30000, "http://" + "l." * 4000 + "example.com/en/"]
    more = [("h1.example.com", "/en/1", "block"), ("com", "/en/13", "block"), ("h3.example.com", "/", "allow"), ("org", "", "block"), (None, "/", "block")]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    for rules in (RULES, RULES + more, []):
        df = spark.createDataFrame(rules, "host string, path string, verdict string")
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, df, partitions=5).collect()}
        assert got == {i: judge(u, [r for r in rules if r[0]]) for i, u in enumerate(urls)}
    assert url_rules.judge_urls(pages.limit(0), spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0


# ---- op 10 ----


def test_chats(spark):
    a, b, c, d = ("user", "hi"), ("assistant", "ho"), ("user", "more"), ("assistant", None)
    chats = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [b], 6: [a, b, d], 7: [a, b, a], None: [c], 8: [(None, "x"), (None, "x")], 9: [(None, "x")]}
    rows = [(k, i, r, t, "extra") for k, v in chats.items() for i, (r, t) in enumerate(v)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string").repartition(3)
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in chat.format_chats(df).collect()}
    show = lambda v: "".join(f"<|{r or ''}|>\n{t or ''}\n<|end|>\n" for r, t in v)
    assert got == {k: (len(chats[k]), 2 if k == 3 else 1, show(chats[k])) for k in (3, 5, 6, 7, None, 8)}
    ties = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "user", "c"), (2, 0, "user", "c"), (2, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    assert [r.text for r in chat.format_chats(ties).collect()] == [show([("user", "c"), ("user", "a"), ("user", "b")])]
    assert chat.format_chats(df.limit(0)).count() == 0
