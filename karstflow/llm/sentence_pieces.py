"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled once into a transducer over characters: the normaliser (the model's character
map, which rewrites the longest match from the left, blanks squeezed if the model says so, a blank
before the text, blanks as the word mark), a trie of the pieces whose accepting states output a piece
at the cost of its negative score, and a fallback that turns a character no piece knows into its UTF-8
bytes (an unknown piece for a run of them in models without bytes). The normaliser has one output for
an input, so composing it is a pass over the text; composing the rest gives the lattice of that
output, and the encoding is its shortest path in the tropical semiring (costs add along a path, the
least one wins).

For a unigram model that is the model's own best segmentation (costs are added in 32 bits, as the
model's scores are; a character without a piece of its own costs 10 more than the worst piece). A BPE model applies merges by rank,
which costs alone don't express; its transducer therefore also remembers the last piece and has no
arc from piece a to piece b if merging the text of a and b would cross their border. A sequence of
pieces is what BPE gives exactly if each neighbouring pair is (a merge that crosses no border of two
neighbours crosses none), so the lattice holds one path, the model's own encoding.

The lattice is worked out in numpy for all distinct words of a batch at once: position by position
over words sorted by length. No piece has a word mark after another character, so texts fall apart
before each run of marks; that is checked when a model is compiled. Encoding is one scan: no shuffle.

Cases: a null or empty text has no pieces and decodes to an empty text; a word mark in a text reads
as a blank, so such a text does not decode to itself and ``round_trip`` says so (as for whatever a
character map rewrites); very long runs without blanks are walked with the same tables character by character;
repeated rows are each encoded; an empty table gives no rows; extra columns pass through in
``with_pieces`` (a column of a result's name gets an underscore added).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import byte_batches, fresh

MARK = "▁"
MARK_BYTES = MARK.encode()
#: Words of more characters are walked one by one; words of a length group that are worked out together.
LONG, GROUP = 256, 1 << 16
NONE = np.int32(-1)
FAR = np.int64(1 << 40)


class Table:
    """A read-only map from 64-bit keys to integers, looked up by whole arrays (open addressing)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(4 * len(keys)).bit_length())
        self.mask, self.keys, self.values = np.uint64(size - 1), np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        slot, left, self.probes = self.slots(keys), np.arange(len(keys)), 1
        while len(left):
            free = self.keys[slot[left]] == -1
            place, first = np.unique(slot[left[free]], return_index=True)
            chosen = left[free][first]
            self.keys[place], self.values[place] = keys[chosen], values[chosen]
            left = np.setdiff1d(left, chosen, assume_unique=True)
            taken = self.keys[slot[left]] != -1
            slot[left[taken]] = (slot[left[taken]] + 1) & int(self.mask)
            self.probes += 1

    def slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24) & self.mask).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slots(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & int(self.mask)
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found != -1)]
        return out


def merged(word: str, rank: dict[str, int]) -> list[tuple[str, str]]:
    """The merges that BPE makes in ``word``, in order: the best-ranked pair first, the leftmost of equals."""
    parts, out = list(word), []
    while True:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank), default=None)
        if best is None:
            return out if len(parts) == 1 else []
        i = best[1]
        out.append((parts[i], parts[i + 1]))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


class Normaliser:
    """A model's character map as a transducer: at each position the longest key gives way to its value."""

    def __init__(self, charsmap: bytes, squeeze: bool):
        self.squeeze, self.single, self.longer = squeeze, {}, {}
        for key, value in self.entries(charsmap):
            if len(key) == 1:
                self.single[ord(key)] = value
            else:
                self.longer[key] = value
        self.longest = max(map(len, self.longer), default=0)
        self.inner = re.compile("[" + "".join(map(re.escape, sorted({k[1] for k in self.longer}))) + "]") if self.longer else None

    @staticmethod
    def entries(charsmap: bytes) -> Iterator[tuple[str, str]]:
        """The (key, value) pairs of a compiled map: a double-array trie over UTF-8 bytes, whose leaves point to zero-ended values."""
        if not charsmap:
            return
        size = int.from_bytes(charsmap[:4], "little")
        units, values = np.frombuffer(charsmap[4 : 4 + size], "<u4").astype(np.int64), charsmap[4 + size :]
        jump = lambda u: (u >> 10) << ((u & 512) >> 6)
        labels, level = np.arange(1, 256), [(b"", int(jump(units[0])))]
        while level:
            at = np.array([a for _, a in level])[:, None] ^ labels
            unit = units[np.minimum(at, len(units) - 1)]
            row, col = np.nonzero((at < len(units)) & ((unit & 0x800000FF) == labels))
            below = []
            for r, c, i, u in zip(row, col, at[row, col], unit[row, col]):
                key, inner = level[r][0] + bytes([labels[c]]), int(i ^ jump(u))
                if u & 256:
                    start = int(units[inner] & 0x7FFFFFFF)
                    yield key.decode(), values[start : values.index(b"\0", start)].decode()
                below.append((key, inner))
            level = below

    def __call__(self, text: str) -> str:
        if self.inner is not None and not text.isascii() and self.inner.search(text):
            out, i = [], 0
            while i < len(text):
                for n in range(min(self.longest, len(text) - i), 1, -1):
                    if (value := self.longer.get(text[i : i + n])) is not None:
                        break
                else:
                    n, value = 1, self.single.get(ord(text[i]), text[i])
                out.append(value)
                i += n
            text = "".join(out)
        else:
            text = text.translate(self.single)
        return re.sub(" +", " ", text).lstrip(" ").rstrip(" " + MARK) if self.squeeze else text


class Transducer:
    """A compiled model. Pieces are numbered by rank inside: single characters first, then by score."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that mark the blank before a word are compiled")
        if model.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models are compiled")
        self.prefix, self.bpe = spec.add_dummy_prefix, model.trainer_spec.model_type == 2
        plain = not (spec.precompiled_charsmap or spec.remove_extra_whitespaces)
        self.normaliser = None if plain else Normaliser(spec.precompiled_charsmap, spec.remove_extra_whitespaces)
        kinds = {1: [], 4: []}
        self.byte_ids, self.unknown, self.n_ids = np.full(256, -1, np.int32), 0, len(model.pieces)
        for i, p in enumerate(model.pieces):
            if p.type in kinds:
                kinds[p.type].append((p.piece, p.score, i))
            elif p.type == 6:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
            elif p.type == 2:
                self.unknown = i
        if kinds[4]:
            raise ValueError("models with user-defined symbols are not compiled")
        pieces = sorted(kinds[1], key=lambda x: (len(x[0]) > 1, -x[1], x[2]))
        if any(MARK in p.lstrip(MARK) for p, _, _ in pieces):
            raise ValueError("a piece has a word mark inside: texts would not fall apart into words")
        self._compile(pieces)
        texts = [b""] * self.n_ids
        for p, _, i in pieces:
            texts[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            if i >= 0:
                texts[i] = bytes([b])
        texts[self.unknown] = " ⁇ ".encode()
        self.text_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.text_offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])

    def _compile(self, pieces: list[tuple[str, float, int]]) -> None:
        rank = {p: r for r, (p, _, _) in enumerate(pieces)}
        multi = {p: r for p, r in rank.items() if len(p) > 1}
        if not self.bpe:  # characters that only stand in longer pieces: an unknown piece each
            dear = min((s for _, s, _ in pieces), default=0.0) - 10.0
            for c in sorted({c for p in rank for c in p if c not in rank}):
                rank[c] = len(pieces)
                pieces.append((c, dear, -1))
        n = len(pieces)
        self.ids, self.costs = np.array([i for _, _, i in pieces], np.int32), np.array([-s for _, s, _ in pieces], np.float64 if self.bpe else np.float32)
        self.length = np.array([len(p) for p, _, _ in pieces], np.int64)
        self.left, self.right = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)
        reached = np.ones(n, bool)
        if self.bpe:
            for p, r in multi.items():
                steps = merged(p, multi) if all(c in rank for c in p) else []
                if steps:
                    self.left[r], self.right[r] = (rank[x] for x in steps[-1])
                else:
                    reached[r] = False  # no input ever merges to it
            pairs = [(rank[p[:k]], rank[p[k:]], r) for p, r in multi.items() if reached[r] for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank]
            a, b, r = np.array(pairs, np.int64).reshape(-1, 3).T
            self.pairs = Table(a << 20 | b, r.astype(np.int32))
        chars = sorted({c for p, r in rank.items() if reached[r] for c in p})
        self.char_of = np.full(0x110000, -1, np.int32)
        self.char_of[[ord(c) for c in chars]] = np.arange(len(chars))
        single = np.array([rank.get(c, -1) for c in chars])
        self.char_of[[ord(c) for c, r in zip(chars, single) if r < 0]] = -1
        trie: dict[tuple[int, int], int] = {}
        accept = [-1]
        for p, r in rank.items():
            if not reached[r] or any(self.char_of[ord(c)] < 0 for c in p):
                continue
            state = 0
            for c in p:
                key = (state, int(self.char_of[ord(c)]))
                if key not in trie:
                    trie[key] = len(accept)
                    accept.append(-1)
                state = trie[key]
            accept[state] = r
        self.accept = np.array(accept, np.int32)
        self.root = np.full(len(chars), -1, np.int32)
        for (s, c), t in trie.items():
            if s == 0:
                self.root[c] = t
        inner = [(s << 24 | c, t) for (s, c), t in trie.items() if s]
        self.arcs = Table(np.array([k for k, _ in inner], np.int64), np.array([t for _, t in inner], np.int32))
        self.has_arcs = np.zeros(len(accept), bool)
        self.has_arcs[[s for s, _ in trie]] = True

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("memo_key", "memo_value")}

    def crosses_none(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves the border between pieces a and b: both are undone, the later merge first,
        and no pair across the border may merge before the merge that was undone last."""
        out, at = np.ones(len(a), bool), np.arange(len(a))
        a, b, limit = a.astype(np.int64), b.astype(np.int64), np.full(len(a), FAR)
        while len(at):
            over = self.pairs(a << 20 | b).astype(np.int64)
            bad = (over >= 0) & (over < limit)
            out[at[bad]] = False
            at, a, b = at[~bad], a[~bad], b[~bad]
            la, rb = self.right[a].astype(np.int64), self.left[b].astype(np.int64)
            undo_a = np.where(a > b, la != a, (rb == b) & (la != a))
            undo_b = ~undo_a & (rb != b)
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, la, a), np.where(undo_b, rb, b)
            go = undo_a | undo_b
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return out

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``crosses_none`` with a memory of the pairs seen in this process; a = -1 starts a word."""
        if not self.bpe:
            return np.ones(len(a), bool)
        if not hasattr(self, "memo_key"):
            self.memo_key, self.memo_value = np.full(1 << 21, -1, np.int64), np.zeros(1 << 21, bool)
        out = np.ones(len(a), bool)
        inner = np.flatnonzero(a >= 0)
        key = a[inner].astype(np.int64) << 20 | b[inner]
        with np.errstate(over="ignore"):
            slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)
        out[inner] = self.memo_value[slot]
        miss = np.flatnonzero(self.memo_key[slot] != key)
        if len(miss):
            new, at = np.unique(key[miss], return_inverse=True)
            good = self.crosses_none(new >> 20, new & ((1 << 20) - 1))
            out[inner[miss]] = good[at]
            self.memo_key[slot[miss]], self.memo_value[slot[miss]] = key[miss], good[at]
        return out

    def shortest(self, chars: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, word) in order for words of one length group: ``chars`` is (position, word), longest words first."""
        top, n = chars.shape
        cost = np.full((top + 1, n), np.inf, self.costs.dtype)
        last, back = np.full((top + 1, n), NONE), np.zeros((top + 1, n), np.int16)
        cost[0] = 0
        for s in range(top):
            at = np.arange(int(np.searchsorted(-length, -s, "left")))  # words of more than s characters
            state, e = self.root[chars[s, at]], s + 1
            while True:
                piece = self.accept[state]
                ends = np.flatnonzero(piece >= 0)
                w, p = at[ends], piece[ends]
                better = cost[s, w] + self.costs[p] < cost[e, w]
                w, p = w[better], p[better]
                good = self.allowed(last[s, w], p)
                w, p = w[good], p[good]
                cost[e, w], last[e, w], back[e, w] = cost[s, w] + self.costs[p], p, s
                on = np.flatnonzero(self.has_arcs[state] & (length[at] > e))
                if not len(on):
                    break
                at = at[on]
                state = self.arcs(state[on].astype(np.int64) << 24 | chars[e, at])
                at, state = at[state >= 0], state[state >= 0]
                if not len(at):
                    break
                e += 1
        pieces, words, at, e = [], [], np.arange(n), length.astype(np.int64)
        while len(at):
            pieces.append(last[e, at]), words.append(at)
            e = back[e, at].astype(np.int64)
            at, e = at[e > 0], e[e > 0]
        pieces, words = np.concatenate(pieces[::-1]), np.concatenate(words[::-1])
        order = np.argsort(words, kind="stable")
        return pieces[order], words[order]

    def walk_long(self, chars: np.ndarray) -> np.ndarray:
        """The same for one very long word, position by position."""
        n = len(chars)
        cost, last, back = np.full(n + 1, np.inf, self.costs.dtype), np.full(n + 1, NONE), np.zeros(n + 1, np.int64)
        cost[0] = 0
        for s in range(n):
            state, e, found, ends = self.root[chars[s]], s + 1, [], []
            while state >= 0:
                if self.accept[state] >= 0:
                    found.append(self.accept[state]), ends.append(e)
                if e >= n:
                    break
                state, e = self.arcs(np.array([int(state) << 24 | int(chars[e])]))[0], e + 1
            good = self.allowed(np.full(len(found), last[s]), np.array(found, np.int32))
            for p, e in (x for x, ok in zip(zip(found, ends), good) if ok):
                if cost[s] + self.costs[p] < cost[e]:
                    cost[e], last[e], back[e] = cost[s] + self.costs[p], p, s
        out = []
        while n > 0:
            out.append(last[n])
            n = back[n]
        return np.array(out[::-1], np.int32)

    def encode_words(self, points: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of words given by code points and offsets."""
        chars = self.char_of[points]
        known = chars >= 0
        edge = np.zeros(len(points), bool)
        edge[offs[:-1]] = True
        edge[1:] |= known[1:] != known[:-1]
        starts = np.flatnonzero(edge & known)
        stops = np.append(np.flatnonzero(edge), len(points))
        length = stops[np.searchsorted(stops, starts, "right")] - starts
        place, ids = [], []
        order = np.argsort(-length, kind="stable")
        starts, length = starts[order], length[order]
        n_long = int(np.searchsorted(-length, -LONG, "left"))
        for s, n in zip(starts[:n_long], length[:n_long]):
            found = self.walk_long(chars[s : s + n])
            ids.append(self.ids[found]), place.append(s + np.cumsum(self.length[found]) - self.length[found])
        i = n_long
        while i < len(starts):
            j = min(len(starts), i + max(1024, GROUP * 8 // int(length[i])))
            s, n = starts[i:j], length[i:j]
            grid = chars[np.minimum(s + np.arange(int(n[0]))[:, None], len(chars) - 1)]
            found, word = self.shortest(grid, n)
            at = np.cumsum(self.length[found]) - self.length[found]
            first = np.concatenate([[True], word[1:] != word[:-1]])
            ids.append(self.ids[found]), place.append(s[word] + at - np.maximum.accumulate(np.where(first, at, 0)))
            i = j
        odd = np.flatnonzero(~known)
        if not self.bpe and ids:
            ids, place = [np.concatenate(ids)], [np.concatenate(place)]
            odd = np.concatenate([odd, place[0][ids[0] < 0]])
            ids, place = [ids[0][ids[0] >= 0]], [place[0][ids[0] >= 0]]
        if len(odd):
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in points[odd]]
            size = np.array([len(x) for x in raw])
            fallback = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            ids.append(np.where(fallback >= 0, fallback, self.unknown)), place.append(np.repeat(odd, size))
        if not ids:
            return np.empty(0, np.int32), np.zeros(len(offs), np.int64)
        ids, place = np.concatenate(ids), np.concatenate(place)
        order = np.argsort(place, kind="stable")
        ids, place = ids[order].astype(np.int32), place[order]
        if (self.byte_ids < 0).any():  # a run of unknown characters of a word is one piece
            word = np.searchsorted(offs, place, "right")
            again = np.zeros(len(ids), bool)
            again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown) & (word[1:] == word[:-1])
            ids, place = ids[~again], place[~again]
        return ids, np.searchsorted(place, offs)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of whole texts given by UTF-8 bytes and offsets, in which word marks are blanks already."""
        size = np.diff(offs)
        if self.prefix:
            some = np.flatnonzero(size)
            data = np.insert(data, offs[:-1][some], 0x20)
            offs = offs + np.concatenate([[0], np.cumsum(size > 0)])
        blank = data == 0x20
        cut = np.zeros(len(data) + 1, bool)
        cut[offs] = True
        cut[1:-1] |= blank[1:] & ~blank[:-1]
        cut = np.flatnonzero(cut)
        starts, ends = cut[:-1], cut[1:]
        hashes = exact_hashes(data, starts, ends)
        _, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        w_len = (ends - starts)[first]
        w_offs = np.concatenate([[0], np.cumsum(w_len)])
        raw = data[ragged(starts[first], w_len)]
        lead = (raw & 0xC0) != 0x80
        points = np.frombuffer(raw.tobytes().decode("utf-8").replace(" ", MARK).encode("utf-32-le"), np.uint32).astype(np.int64)
        p_offs = np.concatenate([[0], np.cumsum(lead)])[w_offs]
        ids, i_offs = self.encode_words(points, p_offs)
        n = np.diff(i_offs)
        total = np.concatenate([[0], np.cumsum(n[at])])
        return ids[ragged(i_offs[:-1][at], n[at])], total[np.searchsorted(starts, offs)]

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts of id lists; ids outside the model count as unknown."""
        ids = np.where((ids >= 0) & (ids < self.n_ids), ids, self.unknown)
        n = self.text_offs[ids + 1] - self.text_offs[ids]
        data = self.text_bytes[ragged(self.text_offs[ids], n)]
        offs = np.concatenate([[0], np.cumsum(n)])[offs]
        if self.prefix or (self.normaliser is not None and self.normaliser.squeeze):
            first = offs[:-1][(np.diff(offs) > 0)]
            first = first[data[first] == 0x20]
            data = np.delete(data, first)
            offs = offs - np.searchsorted(first, offs, "left")
        return data, offs


def ragged(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The positions of runs [start, start + n), one after another."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(n) else 0) + np.repeat(starts - (ends - n), n)


def exact_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte runs as they are (upper case told from lower)."""
    out = np.empty(len(starts), np.uint64)
    k, n = 0, len(starts)
    with np.errstate(over="ignore"):
        while k < n:
            a = int(starts[k])
            m = max(k + 1, int(np.searchsorted(ends, a + T.CHUNK, "right")))
            b = int(ends[m - 1])
            up, down = T.powers(b - a + 1)
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum(T.BYTE[data[a:b]] * up[: b - a], out=total[1:])
            s, e = starts[k:m] - a, ends[k:m] - a
            out[k:m] = T.mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            k = m
    return out


def without_marks(column: pa.Array, normaliser: Normaliser | None = None) -> pa.Array:
    """Normalised texts, with their word marks as blanks."""
    import pyarrow.compute as pc

    if normaliser is not None:
        column = pa.array([None if t is None else normaliser(t) for t in column.to_pylist()], pa.large_string())
    return pc.replace_substring(column, MARK, " ")


_compiled: dict[str, Transducer] = {}


def transducer(path: str | None = None) -> Transducer:
    """The compiled model of a file, kept for this process; without a path the public 32k model."""
    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("piece_bpe_32k.model"))
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def with_pieces(documents: DataFrame, path: str | None = None) -> tuple[DataFrame, str, str]:
    """``documents`` with the ids of each text and whether decoding them gives the text again; the columns' names."""
    byte_batches(documents.sparkSession)
    model = transducer(path)
    ids, whole = fresh(documents, "piece_ids"), fresh(documents, "round_trip")
    out = documents.withColumns({ids: F.lit(None).cast("array<int>"), whole: F.lit(False)})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = T.buffers(without_marks(batch["text"], model.normaliser))
            raw, at_raw = T.buffers(batch["text"])
            for i, j in T.spans(offs):
                d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                found, cuts = model.encode(d, o)
                again, back = model.decode(found, cuts)
                same = np.array([b - a == f - e and np.array_equal(again[a:b], raw[e:f]) for a, b, e, f in zip(back[:-1], back[1:], at_raw[i:j], at_raw[i + 1 : j + 1])], bool)
                part = batch.slice(i, j - i)
                at, to = (part.schema.get_field_index(c) for c in (ids, whole))
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(found, pa.int32()))
                part = part.set_column(at, part.schema.field(at), lists)
                yield part.set_column(to, part.schema.field(to), pa.array(same))

    return out.mapInArrow(encode, out.schema), ids, whole


def encode_texts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, piece_ids and round_trip of every document."""
    rows, ids, whole = with_pieces(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), path)
    return rows.select("doc_id", F.size(ids).cast("long").alias("n_pieces"), F.col(ids).alias("piece_ids"), F.col(whole).alias("round_trip"))


def decode_texts(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of piece_ids; a null list is an empty text, broken UTF-8 becomes U+FFFD."""
    model = transducer(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["piece_ids"]
            offs = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            data, cuts = model.decode(lists.flatten().fill_null(model.unknown).to_numpy(zero_copy_only=False).astype(np.int64), offs)
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("piece_ids").cast("array<int>").alias("piece_ids"))
    return rows.mapInArrow(decode, "doc_id long, text string")
