"""Byte-level text kernels over Arrow string batches (numpy inside tasks).

A batch's texts are one byte array with row offsets. Words are the runs of bytes other than
space and 0x09-0x0D; A-Z count as a-z in hashes; bytes from 0x80 on are word bytes, so the
rules hold for whole UTF-8 texts. Hashes are 64-bit polynomials over a byte table, mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed 64-bit values for one use, told by ``salt``."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(salt) * U64(1 << 32)) * U64(0x9E3779B97F4A7C15))


BASE = 0x9E6C63D0876A9A47 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BYTE = seeds(256, 1)
BYTE_LOWER = BYTE[LOWER]
_powers = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept up to a few chunks' length."""
    have = _powers.get("n", 0)
    if n > have:
        size = max(n, CHUNK + 1)
        up, down = np.full(size, U64(BASE)), np.full(size, U64(INVERSE))
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(up, out=up)
            np.multiply.accumulate(down, out=down)
        if size > 8 * CHUNK:
            return up[:n], down[:n]
        _powers.update(n=size, up=up, down=down)
    return _powers["up"][:n], _powers["down"][:n]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; a null reads as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offs - offs[0]


def spans(offs: np.ndarray, limit: int = 8 * CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of about ``limit`` bytes each; a longer row runs alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def edges(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; a row's end also ends a word."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = IS_WORD[data]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    cuts = offs[1:-1]
    before[cuts[cuts < len(data)]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    after[cuts[cuts > 0] - 1] = False
    return starts, np.flatnonzero(word & ~after) + 1


def row_of(offs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The row that holds each byte position."""
    return np.searchsorted(offs, at, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each lower-cased word, worked out in chunks of about ``CHUNK`` bytes."""
    out = np.empty(len(starts), U64)
    k, n = 0, len(starts)
    with np.errstate(over="ignore"):
        while k < n:
            a = starts[k]
            m = max(k + 1, int(np.searchsorted(ends, a + CHUNK, "right")))
            b = ends[m - 1]
            up, down = powers(int(b - a) + 1)
            total = np.zeros(int(b - a) + 1, U64)
            np.cumsum(BYTE_LOWER[data[a:b]] * up[: b - a], out=total[1:])
            s, e = starts[k:m] - a, ends[k:m] - a
            out[k:m] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U64))
            k = m
    return out


SHINGLE = seeds(64, 2)


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of ``size`` words; a row of fewer words gives its whole sequence once."""
    count = np.bincount(rows, minlength=n_rows) if len(rows) else np.zeros(n_rows, np.int64)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    with np.errstate(over="ignore"):
        n = max(0, len(words) - size + 1)
        total = np.zeros(n, U64)
        for j in range(size):
            total += words[j : j + n] * (SHINGLE[j] | U64(1))
        whole = rows[:n] == rows[size - 1 : size - 1 + n] if n else np.empty(0, bool)
        parts, at = [mix(total[whole])], [rows[:n][whole]]
        for c in range(1, size):
            short = np.flatnonzero(count == c)
            if len(short):
                total = np.full(len(short), SHINGLE[size + c])
                for j in range(c):
                    total += words[first[short] + j] * (SHINGLE[j] | U64(1))
                parts.append(mix(total))
                at.append(short)
    hashes, at = np.concatenate(parts), np.concatenate(at).astype(np.int64)
    if len(parts) > 1:
        order = np.argsort(at, kind="stable")
        hashes, at = hashes[order], at[order]
    return hashes, at
