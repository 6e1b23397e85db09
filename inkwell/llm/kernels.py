"""Vectorised byte and token kernels shared by the Arrow-backed operators.

Everything here works on one Arrow batch at a time: the texts of the batch lie
in one byte buffer, and words, n-grams and hashes come from whole-buffer numpy
passes, never from a Python loop over rows. `slices` cuts a batch so that the
temporaries stay near a fixed number of bytes whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; temporaries take about 60 times as much.
SLICE_BYTES = 1 << 20

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes of `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_rng = np.random.Generator(np.random.PCG64(20240501))
#: A random value for each lower-cased byte, the base of the rolling hash and its inverse modulo 2**64.
_TABLE = _rng.integers(0, 2**64, size=256, dtype=U64)[LOWER]
_RAW = _rng.integers(0, 2**64, size=256, dtype=U64)
_BASE = int(_rng.integers(0, 2**62)) * 8 + 5
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Odd multipliers, one for each place in an n-gram.
PLACES = _rng.integers(0, 2**64, size=64, dtype=U64) | U64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2**64; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base % 2**64, dtype=U64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        have = _powers[base] = out
    return have[:n]


def rolling(buf: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Prefix sums from which span() takes the hash of any byte range; one entry more than bytes."""
    out = np.empty(len(buf) + 1, U64)
    out[0] = 0
    np.cumsum(table[buf] * powers(_BASE, len(buf)), out=out[1:])
    return out


def span(prefix: np.ndarray, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """The hash of each byte range, which depends on its bytes and length alone."""
    out = (prefix[starts + lengths] - prefix[starts]) * powers(_INVERSE, len(prefix))[starts]
    return mix(out + np.asarray(lengths).astype(U64) * U64(0xD6E8FEB86659FD93))


def raw(buf: np.ndarray) -> np.ndarray:
    """rolling() of the bytes as they are."""
    return rolling(buf, _RAW)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer text has a range of its own."""
    row, n = 0, len(offs) - 1
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def words(buf: np.ndarray, offs: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length) of each word, and each row's first word's index; one more entry at the end.

    A-Z are lower-cased before the alphabet is asked.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = alphabet[LOWER][buf]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    heads = offs[:-1]
    before[heads[heads < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:] & before[1:]  # a row's first byte never continues the row before
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends - starts, np.searchsorted(starts, offs)


def hashes(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each lower-cased word."""
    return span(rolling(buf, _TABLE), starts, lengths) if len(starts) else np.zeros(0, U64)


def ngrams(word: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive words of the array, row limits not regarded."""
    m = len(word) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = word[:m] * PLACES[0]
    for j in range(1, n):
        out += word[j : m + j] * PLACES[j]
    return mix(out + U64(n))


def within(first: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words from each word on lie in one row; first: words() gave it."""
    total = int(first[-1])
    good = np.zeros(max(0, total - n + 1), dtype=bool)
    if not len(good):
        return good
    counts = np.diff(first)
    row_end = np.repeat(first[1:], counts)[: len(good)]
    return np.arange(len(good)) + n <= row_end


def shingles(word: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first index of each row) of the n-word shingles; a row of fewer words, but not none, has one of them all."""
    counts = np.diff(first)
    grams = ngrams(word, n)[within(first, n)]
    short = (counts > 0) & (counts < n)
    per_row = np.maximum(counts - n + 1, 0)
    if not short.any():
        return grams, np.concatenate([[0], np.cumsum(per_row)])
    per_row[short] = 1
    out = np.empty(int(per_row.sum()), U64)
    at = np.concatenate([[0], np.cumsum(per_row)])
    own = np.zeros(len(out), dtype=bool)
    own[at[:-1][short]] = True
    out[~own] = grams
    rows = np.flatnonzero(short)
    acc = np.zeros(len(rows), U64)
    for j in range(n - 1):
        has = counts[rows] > j
        acc[has] += word[first[rows[has]] + j] * PLACES[j]
    out[own] = mix(acc + counts[rows].astype(U64))
    return out, at
