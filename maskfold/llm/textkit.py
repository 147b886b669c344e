"""Vectorised scanning of UTF-8 text in Arrow batches.

Everything here works on the bytes of a whole batch at once: word borders from a table of
byte classes, hashes of spans, and windows of words. Batches are cut into slices of about ``SLICE`` bytes,
never inside a document, so memory follows the longest document and not the batch.

Spans are hashed by a polynomial modulo the prime 2**61 - 1. (Modulo a power of two every odd base fails on one and
the same pairs of texts, Thue-Morse sequences and their complements; a prime has none of that kind.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 17

U = np.uint64
_random = np.random.Generator(np.random.PCG64(20240229))
_STEPS = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
PRIME = (1 << 61) - 1
_BASE = 0x0DF3A1C7B2E4956B % PRIME
#: Bytes that one sum of products may cover: each is below 2**40.
_PIECE = 1 << 20

#: Bytes that are not white space: words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, letters and every byte of a character beyond ASCII: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-case text.
ALNUM_LOWER = np.zeros(256, bool)
ALNUM_LOWER[0x30:0x3A] = ALNUM_LOWER[0x61:0x7B] = ALNUM_LOWER[0x80:] = True
#: Lower-cases A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: list[np.ndarray] = []


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo the prime, for at least n steps: their low 31 bits and the rest."""
    if not _powers or len(_powers[0]) < n:
        out, step = np.ones(1, U), _BASE
        while len(out) < max(n, 1 << 12):
            out = np.concatenate([out, _times(out, step)])
            step = step * step % PRIME
        _powers[:] = [out & U((1 << 31) - 1), out >> U(31)]
    return _powers[0], _powers[1]


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & U(PRIME)) + (x >> U(61))
    return np.where(x >= U(PRIME), x - U(PRIME), x)


def _shifted(x: np.ndarray) -> np.ndarray:
    """x * 2**31 modulo the prime, not fully reduced; x is below 2**62."""
    return (x >> U(30)) + ((x & U((1 << 30) - 1)) << U(31))


def _times(a: np.ndarray, b: int) -> np.ndarray:
    """a * b modulo the prime."""
    a0, a1, b0, b1 = a & U((1 << 31) - 1), a >> U(31), U(b & ((1 << 31) - 1)), U(b >> 31)
    return _reduced(_reduced(a0 * b0) + _reduced(U(2) * a1 * b1) + _reduced(_shifted(a0 * b1 + a1 * b0)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings in a row, and where each begins (one entry more than strings). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents with at most ``limit`` bytes, or one longer document."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j
        i = j


def _sums(data: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The polynomial of each of some non-empty spans that have at most ``_PIECE`` bytes each."""
    begin = np.cumsum(n) - n
    within = np.arange(n.sum()) - np.repeat(begin, n)
    low, high = _power_table(int(n.max()))
    value = data[np.repeat(start, n) + within].astype(U) + U(1)
    low, high = np.add.reduceat(low[within] * value, begin), np.add.reduceat(high[within] * value, begin)
    return _reduced(_reduced(low) + _reduced(_shifted(high)))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, which must not be empty; it does not depend on where they lie."""
    n = end - start
    out = np.zeros(len(n), U)
    at = np.concatenate([[0], np.cumsum(n)])
    i = 0
    while i < len(n):
        if n[i] > _PIECE:
            total = 0
            for k in range(int(start[i]), int(end[i]), _PIECE):
                piece = _sums(data, np.array([k]), np.array([min(_PIECE, int(end[i]) - k)]))
                total += int(piece[0]) * pow(_BASE, k - int(start[i]), PRIME)
            out[i] = total % PRIME
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(at, at[i] + _PIECE, "right")) - 1)
        if (long := np.flatnonzero(n[i:j] > _PIECE)).size:
            j = i + int(long[0])
        out[i:j] = _sums(data, start[i:j], n[i:j])
        i = j
    return mix(out + n.astype(U) * U(0x9E3779B97F4A7C15))


def counts_before(flags: np.ndarray) -> np.ndarray:
    """How many are set before each place; one entry more than flags."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def word_spans(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of each word; words end at the ends of documents."""
    inside = is_word[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    border = at[(at > 0) & (at < n)]
    first[border] = inside[border]
    last[border - 1] = inside[border - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(at, start, "right") - 1


def window_hash(word: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, from the words' hashes; documents are not looked at."""
    n = len(word) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = word[:n] * _STEPS[0]
    for k in range(1, size):
        out += word[k : k + n] * _STEPS[k]
    return mix(out + U(size))


def windows_inside(doc: np.ndarray, size: int) -> np.ndarray:
    """Which of the runs of ``size`` words lie in one document."""
    n = len(doc) - size + 1
    return doc[:n] == doc[size - 1 :] if n > 0 else np.zeros(0, bool)


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in one of the runs of ``size`` words that begin at ``starts`` (each given once)."""
    change = np.zeros(n + 1, np.int64)
    change[starts] += 1
    change[starts + size] -= 1
    return np.cumsum(change[:n]) > 0


def keyed(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One number for a document number and a hash in it."""
    return mix(value + (doc.astype(np.uint64) + U(1)) * U(0x9E3779B97F4A7C15))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        ordered = keys[order]
        same = ordered[1:] == ordered[:-1]
        twice = np.zeros(len(keys), bool)
        twice[1:] |= same
        twice[:-1] |= same
        out[order] = twice
    return out
