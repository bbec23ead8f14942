"""Vectorised word and shingle hashing over batches of texts (numpy, inside tasks).

A batch of texts becomes one byte buffer; word boundaries, 64-bit word hashes
and k-word shingle hashes are computed with whole-array operations, so the
cost is a few passes over the bytes. Word hashes are polynomials over random
byte values modulo 2**64 with an odd base, finished with a mixing function;
they depend on the bytes alone and are equal on every executor.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_SHINGLE_BASE = np.uint64(0xD6E8FEB86659FD93)
_SHINGLE_INVERSE = pow(int(_SHINGLE_BASE), -1, 1 << 64)
_SHORT_SALT = np.uint64(0xA0761D6478BD642F)
BATCH_BYTES = 1 << 20

# x20 and x09-x0D: the word separators of the near-duplicate operators.
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# Everything but ASCII letters, digits and bytes of non-ASCII characters.
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[0x41:0x5B] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit values (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(separators: np.ndarray) -> np.ndarray:
    values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    values[separators] = 0
    return values


def _new_powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


@lru_cache(maxsize=4)
def _kept_powers(base: int) -> np.ndarray:
    p = _new_powers(base, BATCH_BYTES + (1 << 16))
    p.flags.writeable = False
    return p


def _powers(base: int, n: int) -> np.ndarray:
    """The powers 0 to n - 1; those for batches of the usual size are kept."""
    kept = _kept_powers(base)
    return kept[:n] if n <= len(kept) else _new_powers(base, n)


def pack(texts: list, lower_ascii: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one space after each, and each text's start.
    None counts as empty."""
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    buf = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    return (ASCII_LOWER[buf] if lower_ascii else buf), starts


def word_spans(buf: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every maximal run of non-separator bytes."""
    inside = (~separators[buf]).view(np.int8)
    edge = np.diff(inside, prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """64-bit hash of each word; ``starts`` as given by :func:`word_spans`."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    terms = _byte_values(separators)[buf]
    terms *= _powers(_BASE, len(buf))
    return mix64(np.add.reduceat(terms, starts) * _powers(_INVERSE, len(buf))[starts])


def hashed_words(texts: list, separators: np.ndarray = ASCII_SPACE, lower_ascii: bool = True):
    """Word hashes of all texts in order, and ``first``: text i has the words
    ``first[i]:first[i + 1]``."""
    buf, at = pack(texts, lower_ascii)
    starts, _ = word_spans(buf, separators)
    return word_hashes(buf, starts, separators), np.searchsorted(starts, at)


def _fold(h: np.ndarray, k: int) -> np.ndarray:
    """Polynomials of every k values, as differences of sums from the first value on (modulo 2**64, so exact)."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(_SHINGLE_INVERSE, len(h)), out=sums[1:])
    return mix64((sums[k:] - sums[:-k]) * _powers(int(_SHINGLE_BASE), len(h))[k - 1:])


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (crossing text ends; see callers)."""
    return _fold(h, k) if len(h) >= k else np.zeros(0, np.uint64)


def shingle_sets(h: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; with fewer
    words the whole sequence is the one shingle; without words, empty."""
    rolled = rolling(h, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = b - a
        if n >= k:
            out.append(np.unique(rolled[a:b - k + 1]))
        elif n:
            out.append(mix64(_fold(h[a:b], n) ^ (_SHORT_SALT * np.uint64(n))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    """Signed 64-bit identity of a non-empty set of hashes."""
    with np.errstate(over="ignore"):
        folded = mix64(mix64(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))
    return int(folded.view(np.int64)[0])


def distinct_shingles(h: np.ndarray, begin: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of :func:`shingle_sets` (in any order inside) of the sequences
    ``h[begin[i]:begin[i] + n[i]]`` of at least one word, all at once: values, and
    ``first``: set i is ``values[first[i]:first[i + 1]]``."""
    counts = np.maximum(n - k + 1, 1)
    first = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(n)), counts)
    rolled = rolling(h, k) if len(h) >= k else np.zeros(1, np.uint64)
    values = rolled[np.minimum(np.arange(first[-1]) + (begin - first[:-1])[owner], len(rolled) - 1)]
    for i in np.flatnonzero(n < k).tolist():
        values[first[i]] = mix64(_fold(h[begin[i]:begin[i] + n[i]], int(n[i])) ^ (_SHORT_SALT * n[i:i + 1].astype(np.uint64)))[0]
    salted = values + mix64(np.arange(1, len(n) + 1, dtype=np.uint64))[owner]
    order = np.argsort(salted)
    same = (np.diff(salted[order]) == 0) & (np.diff(owner[order]) == 0)
    if not same.any():
        return values, first
    keep = np.ones(len(values), bool)
    keep[order[1:][same]] = False
    return values[keep], np.concatenate([[0], np.cumsum(np.add.reduceat(keep, first[:-1], dtype=np.int64))])


def set_ids(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """:func:`set_id` of each of the non-empty sets ``values[first[i]:first[i + 1]]``."""
    if len(first) < 2:
        return np.zeros(0, np.int64)
    return mix64(np.add.reduceat(mix64(values), first[:-1]) + np.diff(first).astype(np.uint64)).view(np.int64)


def slices(sizes: list[int], limit: int = BATCH_BYTES):
    """Consecutive index ranges whose sizes add up to ``limit`` at most (or one item)."""
    a = total = 0
    for i, n in enumerate(sizes):
        if i > a and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if len(sizes) > a:
        yield a, len(sizes)


def portions(batch, column: int):
    """Slices of a record batch whose texts in ``column`` have about ``BATCH_BYTES``
    (or one row), so that few texts are Python objects at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for a, b in slices(sizes):
        yield batch.slice(a, b - a)
