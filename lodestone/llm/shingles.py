"""Word shingles of whole texts as arrays, from Arrow's own buffers.

A word is a run of ASCII letters, digits and bytes of non-ASCII characters, in ASCII lower case; everything else separates. A shingle is five
words in a row; a text of one to four words is one shingle, a text without words has none. Hashes have 44 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS, HASH_BITS = 5, 44
#: Bytes of text worked on at a time; a longer text is worked on alone.
CHUNK = 1 << 19
_rng = np.random.default_rng(20)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Fixed value: an odd base, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.zeros(256, np.uint8)
_LOWER[128:] = np.arange(128, 256)
for _a, _b in ((48, 58), (97, 123)):
    _LOWER[_a:_b] = np.arange(_a, _b)
_LOWER[65:91] = np.arange(97, 123)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                x = np.full(max(n, CHUNK + 1), base, np.uint64)
                x[0] = 1
                _powers[k] = np.cumprod(x)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of pieces of a string column of about CHUNK bytes; nulls are empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle), with repeats, in order of the text."""
    return placed(data, offsets)[:2]


def placed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As shingles(), and the bytes where each begins and ends."""
    low = _LOWER[data]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    is_word = np.append(low != 0, False)
    start = is_word.copy()
    start[1:] &= ~is_word[:-1] | edge[1:]
    end = is_word.copy()  # the last byte of a word
    end[:-1] &= ~is_word[1:] | edge[1:]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(start):
        return none
    up, down = _power(len(low) + 1)
    run = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_VALUE[low] * up[: len(low)], out=run[1:])
    word = mix((run[end] - run[start]) * down[start])
    doc = np.searchsorted(offsets, start, side="right") - 1
    n = len(word)
    later = np.zeros(n, np.int64)  # words of its text from this one on, WORDS at most
    out = np.zeros(n, np.uint64)
    for k in range(min(WORDS, n)):
        same = np.zeros(n, bool)
        same[: n - k] = doc[: n - k] == doc[k:]
        later += same
        out[: n - k] += np.where(same[: n - k], word[k:] * _PLACE[k], np.uint64(0))
    first = np.ones(n, bool)
    first[1:] = doc[1:] != doc[:-1]
    kept = (later == WORDS) | first
    last = np.flatnonzero(kept) + later[kept] - 1
    return doc[kept], mix(out[kept] + later[kept].astype(np.uint64)) >> np.uint64(64 - HASH_BITS), start[kept], end[last]


def distinct(doc: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, times), ascending; of 2**20 texts or fewer."""
    keys = np.sort((doc.astype(np.uint64) << np.uint64(HASH_BITS)) | shingle)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    return (keys >> np.uint64(HASH_BITS)).astype(np.int64), keys & np.uint64((1 << HASH_BITS) - 1), times
