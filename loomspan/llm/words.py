"""Word and shingle hashes of Arrow batches, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(256, _BASE), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd multipliers of the places in a shingle.
_ODD = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and the row offsets; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 1 << 20):
    """Row ranges of about ``most`` bytes; a longer row stands alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of each row, A-Z lower-cased, and the rows' word offsets."""
    global _POWERS
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(solid[:-1], out=before[1:])
    before[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(solid & before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    lead = starts[0]
    place = np.arange(lead, n, dtype=np.int64)
    place -= np.repeat(starts, np.diff(np.append(starts, n)))
    longest = int(np.diff(np.append(starts, n)).max())
    if longest > len(_POWERS):
        _POWERS = np.cumprod(np.full(longest, _BASE), dtype=np.uint64)
    value = (_LOWER[data[lead:]].astype(np.uint64) + np.uint64(1)) * _POWERS[place]
    value *= solid[lead:]
    return mixed(np.add.reduceat(value, starts - lead)), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row and their offsets; a row of fewer words gives its whole sequence as one, an empty row none."""
    counts = np.diff(offsets)
    m = len(words)
    out_counts = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(out_counts)])
    if not m:
        return np.zeros(0, np.uint64), out_offsets
    padded = np.concatenate([words, np.zeros(k - 1, np.uint64)])
    total = padded[:m] * _ODD[0]
    for j in range(1, k):
        total += padded[j : m + j] * _ODD[j]
    start = np.arange(out_offsets[-1]) - np.repeat(out_offsets[:-1] - offsets[:-1], out_counts)
    total = mixed(total)[start]
    for row in np.flatnonzero((counts > 0) & (counts < k)):
        few = words[offsets[row] : offsets[row + 1]]
        total[out_offsets[row]] = mixed(np.array([(few * _ODD[: len(few)]).sum() + np.uint64(len(few))]))[0]
    return total, out_offsets


def shingle_sets(texts: pa.Array, k: int = 5):
    """For each row, its sorted distinct shingle hashes."""
    data, offsets = raw(texts)
    for a, b in pieces(offsets):
        part = offsets[a : b + 1]
        hashes, cuts = shingles(*word_hashes(data[part[0] : part[-1]], part - part[0]), k)
        for i in range(b - a):
            yield np.unique(hashes[cuts[i] : cuts[i + 1]])
