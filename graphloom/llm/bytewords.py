"""Words of many texts at once: byte arrays in, positions and 64-bit hashes out, with numpy only.

Texts stay in the UTF-8 buffer of an Arrow column; nothing is made a Python string. Both word patterns in use cut
at ASCII characters only, so each byte is of a word or not by itself, and bytes over 0x7F always are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240601)
LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.cumprod(np.full(256, STEP), dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: word bytes of `[^\x20\x09-\x0D]+`, and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
BLANK_CUT = np.ones(256, bool)
BLANK_CUT[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_CUT = np.zeros(256, bool)
ALNUM_CUT[0x30:0x3A] = ALNUM_CUT[0x61:0x7B] = ALNUM_CUT[0x80:] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a hash over all bits, so that its order is as good as random."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each text's bounds in them; a null is empty."""
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words_of(raw: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes), hash of every word with A-Z lower-cased, and for each text its first word's number (one more at the end)."""
    low = LOWER[raw]
    inside = table[low]
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    begins, stops = inside.copy(), inside.copy()
    if len(raw):
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, bounds)
    return starts, ends, word_hashes(low[inside], ends - starts), first


def word_hashes(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat: the words' bytes without what is between them."""
    global _powers
    if not len(lengths):
        return np.zeros(0, np.uint64)
    if (most := int(lengths.max())) > len(_powers):
        _powers = np.cumprod(np.full(most, STEP), dtype=np.uint64)
    begin = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=begin[1:])
    place = np.arange(len(flat), dtype=np.int32) - np.repeat(begin.astype(np.int32), lengths)
    return mixed(np.add.reduceat(LETTER[flat] * _powers[place], begin) + lengths.astype(np.uint64))


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words that lie within a text, or of the whole of a shorter text; and each text's bounds in them."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    bounds = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=bounds[1:])
    factors = [(n_ * pow(int(STEP), j, 1 << 64)) % (1 << 64) for n_ in range(k + 1) for j in range(k)]
    factors = np.array(factors, np.uint64).reshape(k + 1, k)  # by length, by place
    total = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k if len(total) else 0):
        total += h[j : len(h) - k + 1 + j] * factors[k, j]
    out = np.zeros(bounds[-1], np.uint64)
    full = n >= k
    if full.any():
        take = np.repeat(first[:-1][full], count[full]) + np.arange(count[full].sum()) - np.repeat(np.cumsum(count[full]) - count[full], count[full])
        where = np.repeat(bounds[:-1][full], count[full]) + (np.arange(len(take)) - np.repeat(np.cumsum(count[full]) - count[full], count[full]))
        out[where] = total[take]
    for i in np.flatnonzero((n > 0) & (n < k)):
        out[bounds[i]] = (h[first[i] : first[i + 1]] * factors[n[i], : n[i]]).sum(dtype=np.uint64)
    return mixed(out), bounds
