"""Whole texts to words and their 64-bit hashes, vectorised over an Arrow batch's bytes.

A word is a maximal run of letters, marks and digits (Unicode categories L, M and N), lower-cased; a character of a script
that is written without spaces is a word of its own. Word hashes are sums of the
word's bytes, each times a random multiplier of its place, modulo 2**64, then mixed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[128:] = True
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _IS_WORD[_c] = True
#: Scripts written without spaces (fixed values: ranges of code points).
UNSPACED = (
    (0x0E00, 0x0EFF),  # Thai, Lao
    (0x1000, 0x109F),  # Myanmar
    (0x1780, 0x17FF),  # Khmer
    (0x3040, 0x30FF),  # Hiragana, Katakana
    (0x3400, 0x4DBF),  # Han
    (0x4E00, 0x9FFF),
    (0xF900, 0xFAFF),
    (0x20000, 0x3FFFF),
)
_PART, _ALONE, _CODES = 1, 2, 0x40000
#: Bytes of text worked on at once; a longer single text is worked on whole.
SLICE = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Bytes hashed at once.
STEP = 1 << 19
_ODDS: dict[int, np.ndarray] = {}


def _multipliers(seed: int, places: np.ndarray) -> np.ndarray:
    return mix(places.astype(U) * _BASE + U(2 * seed + 1)) | U(1)


def _odds(seed: int, places: np.ndarray) -> np.ndarray:
    """The multiplier of each place in a run: random odd values of 64 bits, of the first places from a table."""
    if seed not in _ODDS:
        _ODDS[seed] = _multipliers(seed, np.arange(1 << 12))
    table = _ODDS[seed]
    if not len(places) or int(places.max()) < len(table):
        return table[places]
    return _multipliers(seed, places)


@dataclass
class Words:
    """The words of some texts: ``hashes`` of all words, text ``i`` having those from ``bounds[i]`` to ``bounds[i + 1]``.
    ``starts`` and ``ends`` are places in ``data``, the lower-cased bytes of the slice."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """For each code point below ``_CODES``: 0 between words, else ``_PART`` or ``_ALONE``. Those beyond are between words."""
    out = np.array([_PART if unicodedata.category(chr(c))[0] in "LMN" else 0 for c in range(_CODES)] + [0], np.uint8)
    for a, b in UNSPACED:
        out[a : b + 1] *= _ALONE
    return out


def _beyond_ascii(data: np.ndarray, inside: np.ndarray, breaks: np.ndarray) -> None:
    """Takes characters that are not in words out of ``inside``, and marks in ``breaks`` where words of one character begin and
    where the next one begins."""
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return
    size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    code = data[lead].astype(np.int32) & (0xFF >> (size + 1))
    for k in (1, 2, 3):
        more = size > k
        code = np.where(more, code << 6 | (data[np.where(more, lead + k, lead)] & 0x3F), code)
    kind = _kinds()[np.minimum(code, _CODES)]
    for k in range(4):
        inside[(lead + k)[(kind == 0) & (size > k)]] = False
    alone = kind == _ALONE
    breaks[lead[alone]] = breaks[(lead + size)[alone]] = True


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its texts in them; null texts are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None and len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each."""
    if not len(texts):
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
    which = (np.cumsum(lengths) - lengths) // most
    cuts = np.flatnonzero(np.diff(which)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True)


def hash_runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of runs that lie one after another without gaps in ``data``: the sum of each byte times its place's multiplier,
    mixed. Bytes are taken ``STEP`` at a time, so that a run of any length needs no more memory than that."""
    sums = np.zeros(len(starts), U)
    full = np.flatnonzero(lengths)
    begins, ends = starts[full], starts[full] + lengths[full]
    for lo in range(0, len(data), STEP):
        hi = min(lo + STEP, len(data))
        runs = np.arange(np.searchsorted(ends, lo, "right"), np.searchsorted(begins, hi, "left"))
        first = np.maximum(begins[runs], lo)
        places = np.arange(lo, hi) - np.repeat(begins[runs], np.minimum(ends[runs], hi) - first)
        terms = _odds(seed, places)
        terms = terms * (data[lo:hi].astype(U) + U(1))
        sums[full[runs]] += np.add.reduceat(terms, first - lo)
    return mix(sums)


def split_words(texts: pa.Array) -> Words:
    data, offsets = text_bytes(pc.utf8_lower(texts))
    inside = _IS_WORD[data]
    breaks = np.zeros(len(data) + 1, bool)
    breaks[offsets] = True  # a text begins anew
    _beyond_ascii(data, inside, breaks)
    goes_on = np.zeros(len(data) + 1, bool)  # a word does, into this byte
    goes_on[1:-1] = inside[1:] & inside[:-1]
    goes_on &= ~breaks
    starts, ends = np.flatnonzero(inside & ~goes_on[:-1]), np.flatnonzero(inside & ~goes_on[1:]) + 1
    lengths = ends - starts
    packed = np.cumsum(lengths) - lengths
    return Words(hash_runs(data[inside], packed, lengths), np.searchsorted(starts, offsets), starts, ends, data)


def fold(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive words; the run that begins at word i is at place i."""
    if len(hashes) < size:
        return np.zeros(0, U)
    n = len(hashes) - size + 1
    out = np.zeros(n, U)
    for k in range(size):
        out = out * _BASE + hashes[k : k + n]
    return mix(out)
