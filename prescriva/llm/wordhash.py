"""64-bit fingerprints of the words of a whole Arrow batch, without a Python object per word.

A word's bytes b0..bn have the polynomial hash sum(R[bi] * B**i) modulo 2**64, with one
random odd number R for each byte value. Running sums over the batch's bytes give
every word's hash by one subtraction and one multiplication with a power of B's
inverse; a mixing step then spreads it over all bits. Two given words have equal
fingerprints with a chance of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEED = np.random.default_rng(20_240_601)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Space and the control characters 9 to 13 part words; all else is part of one.
WHITE = np.zeros(256, dtype=bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
#: All of ASCII but letters and digits parts words.
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; at least n of them."""
    kept = _POWERS.get(base)
    if kept is None or len(kept) < n:
        steps = np.full(max(n, (1 << 19) + 1), base, dtype=np.uint64)
        steps[0] = 1
        kept = _POWERS[base] = np.multiply.accumulate(steps)
    return kept


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each begins (and the last ends); a null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(column: pa.Array, separators: np.ndarray = WHITE, most: int = 1 << 19, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(fingerprints of words, words in each document) for runs of whole documents of about ``most`` bytes.

    ASCII capitals count as small letters. Documents without words have a count of 0.
    With ``prefixes`` the fingerprints are a matrix: of the word, then of its first so
    many bytes.
    """
    data, offsets = text_bytes(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield _hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], separators, prefixes)
        i = j


def _hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.empty((0, 1 + len(prefixes)) if prefixes else 0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    word = ~separators[data]
    before, after = np.empty_like(word), np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    after[-1], after[:-1] = False, word[1:]
    inner = offsets[:-1]
    before[inner[inner < len(data)]] = False
    inner = offsets[1:]
    after[inner[inner > 0] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[FOLD[data]] * _powers(_BASE, len(data))[: len(data)], out=sums[1:])
    back = _powers(_INVERSE, len(data) + 1)[starts]
    until = [ends, *(np.minimum(ends, starts + k) for k in prefixes)]
    hashes = [mix((sums[e] - sums[starts]) * back ^ ((e - starts + 64 * i).astype(np.uint64) << np.uint64(48))) for i, e in enumerate(until)]
    return (np.stack(hashes, axis=1) if prefixes else hashes[0]), np.diff(np.searchsorted(starts, offsets))
