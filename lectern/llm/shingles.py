"""Word shingles of whole texts as 64-bit hashes, and their SuperMinHash signatures, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import LOWER, SPACE, bytes_of, mix64, random64, slices

#: Words of a shingle, slots of a signature, slots hashed together in one band.
WORDS, SLOTS, ROWS = 5, 128, 4
_STEP = 1 << 18  # bytes of text at once; signatures take some hundred times as much
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = random64(256, 11) | np.uint64(1)
_PLACES = random64(WORDS + 1, 12) | np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for positions up to n."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, _STEP + (1 << 16))
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x % 2**64, np.uint64)]))
                      for x in (_BASE, pow(_BASE, -1, 2**64))]
    return _powers[0], _powers[1]


def _words(data: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts (``own``: their offsets in ``data``) and each text's first word's place."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(own), np.int64)
    power, inverse = _power_tables(len(data))
    data = LOWER[data]
    space = SPACE[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    before[own[:-1][own[:-1] < len(data)]] = True
    after[own[1:][own[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[:len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverse[starts]
    return mix64(hashes ^ ((ends - starts).astype(np.uint64) * _GOLD)), np.searchsorted(starts, own)


def _long_words(data: np.ndarray) -> np.ndarray:
    """The words of one very long text, piece by piece, cut where white space is."""
    found, at = [], 0
    while at < len(data):
        end = min(at + _STEP, len(data))
        while end < len(data) and not SPACE[data[end]]:
            ahead = np.flatnonzero(SPACE[data[end:end + _STEP]])
            end = end + int(ahead[0]) if len(ahead) else min(end + _STEP, len(data))
        found.append(_words(data[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _shingled(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``WORDS`` words."""
    n = len(words) - WORDS + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(WORDS):
        total += words[k:k + n] * _PLACES[k]
    return mix64(total)


def _short(words: np.ndarray) -> np.ndarray:
    """A sequence of fewer words is one shingle of its own kind."""
    return mix64((words * _PLACES[:len(words)]).sum(keepdims=True) ^ (_PLACES[WORDS] * np.uint64(len(words))))


def shingle_sets(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """For runs of rows, each row's distinct shingle hashes, sorted (none without words)."""
    raw, offsets = bytes_of(column)
    with np.errstate(over="ignore"):
        for a, b in slices(offsets, _STEP):
            own = offsets[a:b + 1] - offsets[a]
            data = raw[offsets[a]:offsets[b]]
            if b == a + 1 and len(data) > _STEP:
                words = _long_words(data)
                first = np.array([0, len(words)])
            else:
                words, first = _words(data, own)
            runs, sets = _shingled(words), []
            for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
                if e - s >= WORDS:
                    sets.append(np.unique(runs[s:e - WORDS + 1]))
                else:
                    sets.append(_short(words[s:e]) if e > s else words[:0])
            yield sets


def super_minhash(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures (Ertl 2017) of non-empty sets, one row of ``SLOTS`` values each.

    Step j gives each element of a set a value in [j, j + 1) and the next slot of the element's own random permutation
    (Fisher-Yates, one swap a step); each slot keeps its least value. The ranks of one element are correlated in that
    they never meet in a slot, which lowers the variance. A set stops at the first step that can't lower any slot.
    All sets of a run advance together.
    """
    x = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    best = np.full(len(sets) * SLOTS, np.iinfo(np.uint64).max, np.uint64)
    places: np.ndarray | None = None
    with np.errstate(over="ignore"):
        for j in range(SLOTS):
            r = mix64(x + np.uint64(j + 1) * _GOLD)
            k = (((r & np.uint64(0xFFFFFFFF)) * np.uint64(SLOTS - j)) >> np.uint64(32)).astype(np.int64) + j
            if places is None:
                slot = k
            else:
                at = np.arange(len(x))
                slot = places[at, k].astype(np.int64)
                places[at, k] = places[at, j]
            np.minimum.at(best, row * SLOTS + slot, (np.uint64(j) << np.uint64(56)) | (r >> np.uint64(8)))
            active = best.reshape(-1, SLOTS).max(1) >= np.uint64(j + 1) << np.uint64(56)
            stay = active[row]
            if not stay.any():
                break
            if places is None:
                x, row, k = x[stay], row[stay], k[stay]
                places = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(x), 1))
                places[np.arange(len(x)), k] = 0
            elif not stay.all():
                x, row, places = x[stay], row[stay], places[stay]
    return best.reshape(-1, SLOTS)


def bands(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit hash per band of ``ROWS`` slots."""
    with np.errstate(over="ignore"):
        parts = mix64(signatures).reshape(len(signatures), -1, ROWS)
        total = (np.arange(parts.shape[1], dtype=np.uint64) * _GOLD)[None, :]
        for i in range(ROWS):
            total = total + parts[:, :, i] * _PLACES[i]
        return mix64(total).view(np.int64)


def sketch(signatures: np.ndarray) -> np.ndarray:
    """One byte per slot: enough to estimate a similarity."""
    return (mix64(signatures) >> np.uint64(56)).astype(np.uint8)
