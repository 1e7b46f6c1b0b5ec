"""Word shingles as 64-bit hashes, computed for whole blocks of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import SPACE, mix, odd_numbers, utf8

_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True
PIECE = 1 << 18  # bytes that are hashed at once
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            a = np.full(max(n, PIECE), base, np.uint64)
            a[0] = 1
            _powers[i] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes that end behind a space, so that no word lies in two; a longer word is one range."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data):
            spaces = np.flatnonzero(_IS_SPACE[data[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            while end < len(data) and not len(spaces):
                spaces = np.flatnonzero(_IS_SPACE[data[end : end + PIECE]])
                end = end + int(spaces[0]) + 1 if len(spaces) else min(len(data), end + PIECE)
        yield at, end
        at = end


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, A-Z folded to a-z, and the n + 1 offsets of each text's words. Work arrays
    are those of a piece, whatever a text's length."""
    data, offsets = utf8(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    hashes, places = [], []
    for at, stop in _pieces(data):
        part, edge = data[at:stop], first[at : stop + 1]
        space = _IS_SPACE[part]
        begins = np.flatnonzero(~space & (edge[:-1] | np.concatenate(([True], space[:-1]))))
        ends = np.flatnonzero(~space & (edge[1:] | np.concatenate((space[1:], [True]))))
        up, down = _power(len(part))
        total = np.cumsum(_BYTE[part] * up)
        own = total[ends]
        later = begins > 0
        own[later] -= total[begins[later] - 1]
        hashes.append(mix(own * down[begins]))
        places.append(begins + at)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's distinct k-word shingles as sorted hashes; a text of fewer words is one shingle, none has none."""
    words, offsets = word_hashes(column)
    odd = odd_numbers(k + 1, 11)
    n = max(0, len(words) - k + 1)
    full = np.zeros(n, np.uint64)
    for j in range(k):
        full += mix(words[j : n + j] * odd[j])
    full = mix(full)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(full[a : b - k + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64) * odd[k]
            for j in range(b - a):
                short = short + mix(words[a + j : a + j + 1] * odd[j])
            out.append(mix(short))
        else:
            out.append(full[:0])
    return out


def minhashes(sets: list[np.ndarray], n: int) -> np.ndarray:
    """A row of n signature keys for each non-empty set: coordinate and minimum mixed to one 64-bit key."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    data = np.concatenate(sets)
    odd = odd_numbers(n, 13)
    out = np.empty((len(sets), n), np.uint64)
    for j in range(n):
        out[:, j] = mix(np.minimum.reduceat(data * odd[j], starts) ^ odd[j])
    return out
