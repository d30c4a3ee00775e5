"""Words of many texts at once, as arrays: places, 64-bit hashes and owners."""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240607))
#: Odd, so that it has an inverse modulo 2**64.
_BASE = int(_rng.integers(1 << 62, 1 << 63)) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_CODE[_SPACE] = 0
#: Bytes hashed at a time, but for the rest of the last word; powers of the base and its inverse are kept for twice as many.
PIECE = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out


_UP, _DOWN = _powers(_BASE, 2 * PIECE), _powers(_INVERSE, 2 * PIECE)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the hash over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashes(low: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of the word at each start, in runs of whole words of about ``PIECE`` bytes: only a longer word needs more at once."""
    out = np.empty(len(starts), np.uint64)
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(low), PIECE)), len(starts)))
    for a, b in zip(cuts[:-1], cuts[1:]):
        begin, end = int(starts[a]), int(starts[b]) if b < len(starts) else len(low)
        code, at = _CODE[low[begin:end]], starts[a:b] - begin
        up, down = (_UP, _DOWN) if len(code) <= len(_UP) else (_powers(_BASE, len(code)), _powers(_INVERSE, len(code)))
        code *= up[: len(code)]
        out[a:b] = np.add.reduceat(code, at) * down[at]
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of texts, one after another, and their n + 1 offsets ->
    lower-cased bytes, start and end of each word, its hash, the number of its text.

    Words are runs without ASCII white space; A-Z are lower-cased; no word spans two texts.
    """
    low = _LOWER[data]
    n = len(low)
    if not n:
        none = np.empty(0, np.int64)
        return low, none, none, np.empty(0, np.uint64), none
    space = _SPACE[low]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(~space & (np.concatenate([[True], space[:-1]]) | border[:-1]))
    ends = np.flatnonzero(~space & (np.concatenate([space[1:], [True]]) | border[1:])) + 1
    if not len(starts):
        return low, starts, ends, np.empty(0, np.uint64), starts
    owner = np.searchsorted(offsets, starts, side="right") - 1
    return low, starts, ends, mix(_hashes(low, starts)), owner
