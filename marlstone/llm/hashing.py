"""Hashes of a text's words, all at once.

A word's hash is a polynomial of its bytes modulo 2^64, mixed. Prefix sums over the text's bytes give every word's
polynomial as a difference, which the inverse powers of the (odd) base move to the word's start. Equal words have equal hashes
wherever they stand. Texts are cut at white space into parts of about `PART` bytes, so memory follows the longest word.
"""

from __future__ import annotations

import numpy as np

PART = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(1, _U)
    while len(out) < n:
        step = _U(pow(base, len(out), 1 << 64))
        out = np.concatenate([out, out * step])
    return out[:n]


_up, _down = _powers(_BASE, PART), _powers(pow(_BASE, -1, 1 << 64), PART)


def _part(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    solid = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    n = len(raw)
    up, down = (_up, _down) if n <= PART else (_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n))
    sums = np.zeros(n + 1, _U)
    np.cumsum((raw.astype(_U) + _U(1)) * up[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h, starts, ends


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of a text, which ASCII white space cuts."""
    whole = np.frombuffer(raw, np.uint8)
    if len(whole) <= PART:
        return _part(whole)
    found, at = [], 0
    while at < len(whole):
        end = at + PART
        while end < len(whole):  # on to the next white space
            gaps = np.flatnonzero(_SPACE[whole[end : end + PART]])
            if len(gaps):
                end += int(gaps[0])
                break
            end += PART
        h, starts, ends = _part(whole[at:end])
        found.append((h, starts + at, ends + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found))
