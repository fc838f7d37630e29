"""Ids of a corpus's words, kept by a worker and dealt out to many texts at once.

Texts of words with one space or line end between lie end to end, and each word with the character before it is a unit. Arrow
numbers the distinct units; these alone are looked up, by hashes and then by their bytes, and their ids are dealt
out by number. The table is flat arrays of about 50 bytes a word. It is bounded by bytes: beyond, the half goes
that was met longest ago.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from marlstone.llm import hashing

# of a byte: 1 a space or line end, 2 other ASCII white space to Python, 3 the first of other white space, perhaps
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 11, 12, 13, 28, 29, 30, 31]], _KIND[[10, 32]], _KIND[[0xC2, 0xE1, 0xE2, 0xE3]] = 2, 1, 3


def cuts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of spaces and line ends, places in or right before what isn't words with one of these between) of UTF-8 that begins and ends with one."""
    kind = _KIND[raw]
    found, first = np.flatnonzero(kind == 1), np.flatnonzero(kind == 3)
    lead, a, b = raw[first], raw[first + 1], raw[np.minimum(first + 2, len(raw) - 1)]
    space = (lead == 0xC2) & ((a == 0x85) | (a == 0xA0)) | (lead == 0xE1) & (a == 0x9A) & (b == 0x80) | (lead == 0xE3) & (a == 0x80) & (b == 0x80)
    space |= (lead == 0xE2) & ((a == 0x80) & ((b <= 0x8A) | (b == 0xA8) | (b == 0xA9) | (b == 0xAF)) | (a == 0x81) & (b == 0x9F))
    return found, np.concatenate([found[:-1][np.diff(found) == 1], np.flatnonzero(kind == 2), first[space]])


def _bytes(units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends) of a large string or binary array."""
    ends = np.frombuffer(units.buffers()[1], np.int64)[: len(units) + 1]
    return np.frombuffer(units.buffers()[2] or b"", np.uint8)[: ends[-1]], ends


class Words:
    """Units (a space or line end, then a word without ASCII white space) and their ids (unsigned 32-bit, little-endian), as `learn` gives them for a list."""

    def __init__(self, learn: Callable[[list[str]], list[bytes]], limit: int):
        self.learn, self.limit = learn, limit
        self.clear()

    def clear(self) -> None:
        self.units, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.hashes, self.places, self.met = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32)
        self.now = 0

    def __len__(self) -> int:
        return len(self.units)

    def trim(self) -> None:
        """Drops the half that was met longest ago if the table is beyond its bytes."""
        if self.units.nbytes + self.ids.nbytes + 16 * len(self) > self.limit:
            keep = self.met > np.median(self.met)
            self.units, self.ids, self.met = self.units.filter(pa.array(keep)), self.ids.filter(pa.array(keep)), self.met[keep]
            kept = keep[self.places]
            self.hashes, self.places = self.hashes[kept], (np.cumsum(keep) - 1)[self.places[kept]].astype(np.int32)
        self.now += 1

    def _add(self, units: pa.Array, h: np.ndarray, ids: pa.Array) -> np.ndarray:
        new = np.arange(len(self), len(self) + len(units))
        order = np.argsort(h)
        at = np.searchsorted(self.hashes, h[order])
        self.hashes, self.places = np.insert(self.hashes, at, h[order]), np.insert(self.places, at, new[order])
        self.units, self.ids = pa.concat_arrays([self.units, units]), pa.concat_arrays([self.ids, ids])
        self.met = np.concatenate([self.met, np.full(len(units), self.now, np.int32)])
        return new

    def numbers(self, units: pa.Array) -> np.ndarray:
        """The rows of distinct units, which are learnt if the table lacks them."""
        if not len(units):
            return np.empty(0, np.int64)
        raw, ends = _bytes(units)
        h = hashing.words(raw.tobytes())[0] ^ np.where(raw[ends[:-1]] == 10, np.uint64(0x5851F42D4C957F2D), np.uint64(0))
        out = np.full(len(units), -1)
        if len(self):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self) - 1)
            near = np.flatnonzero(self.hashes[at] == h)
            rows = self.places[at[near]]
            same = pc.equal(self.units.take(pa.array(rows)), units.take(pa.array(near))).to_numpy(zero_copy_only=False)
            out[near[same]] = rows[same]
        lacking = np.flatnonzero(out < 0)
        if len(lacking):
            new = units.take(pa.array(lacking))
            out[lacking] = self._add(new, h[lacking], pa.array(self.learn(new.to_pylist()), pa.large_binary()))
        self.met[out] = self.now
        return out

    def of(self, units: list[str]) -> list[bytes]:
        """The ids of units, which may be equal."""
        coded = pa.array(units, pa.large_string()).dictionary_encode()
        rows = self.numbers(coded.dictionary)
        return self.ids.take(pa.array(rows[coded.indices.to_numpy()])).to_pylist()

    def deal(self, raw: np.ndarray, found: np.ndarray, heads: np.ndarray) -> list[bytes]:
        """The ids of texts that `cuts` finds to be plain, from their bytes, all places of spaces and line ends, and those where texts begin, with the end."""
        coded = pa.Array.from_buffers(pa.large_string(), len(found) - 1, [None, pa.py_buffer(found), pa.py_buffer(raw)]).dictionary_encode()
        rows = self.numbers(coded.dictionary)
        held, ends = _bytes(self.ids.take(pa.array(rows)).take(coded.indices))
        ends = ends[np.searchsorted(found, heads)].tolist()
        return [held[a:b].tobytes() for a, b in zip(ends, ends[1:])]


def grouped(texts: list[str], size: int) -> list[list[str]]:
    """Texts in order, in lists of about `size` characters at most, or of one longer text."""
    out, held = [], 0
    for t in texts:
        if not out or held + len(t) > size:
            out.append([])
            held = 0
        out[-1].append(t)
        held += len(t)
    return out


def encoded(words: Words, texts: list[str], lead: bytes, skip: int, other: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    """The ids of non-empty texts: of plain ones by their words, `lead` (a space or line end) before the first, without the first `skip` bytes; `other` gives those of all others."""
    out: list[bytes] = [b""] * len(texts)
    left = list(range(len(texts)))
    while left:
        coded = [texts[k].encode() for k in left]
        heads = np.cumsum([0, *(len(c) + 1 for c in coded)])
        raw = np.frombuffer(lead + lead.join(coded) + lead, np.uint8)
        found, breaks = cuts(raw)
        if not len(breaks):
            for k, ids in zip(left, words.deal(raw, found, heads)):
                out[k] = ids[skip:]
            break
        odd = np.unique(np.searchsorted(heads, breaks, "right") - 1).tolist()
        for i, ids in zip(odd, other([texts[left[i]] for i in odd])):
            out[left[i]] = ids
        gone = set(odd)
        left = [k for i, k in enumerate(left) if i not in gone]
    return out
