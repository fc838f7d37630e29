"""Token ids by the tokenizers library, with each word encoded once per worker.

A byte-level BPE tokenizer whose pre-tokenizer cuts text by the usual pattern never joins what lies on
either side of a single space or line end, nor a letter with a full stop behind it. So a text's ids are
those of its words in a row, each with the space or line end before it, and a worker keeps the ids of words in a table (`word_ids`).
Words that it lacks are encoded by the library, many in one call with line ends between. Texts with other white space
are cut one by one.
Texts that hold the string of an added token go through the library whole, by its defaults.
This holds for tokenizers of that kind only; others go through the library text by text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

import numpy as np

from marlstone.llm import word_ids
from marlstone.llm.common import Rest

#: Bytes of a worker's table of words, about, which stays from task to task; characters of texts that are cut at once, about. Only speed depends on them.
REMEMBERED, CUT = 96 << 20, 6 << 20

# the library's white space is Unicode's, which lacks four control characters that Python counts
_PIECE = re.compile(r" ?[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+(?![\S\x1c-\x1f])|[^\S\x1c-\x1f]+")


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path) as file:
            read = json.load(file)
        pre = read.get("pre_tokenizer") or {}
        line_end = self.library.encode("\n", add_special_tokens=False).ids
        self.by_word = not read.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and len(line_end) == 1
        self.line_end = line_end[0]
        self.added = [t["content"] for t in read.get("added_tokens") or [] if t["content"]]
        self.spaced = word_ids.Words(self._learn, REMEMBERED)  # by the word with the space or line end before it
        self.gaps: dict[str, bytes] = {}  # by other white space

    def forget(self) -> None:
        self.spaced.clear()
        self.gaps = {}

    def _many(self, units: list[str]) -> list[bytes]:
        """The ids of units, of those behind a line end with its own."""
        found: list[bytes] = []
        behind = [4 * (u[0] == " ") for u in units]
        texts = ["".join(["\n" + u if u[0] == " " else u for u in units[at : at + 200]]) for at in range(0, len(units), 200)]
        for encoded in self.library.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(encoded.ids, "<u4")
            cuts = np.flatnonzero(ids == self.line_end) * 4
            raw = ids.tobytes()
            found += [raw[a + n : b] for a, b, n in zip(cuts.tolist(), [*cuts[1:].tolist(), len(raw)], behind[len(found) :])]
        return found

    def _learn(self, units: list[str]) -> list[bytes]:
        stopped = [u for u in units if u[-1] in ",." and u[1:-1].isalpha()]
        need = list(set(units).difference(stopped))
        known = dict(zip(need, self._many(need)))
        if stopped:  # a word and its stop are two units of the library
            stems = list({u[:-1] for u in stopped}.difference(need))
            known.update(zip(stems, self.spaced.of(stems)))
            stops = {c: ids[4:] for c, ids in zip(",.", self._many(["\n,", "\n."]))}
            known.update([(u, known[u[:-1]] + stops[u[-1]]) for u in stopped])
        return list(map(known.__getitem__, units))

    def _pieces(self, texts: list[str]) -> list[bytes]:
        """The ids of texts with any white space."""
        cut = [_PIECE.findall(text) for text in texts]
        known: dict[str, bytes] = {}
        distinct = {p for pieces in cut for p in pieces}
        spaced = [p for p in distinct if p[0] == " " and len(p) > 1 and not p.isspace()]
        gaps = [p for p in distinct if p.isspace()]
        bare = list(distinct.difference(spaced, gaps))
        known.update(zip(spaced, self.spaced.of(spaced)))
        known.update(zip(bare, [ids[4:] for ids in self.spaced.of(["\n" + p for p in bare])]))
        if len(self.gaps) > 10_000:
            self.gaps = {}
        for p in gaps:
            if p not in self.gaps:
                self.gaps[p] = np.array(self.library.encode(p, add_special_tokens=False).ids, "<u4").tobytes()
            known[p] = self.gaps[p]
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null counts as empty."""
        texts = [t or "" for t in texts]
        if not self.by_word:
            return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]
        out: list[bytes] = []
        for part in word_ids.grouped(texts, CUT):
            self.spaced.trim()
            ids = {k: np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for k, t in enumerate(part) if any(a in t for a in self.added)}
            left = [k for k, t in enumerate(part) if t and k not in ids]
            ids.update(zip(left, word_ids.encoded(self.spaced, [part[k] for k in left], b"\n", 4, self._pieces)))
            out += [ids.get(k, b"") for k in range(len(part))]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _forget() -> None:
    for held in _encoders.values():
        held.forget()


#: To be held by a task while it encodes.
rest = Rest(_forget)
