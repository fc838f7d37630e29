"""SentencePiece encoding and decoding of BPE models by suffix-array matching.

The new words of a batch are laid end to end and all their suffixes sorted by as many characters as the longest
piece has. Every piece is looked up there by binary search, and its range gives all places where it stands. The
places are edges of a graph over the text's positions; sorted by position they are relaxed from left to right.

A BPE result is known by its neighbours: a sequence of pieces is the result for its text if and only if each piece
is its own result and each neighbouring pair is the result for the pair's text. So a position keeps the one piece
ending there that fits the piece before, and a unit's result is read from its end. Which pairs fit is worked
out by plain merging and remembered. Characters that no piece covers become their UTF-8 bytes' pieces.

No piece of such a model goes on past a word into the next space, nor over characters that no piece holds, so words
are independent and a worker encodes each once while it remembers it (`word_ids`). Models that normalise, or whose pieces cross
words, are refused. Decoding joins the bytes that each id stands for, looked up in one table for many texts at once.
Null texts count as empty and have no ids. Decoding drops the space put in front; U+2581 in a text comes
back as a space, as in the library. Texts of any length and of any characters are encoded whole. Rows are encoded one by
one, repeated ones and null ids too; an empty table gives no rows; columns other than doc_id and text play no part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marlstone.llm import word_ids
from marlstone.llm.common import Rest

MARK = "▁"
#: Characters that are indexed at once.
INDEXED = 200_000
#: Bytes of a worker's table of words, about, which stays from task to task; pairs of pieces that it remembers; characters of texts
#: that are cut at once, about. Only speed depends on them.
REMEMBERED, PAIRS, CUT = 160 << 20, 1_500_000, 6 << 20


class Pieces:
    """A model's pieces and what of them is needed for matching, merging and decoding."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or trainer.treat_whitespace_as_suffix:
            raise ValueError("only BPE models without normalisation are known here")
        self.text: list[str] = []
        self.rank: dict[str, tuple[float, int]] = {}  # of the pieces that merging may make
        self.byte: dict[int, int] = {}
        self.silent: set[int] = set()
        for k, piece in enumerate(model.pieces):
            self.text.append(piece.piece)
            if piece.type == 6:
                self.byte[int(piece.piece[3:5], 16)] = k
            elif piece.type == 1:
                self.rank[piece.piece] = (-piece.score, k)
            elif piece.type == 4:
                raise ValueError("user-defined pieces are not known here")
            else:
                self.silent.add(k)
        if len(self.byte) != 256:
            raise ValueError("only models with pieces for all bytes are known here")
        if any(re.search(f"[^{MARK}]{MARK}", p) or "\n" in p for p in self.rank):
            raise ValueError("pieces that cross words or lines are not known here")
        self.size = len(self.text)
        self.names = np.array(list(self.rank))
        # the first string behind all that begin with a piece: its last character's successor, as code points
        codes = self.names.view("<u4").reshape(len(self.names), -1).copy()
        codes[np.arange(len(codes)), np.char.str_len(self.names) - 1] += 1
        self.behind = codes.view(self.names.dtype).ravel()
        self.ids = np.array([k for _, k in self.rank.values()])
        self.lengths = np.array([len(p) for p in self.rank])
        self.longest = int(self.lengths.max())
        self.extra: dict[str, int] = {}  # characters outside the pieces, numbered on from the pieces
        self.fits: dict[tuple[int, int], bool] = {}
        spaced = [b"" if k in self.silent else p.replace(MARK, " ").encode() for k, p in enumerate(self.text)]
        for b, k in self.byte.items():
            spaced[k] = bytes([b])
        self.stand = pa.array(spaced, pa.large_binary())  # bytes that an id stands for

    def merged(self, text: str) -> list[str]:
        """The result for a short text by plain merging: the best pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            options = [(self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank]
            if not options:
                break
            _, i = min(options)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fit(self, a: int, b: int) -> bool:
        """Whether piece b may stand behind piece a; a of -1: at a unit's start."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > PAIRS:
                self.fits.clear()
            before = [self.text[a]] if a >= 0 else []
            known = self.fits[a, b] = self.merged("".join(before) + self.text[b]) == [*before, self.text[b]]
        return known

    def outside(self, char: str) -> int:
        if char not in self.extra:
            self.extra[char] = len(self.text)
            self.text.append(char)
        return self.extra[char]

    def encode(self, units: list[str]) -> list[bytes]:
        """The ids (unsigned 32-bit, little-endian) of each unit, by the suffix array of all of them."""
        text = "\x00".join(units) + "\x00"
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        width = self.longest + 1
        windows = np.lib.stride_tricks.sliding_window_view(np.r_[codes, np.zeros(width, np.uint32)], width)[: len(codes)]
        suffixes = np.ascontiguousarray(windows).view(f"<U{width}").ravel()
        order = np.argsort(suffixes, kind="stable")
        ordered = suffixes[order]
        low = np.searchsorted(ordered, self.names, "left")
        high = np.searchsorted(ordered, self.behind, "left")
        counts = high - low
        which = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = order[low[which] + within]
        pieces, lengths = self.ids[which], self.lengths[which]
        # characters that no piece is, as edges of their own
        single = np.zeros(len(codes), bool)
        single[start[lengths == 1]] = True
        bare = np.flatnonzero(~single & (codes != 0))
        start = np.r_[start, bare]
        pieces = np.r_[pieces, np.array([self.outside(text[k]) for k in bare.tolist()], np.int64)]
        lengths = np.r_[lengths, np.ones(len(bare), np.int64)]
        by_place = np.argsort(start, kind="stable")
        begins = np.zeros(len(codes) + 1, bool)
        begins[np.r_[0, np.flatnonzero(codes == 0) + 1]] = True
        opening = begins.tolist()
        last = [-2] * (len(codes) + 1)
        fits, fit = self.fits, self.fit
        for i, t, n in zip(start[by_place].tolist(), pieces[by_place].tolist(), lengths[by_place].tolist()):
            before = -1 if opening[i] else last[i]
            if before != -2 and last[i + n] == -2:
                known = fits.get((before, t))
                if known if known is not None else fit(before, t):
                    last[i + n] = t
        out, end = [], -1
        for unit in units:
            begin, end = end + 1, end + 1 + len(unit)
            at, found = end, []
            while at > begin:
                t = last[at]
                if t < 0:
                    raise ValueError(f"no pieces lead to place {at - begin} of {unit!r}")
                found.append(t)
                at -= len(self.text[t])
            found.reverse()
            if any(t >= self.size for t in found):
                found = [k for t in found for k in ([t] if t < self.size else [self.byte[b] for b in self.text[t].encode()])]
            out.append(np.array(found, "<u4").tobytes())
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids (unsigned 32-bit, little-endian): marks as spaces, without the space put in front."""
        return self.decode_all([ids])[0]

    def decode_all(self, ids: list[bytes]) -> list[str]:
        """The texts of several texts' ids."""
        coded = self.stand.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
        ends = np.frombuffer(coded.buffers()[1] or bytes(8), np.int64)[np.cumsum([0, *(len(x) // 4 for x in ids)])].tolist()
        held = memoryview(coded.buffers()[2] or b"")
        texts = [str(held[a:b], "utf-8", "replace").replace(MARK, " ") for a, b in zip(ends, ends[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]


_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: What a unit of the table of words doesn't hold behind its first mark.
_OTHER = re.compile(rf"[{MARK}\x09-\x0d]")


class Worker:
    """A worker's pieces and the words that it has met."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.known = word_ids.Words(self._learn, REMEMBERED)  # by the word with the space or line end before it
        self.line_end = self.pieces.byte[10].to_bytes(4, "little")

    def forget(self) -> None:
        self.known.clear()
        self.pieces.fits.clear()

    def _units(self, units: list[str]) -> list[bytes]:
        """The ids of marks, words, and words behind marks."""
        found: dict[str, bytes] = {}
        batch: list[str] = []
        size = 0
        for unit in units:
            if "\x00" in unit:  # the separator of the index: encoded around it
                found[unit] = self.pieces.byte[0].to_bytes(4, "little").join([self.pieces.encode([part])[0] if part else b"" for part in unit.split("\x00")])
                continue
            batch.append(unit)
            size += len(unit) + 1
            if size > INDEXED:
                found.update(zip(batch, self.pieces.encode(batch)))
                batch, size = [], 0
        if batch:
            found.update(zip(batch, self.pieces.encode(batch)))
        return list(map(found.__getitem__, units))

    def _learn(self, units: list[str]) -> list[bytes]:
        ids = self._units([MARK + u[1:] if u[0] == " " else u[1:] for u in units])
        return [x if u[0] == " " else self.line_end + x for u, x in zip(units, ids)]

    def _lines(self, texts: list[str]) -> list[bytes]:
        """The ids of texts with any white space and marks."""
        cut = [[_UNIT.findall(line) for line in (MARK + text.replace(" ", MARK)).split("\n")] for text in texts]
        distinct = {u for lines in cut for units in lines for u in units}
        words = [u for u in distinct if u != MARK and not _OTHER.search(u, u[0] == MARK)]
        known = dict(zip(words, self.known.of([" " + u[1:] if u[0] == MARK else "\n" + u for u in words])))
        known.update([(u, x[4:]) for u, x in known.items() if u[0] != MARK])
        others = list(distinct.difference(words))
        known.update(zip(others, self._units(others)))
        return [self.line_end.join([b"".join(map(known.__getitem__, units)) for units in lines]) for lines in cut]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        out: list[bytes] = []
        for part in word_ids.grouped([t or "" for t in texts], CUT):
            self.known.trim()
            marked = [k for k, t in enumerate(part) if MARK in t]
            ids = dict(zip(marked, self._lines([part[k] for k in marked])))
            left = [k for k, t in enumerate(part) if t and k not in ids]
            ids.update(zip(left, word_ids.encoded(self.known, [part[k] for k in left], b" ", 0, self._lines)))
            out += [ids.get(k, b"") for k in range(len(part))]
        return out


_workers: dict[str, Worker] = {}


def worker(path: str) -> Worker:
    if path not in _workers:
        _workers[path] = Worker(path)
    return _workers[path]


def _forget() -> None:
    for held in _workers.values():
        held.forget()


_rest = Rest(_forget)


def resting() -> Rest:
    """To be held by a task while it encodes."""
    return _rest


def encode_and_decode(docs: DataFrame, model: str) -> DataFrame:
    """One row per input row: doc_id, n_tokens long, ids_crc32 long (of little-endian unsigned 32-bit ids), n_chars long and text_crc32 long of the decoded text."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with resting():
            yield from done(batches)

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker(model)
        for batch in (whole.slice(k, 4000) for whole in batches for k in range(0, len(whole), 4000)):
            ids = held.encode(batch.column(1).to_pylist())
            texts = held.pieces.decode_all(ids)
            columns = [[len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids], [len(t) for t in texts], [zlib.crc32(t.encode()) for t in texts]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_tokens", "ids_crc32", "n_chars", "text_crc32"])

    return docs.select("doc_id", "text").mapInArrow(go, "doc_id long, n_tokens long, ids_crc32 long, n_chars long, text_crc32 long")
