"""Repeated passages by super-k-mers of words.

A window is `size` consecutive words of one document. Its minimiser is the smallest hash among its runs of
`run` words, the leftmost of equal ones. Consecutive windows that share a minimiser are one super-k-mer. Equal
windows have equal minimisers, and windows of one super-k-mer are never equal, so a window that
stands twice in the corpus lies in two super-k-mers of the same minimiser value.

1. Every document's super-k-mers are listed and counted by minimiser; of those whose minimiser is shared the
   places go back to their documents. A minimiser's count is a pre-aggregated row of a table of its own, so the join of a hot
   minimiser's places with it is one that adaptive execution splits.
2. There each becomes a packed string of its words. Equal strings are pre-aggregated, so copies of a passage or of
   whole documents travel once a task, and go to their minimiser's bucket.
3. In a bucket the windows of all strings are sorted and equal neighbours counted, the strings' own counts as
   weights. The bucket of a minimiser with very many super-k-mers (`LARGE`) is cut: its windows are counted
   by a pre-aggregated shuffle on the windows themselves, exactly as well.
4. Strings with a repeated window send its places back to every document that holds them.

All comparisons of windows are of the words' bytes; words longer than `LONG` stand in packed strings as their SHA-256. So a bucket's
strings are bounded in bytes as well as in number, and its windows are told apart by hashes first, which memory follows. Joins on hot minimisers or strings are equi-joins, which adaptive
execution splits. Null texts have no words. Every row is a document of its own, so repeated rows repeat each
other's windows and get equal results; null ids are allowed. Texts are read whole, however long: beyond `PART` windows a
super-k-mer ends, which changes none of its windows. An empty table gives no rows. Columns other than doc_id
and text play no part; `carry` names some to pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import hashing
from marlstone.llm.common import releasing, shards, slices, staged

#: Words of the runs that minimisers are chosen among.
RUN = 8
#: Super-k-mers of a minimiser that has more than this are counted by a shuffle of their windows.
LARGE = 20_000
#: Windows of a text that are cut into super-k-mers at once: their places and hashes share 64 bits.
PART = 1 << 23
#: Bytes of the longest words that packed strings hold themselves; the longest bucket whose windows are sorted as they are.
LONG, SORTED = 64, 1 << 16

_U = np.uint64


def super_kmers(found: np.ndarray, size: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(first windows, minimiser values) of the super-k-mers of a document's word hashes, in order."""
    n = len(found) - size + 1
    if n > PART:
        parts = [(at, *super_kmers(found[at : min(at + PART, n) + size - 1], size, run)) for at in range(0, n, PART)]
        return np.concatenate([first + at for at, first, _ in parts]), np.concatenate([mini for *_, mini in parts])
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    m = len(found) - run + 1
    h = found[:m].copy()
    for k in range(1, run):
        h *= _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
        h += found[k : m + k]
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    # the place in the low bits makes the leftmost of equal hashes the smallest
    low = _U(0xFFFFFF)
    keyed = (h & ~low) | np.arange(m, dtype=_U)
    span, width = size - run + 1, 1
    while 2 * width <= span:
        keyed = np.minimum(keyed[: len(keyed) - width], keyed[width:])
        width *= 2
    if width < span:
        keyed = np.minimum(keyed[: len(keyed) - (span - width)], keyed[span - width :])
    at = (keyed & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return first, h[at[first]].view(np.int64)


def with_hash(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    passed = F.struct(F.lit(0).alias("c"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)]).alias("passed")
    return docs.select("doc_id", "text", passed, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h"))


def places(hashed: DataFrame, size: int, run: int) -> DataFrame:
    """A row for each super-k-mer: doc_id, h (of the text), first (its first window), mini."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1, 500)):
            rows, firsts, minis = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                first, mini = super_kmers(hashing.words((text or "").encode())[0], size, run)
                rows.append(np.full(len(first), k))
                firsts.append(first)
                minis.append(mini)
            at = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64))
            columns = [pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (firsts, minis)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), columns[0].cast(pa.int32()), columns[1]], ["doc_id", "h", "first", "mini"])

    return hashed.select("doc_id", "text", "h").mapInArrow(releasing(go), "doc_id long, h long, first int, mini long")


def short(words: list[bytes]) -> list[bytes]:
    """The words, long ones by their SHA-256 behind a zero byte; words that begin with one too, so none is taken for another."""
    return [w if len(w) <= LONG and w[0] else b"\0" + hashlib.sha256(w).hexdigest().encode() for w in words]


def packed(marked: DataFrame, size: int, run: int) -> DataFrame:
    """A row for each listed super-k-mer, with its packed words s, from rows (doc_id, h, text, listed)."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
    names = ["doc_id", "h", "first", "n_windows", "large", "mini", "s"]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for whole in batches for part in slices(whole, 2, 500)):
            rows: list[tuple] = []
            held, listed = 0, part.column(3)
            ends, values = listed.offsets.to_numpy(), listed.values
            firsts, larges = values.field("first").to_numpy(), values.field("large").to_numpy(zero_copy_only=False)
            for k, (doc_id, h, text) in enumerate(zip(*(part.column(k).to_pylist() for k in range(3)))):
                raw = (text or "").encode()
                found, begins, stops = hashing.words(raw)
                first, mini = super_kmers(found, size, run)
                at = np.searchsorted(first, firsts[ends[k] : ends[k + 1]])
                behind = np.r_[first[1:], len(found) - size + 1]
                odd = b"\0" in raw or int((stops - begins).max()) > LONG
                columns = (first[at], behind[at] - first[at], larges[ends[k] : ends[k + 1]], mini[at], begins[first[at]], stops[behind[at] + size - 2])
                for a, n, large, v, i, j in zip(*(c.tolist() for c in columns)):
                    words = raw[i:j].split()
                    rows.append((doc_id, h, a, n, large, v, b" ".join(short(words) if odd else words)))
                    held += len(rows[-1][-1])
                    if held > 4 << 20:
                        yield table(rows)
                        rows, held = [], 0
            yield table(rows)

    return marked.select("doc_id", "h", "text", "listed").mapInArrow(releasing(go), "doc_id long, h long, first int, n_windows int, large boolean, mini long, s binary")


def windows_of(s: bytes, size: int) -> list[bytes]:
    """The windows of a packed string."""
    ends = [-1]
    at = s.find(b" ")
    while at >= 0:
        ends.append(at)
        at = s.find(b" ", at + 1)
    ends.append(len(s))
    return [s[ends[k] + 1 : ends[k + size]] for k in range(len(ends) - size)]


def repeated(strings: list[bytes], size: int) -> list[list[int]]:
    """Of each of distinct strings, the places of its windows that another holds too: by hashes of windows, and by bytes where those are equal."""
    raw = b" ".join(strings)
    found, begins, stops = hashing.words(raw)
    lengths = np.array([s.count(b" ") + 1 for s in strings])
    owner, offset = np.repeat(np.arange(len(strings), dtype=np.int32), lengths), np.cumsum(lengths) - lengths
    m = len(found) - size + 1
    h = found[:m].copy()
    for k in range(1, size):
        h *= _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
        h += found[k : m + k]
    order = np.flatnonzero(owner[:m] == owner[size - 1 :])
    order = order[np.argsort(h[order], kind="stable")]
    edges = np.flatnonzero(np.r_[True, h[order[1:]] != h[order[:-1]], True])
    twice = np.zeros(m, bool)
    for k in np.flatnonzero(np.diff(edges) > 1).tolist():
        same: dict[bytes, list[int]] = {}
        for i in order[edges[k] : edges[k + 1]].tolist():
            same.setdefault(raw[begins[i] : stops[i + size - 1]], []).append(i)
        for at in same.values():
            twice[at] = len(at) > 1
    places: list[list[int]] = [[] for _ in strings]
    at = np.flatnonzero(twice)
    for k, i in zip(owner[at].tolist(), (at - offset[owner[at]]).tolist()):
        places[k].append(i)
    return places


def bucket(rows: list[tuple[bytes, int]], size: int) -> Iterator[tuple[bytes, list[int] | None]]:
    """From a minimiser's distinct strings and their counts: those with windows found twice, and their places (null: all)."""
    if len(rows) == 1:
        if rows[0][1] > 1:
            yield rows[0][0], None
        return
    if sum(len(s) for s, _ in rows) > SORTED:
        for (s, n), at in zip(rows, repeated([s for s, _ in rows], size)):
            if n > 1 or at:
                yield s, None if n > 1 else at
        return
    found = sorted((w, k, at) for k, (s, n) in enumerate(rows) if n == 1 for at, w in enumerate(windows_of(s, size)))
    sure = {w for s, n in rows if n > 1 for w in windows_of(s, size)}
    twice: dict[int, list[int]] = {}
    for i, (w, k, at) in enumerate(found):
        if (i and found[i - 1][0] == w) or (i + 1 < len(found) and found[i + 1][0] == w) or w in sure:
            twice.setdefault(k, []).append(at)
    for k, (s, n) in enumerate(rows):
        if n > 1:
            yield s, None
        elif k in twice:
            yield s, twice[k]


def counted(strings: DataFrame, size: int) -> DataFrame:
    """From distinct strings (mini, s, n) sorted within partitions by mini: s, at (places of windows found twice, or null: all)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mini, out = None, []
        rows: list[tuple[bytes, int]] = []

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.binary()), pa.array([a for _, a in out], pa.list_(pa.int32()))], ["s", "at"])

        for batch in batches:
            for m, s, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if m != mini:
                    out.extend(bucket(rows, size) if rows else ())
                    mini, rows = m, []
                    if len(out) > 2000:
                        yield table()
                        out = []
                rows.append((s, n))
        out.extend(bucket(rows, size) if rows else ())
        yield table()

    return strings.select("mini", "s", "n").mapInArrow(releasing(go), "s binary, at array<int>")


def counted_apart(strings: DataFrame, size: int) -> DataFrame:
    """The same for buckets of any number of strings, by a pre-aggregated shuffle of the windows."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in (whole.slice(k, 500) for k in range(0, len(whole), 500)):
                rows = [(s, n, at, w) for s, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist()) for at, w in enumerate(windows_of(s, size))]
                columns = list(zip(*rows)) or [()] * 4
                kinds = (pa.binary(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["s", "n", "at", "w"])

    windows = strings.select("mini", "s", "n").mapInArrow(go, "s binary, n long, at int, w binary")
    twice = windows.groupBy("w").agg(F.sum("n").alias("k")).where("k > 1").select("w")
    return windows.join(twice, "w").groupBy("s").agg(F.collect_set("at").alias("at"))


def without_repeats(docs: DataFrame, size: int = 35, run: int = RUN, carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row: doc_id, n_words long, n_removed long, text (the words that are left, one space between; as it came if none goes)."""
    hashed = with_hash(docs, carry)
    kmers = staged(places(hashed, size, run), "kmers")
    shared = staged(kmers.groupBy("mini").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mini", (F.col("n") > LARGE).alias("large")), "shared")
    lists = kmers.join(shared, "mini").groupBy("doc_id", "h").agg(F.collect_set(F.struct("first", "large")).alias("listed"))
    of = lists.select(F.col("doc_id").alias("id2"), F.col("h").alias("h2"), "listed")
    same = F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2"))
    packs = staged(packed(hashed.join(of, same), size, run), "packs")

    strings = packs.groupBy("mini", "s", "large").agg(F.count(F.lit(1)).alias("n"))
    small = counted(strings.where("not large").repartition(shards(docs), "mini").sortWithinPartitions("mini"), size)
    big = counted_apart(strings.where("large"), size)
    repeats = small.union(big).select(F.md5("s").alias("k"), "at")
    found = packs.select("doc_id", "h", "first", "n_windows", F.md5("s").alias("k")).join(repeats, "k")
    gone = found.groupBy("doc_id", "h").agg(F.collect_set(F.struct("first", "n_windows", "at")).alias("gone"))
    gone = gone.select(F.col("doc_id").alias("id2"), F.col("h").alias("h2"), "gone")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 1, 1000):
                counts, removed, texts = [], [], []
                for text, listed in zip(part.column(1).to_pylist(), (x.as_py() for x in part.column(2))):
                    raw = (text or "").encode()
                    if not listed:
                        counts.append(len(hashing.words(raw)[0]))
                        removed.append(0)
                        texts.append(text)
                        continue
                    words = raw.split()
                    counts.append(len(words))
                    steps = np.zeros(len(words) + 1, np.int32)
                    for x in listed:
                        starts = x["first"] + np.arange(x["n_windows"]) if x["at"] is None else x["first"] + np.array(x["at"])
                        np.add.at(steps, starts, 1)
                        np.add.at(steps, starts + size, -1)
                    keep = np.cumsum(steps[:-1]) == 0
                    removed.append(int(len(words) - keep.sum()))
                    texts.append(b" ".join([w for w, k in zip(words, keep.tolist()) if k]).decode() if removed[-1] else text)
                made = pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "text"])
                if carry:
                    yield pa.RecordBatch.from_arrays([*made.columns, part.column(3)], [*made.schema.names, "passed"])
                else:
                    yield made

    joined = hashed.join(gone, same, "left").select("doc_id", "text", "gone", *["passed"] * bool(carry))
    schema = "doc_id long, n_words long, n_removed long, text string"
    if not carry:
        return joined.mapInArrow(go, schema)
    kind = hashed.schema["passed"].dataType.simpleString()
    return joined.mapInArrow(go, f"{schema}, passed {kind}").select("doc_id", "n_words", "n_removed", "text", *[F.col("passed").getField(f"c{k}").alias(c) for k, c in enumerate(carry)])
