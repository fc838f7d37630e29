"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. A document's words (A-Z lower-cased) give its set of shingles and 256 MinHash values of 16 bits.
   Documents of equal word sequences are one class, named by the digest of its words' hashes.
2. The forest has 32 sorted orders of all classes, each by eight values of its own. The orders are range-partitioned, so a
   dense region spreads over tasks, and walked as sorted streams. Of the neighbours in all orders each class takes
   the one with the longest common prefix. These pairs, one for each class at most, are confirmed on the whole shingle sets of
   the texts and make parts of components.
3. The depth then goes up region by region, but only where it must: a region is the classes of one order that share their
   first `FIRST` values, and it is walked if it still holds classes of several parts. Regions of more than `WIDE` classes are
   cut into blocks by the classes' hashes, and every pair of blocks that can hold different parts is one cell, dealt over
   the tasks. In a cell the classes are found whose signatures allow the similarity with a class of another part, each pair in
   the first order that its classes share. Cells that have such classes get these classes' whole sets, compare
   them exactly and return links, no more of them than classes: those that join what the cell has not joined yet.

A link of similarity 0.8 shares a region in one order with probability 0.8^4; all of 32 miss it with
(1 - 0.41)^32 = 5e-8. Signatures reject it beyond six standard deviations. Nothing else is left out: no region, class or
candidate is capped. The work of a region grows with its classes outside its largest part times all its classes.

Null and empty texts, and texts without words, have an empty set and link with nothing. Rows with a null
doc_id get their own row, with component_id null and kept true, and link with nothing. Repeated rows, and
rows of one doc_id, are all returned, with the component of their own text; kept is decided by doc_id. Very long texts are
read whole. An empty table gives no rows. Columns other than doc_id and text play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import hashing
from marlstone.llm.common import releasing, shards, staged
from marlstone.llm.graphs import components

#: Sorted orders, the values of each, and the values that a region shares.
TREES, DEPTH, FIRST = 32, 8, 4
#: Bytes of a value in a signature, and of the hash that names a region.
WIDTH, REGION = 2, 4
#: Classes, and shingles, in a block of a region.
WIDE, HEAVY = 1024, 4_000_000
#: Shingles that a task keeps of texts while it confirms pairs.
HELD = 2_000_000

_U = np.uint64
_ODD = np.random.default_rng(20240229).integers(1, 2**32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def words_of(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words, A-Z lower-cased."""
    return hashing.words((text or "").encode().lower())[0]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a word sequence's shingles; the whole sequence is one if it is shorter."""
    if len(words) < size:
        return np.array([int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little")] if len(words) else [], _U)
    n = len(words) - size + 1
    h = words[:n].copy()
    for k in range(1, size):
        h *= _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
        h += words[k : n + k]
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return np.unique(h)


def minima(found: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """MinHash values by multiplicative permutations of 32-bit folds of the hashes, each hashed to 32 bits."""
    folded = (found >> _U(32)).astype(np.uint32)
    least = np.full(len(odd), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(folded), 1024):
        np.minimum(least, np.multiply.outer(odd, folded[at : at + 1024]).min(axis=1), out=least)
    least *= np.uint32(0x85EBCA6B)
    least ^= least >> np.uint32(13)
    least *= np.uint32(0xC2B2AE35)
    return least


def signature(found: np.ndarray) -> np.ndarray:
    """256 MinHash values of 16 bits."""
    return (minima(found, _ODD) >> np.uint32(16)).astype(">u2")


def least_equal(percent: int) -> int:
    """Low bytes of two signatures that are equal at least if the sets are similar: six standard deviations below the mean."""
    n, p = TREES * DEPTH, percent / 100
    return max(1, int(n * p - 6 * (n * p * (1 - p)) ** 0.5))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sized(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, h (hash of the text), node (digest of the word sequence, null without words), n_shingles, values (the signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 1000) for at in range(0, len(whole), 1000)):
                nodes, counts, values = [], [], []
                for text in batch.column(1).to_pylist():
                    words = words_of(text)
                    found = shingles(words, size)
                    nodes.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest() if len(words) else None)
                    counts.append(len(found))
                    values.append(signature(found).tobytes() if len(words) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(nodes, pa.binary()), pa.array(counts, pa.int64()), pa.array(values, pa.binary())], ["doc_id", "h", "node", "n_shingles", "values"]
                )

    hashed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    return hashed.mapInArrow(releasing(run), "doc_id long, h long, node binary, n_shingles long, values binary")


#: Columns of an order's rows, and what a cell is known by.
ORDER = {"tree": pa.int32(), "label": pa.binary(), "node": pa.binary()}
CELL = ["tree", "region", "i", "j"]


def schema(columns: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{name} {({pa.int32(): 'int', pa.int64(): 'long'}).get(kind, 'binary')}" for name, kind in columns.items())


def forest(classes: DataFrame) -> DataFrame:
    """A row for each order and class (node, values): tree, label (the order's eight values), node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                n, width = len(part), WIDTH * DEPTH
                raw = b"".join(part.column(1).to_pylist())
                labels = pa.array([raw[width * k : width * (k + 1)] for k in range(n * TREES)], pa.binary())
                each = pa.array(np.repeat(np.arange(n), TREES))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), labels, part.column(0).take(each)], list(ORDER))

    return classes.select("node", "values").mapInArrow(run, schema(ORDER))


def common_prefix(a: bytes, b: bytes) -> int:
    """Leading values that two labels share."""
    if a == b:
        return DEPTH
    k = 0
    while a[WIDTH * k : WIDTH * (k + 1)] == b[WIDTH * k : WIDTH * (k + 1)]:
        k += 1
    return k


def neighbours(trees: DataFrame) -> DataFrame:
    """Pairs (a < b), each once: every class with the neighbour in a sorted order that shares the longest prefix with it, `FIRST` values at least.

    Among equal labels the first row is everyone's neighbour, so classes whose sets are equal in all values meet in few pairs.
    Neighbours on either side of a cut between tasks are not seen here; the regions that they share are walked later.
    """
    made = {"node": pa.binary(), "depth": pa.int32(), "other": pa.binary()}

    def table(best: dict[bytes, tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(best), pa.binary()), pa.array([d for d, _ in best.values()], pa.int32()), pa.array([o for _, o in best.values()], pa.binary())], list(made))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, tuple[int, bytes]] = {}

        def meet(depth: int, a: bytes, b: bytes) -> None:
            for k, o in ((a, b), (b, a)):
                if k not in best or (-depth, o) < (-best[k][0], best[k][1]):
                    best[k] = (depth, o)

        tree, label, node = None, b"", b""
        for batch in batches:
            for t, now, k in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if t == tree and now[: WIDTH * FIRST] == label[: WIDTH * FIRST]:
                    depth = common_prefix(label, now)
                    meet(depth, node, k)
                    if depth == DEPTH:
                        continue
                tree, label, node = t, now, k
            if len(best) > 20_000:
                yield table(best)
                best = {}
        yield table(best)

    n = shards(trees)
    walked = trees.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER).mapInArrow(run, schema(made))
    closest = walked.groupBy("node").agg(F.max(F.struct("depth", "other")).alias("c"))
    return closest.select(F.least("node", "c.other").alias("a"), F.greatest("node", "c.other").alias("b")).distinct()


def regions_of(values: bytes) -> bytes:
    """32-bit hashes of the first four values of each order. They define the regions, so equal ones lose nothing."""
    h = np.ascontiguousarray(np.frombuffer(values, ">u8").reshape(TREES, -1)[:, 0]).astype(_U)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    return (h >> _U(32)).astype("<u4").tobytes()


def with_regions(classes: DataFrame) -> DataFrame:
    """node, component, n_shingles, regions, and low (the low bytes of the values) in place of values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([regions_of(v) for v in values], pa.binary()), pa.array([v[1::2] for v in values], pa.binary())], ["node", "component", "n_shingles", "regions", "low"]
            )

    return classes.select("node", "component", "n_shingles", "values").mapInArrow(run, "node binary, component binary, n_shingles long, regions binary, low binary")


def cells(classes: DataFrame) -> DataFrame:
    """CELL, block and node: the rows of every region where parts meet, in each of the cells that their blocks have with others.

    A region's largest part needs no comparison within itself, so its blocks meet the others' only.
    """
    each = f"transform(sequence(0, {TREES - 1}), t -> substring(regions, {REGION} * t + 1, {REGION}))"
    light = classes.select("node", "component", "n_shingles", F.posexplode(F.expr(each)).alias("tree", "region"))
    held = light.groupBy("tree", "region", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    held = held.groupBy("tree", "region").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "component", "s")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    whole = f"n <= {WIDE} and s <= {HEAVY}"
    held = held.select(
        "tree",
        "region",
        F.col("most.component").alias("main"),
        F.expr(f"if({whole}, 0, greatest(ceil(most.n / {WIDE}), ceil(most.s / {HEAVY})))").cast("int").alias("mains"),
        F.expr(f"if({whole}, 1, greatest(ceil((n - most.n) / {WIDE}), ceil((s - most.s) / {HEAVY})))").cast("int").alias("others"),
    )
    met = light.join(held, ["tree", "region"]).withColumn("in_main", F.expr("mains > 0 and component = main"))
    met = met.withColumn("block", F.expr("cast(if(in_main, pmod(xxhash64(node), mains), mains + pmod(xxhash64(node), others)) as int)"))
    met = met.select("node", "tree", "region", "block", F.expr("if(in_main, mains, 0)").alias("first"), F.expr("mains + others - 1").alias("last"))
    whole = met.withColumn("other", F.explode(F.sequence("first", "last")))
    return whole.select("node", "tree", "region", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")


def allowed(tree: int, rows: list[tuple], least: int, percent: int) -> np.ndarray:
    """Which rows (block, node, component, n_shingles, regions, low) of a cell may have a link with one of another part and block, in this order first."""
    n = len(rows)
    known: dict[bytes, int] = {}
    of = np.array([known.setdefault(row[2], len(known)) for row in rows])
    counts = np.array([row[3] for row in rows])
    blocks = np.array([row[0] for row in rows])
    regions = np.frombuffer(b"".join(row[4] for row in rows), "<u4").reshape(n, TREES)
    low = np.frombuffer(b"".join(row[5] for row in rows), np.uint8).reshape(n, -1)
    lower, higher = np.flatnonzero(blocks == blocks.min()), np.flatnonzero(blocks == blocks.max())
    within = blocks.min() == blocks.max()
    found = np.zeros(n, bool)
    step = max(1, 40_000 // len(higher))
    for at in range(0, len(lower), step):
        x = lower[at : at + step]
        fits = (of[x][:, None] != of[higher][None, :]) & (100 * np.minimum(counts[x][:, None], counts[higher][None, :]) >= percent * np.maximum(counts[x][:, None], counts[higher][None, :]))
        if within:
            fits &= x[:, None] < higher[None, :]
        p, q = np.nonzero(fits)
        p, q = x[p], higher[q]
        for cut in range(0, len(p), 20_000):
            a, b = p[cut : cut + 20_000], q[cut : cut + 20_000]
            near = (regions[a] == regions[b]).argmax(axis=1) == tree
            a, b = a[near], b[near]
            close = np.count_nonzero(low[a] == low[b], axis=1) >= least
            found[a[close]] = found[b[close]] = True
    return found


def walked_cells(rows: DataFrame, extra: list[str], body, made: str) -> DataFrame:
    """`body` on the rows (block, node, component, n_shingles, `extra`) of each cell, which a task holds one at a time; it yields tuples of `made`."""
    names = [c.split()[0] for c in made.split(", ")]
    kinds = [pa.int32() if c.endswith(" int") else pa.binary() for c in made.split(", ")]
    columns = [*CELL, "block", "node", "component", "n_shingles", *extra]

    def table(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(list(zip(*found)) or [()] * len(names), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found = None, [], []
        for whole in batches:
            for batch in (whole.slice(at, 500) for at in range(0, len(whole), 500)):
                for row in zip(*(batch.column(k).to_pylist() for k in range(len(columns)))):
                    if row[: len(CELL)] != now:
                        if now:
                            found += body(now, held)
                        now, held = row[: len(CELL)], []
                        if len(found) > 20_000:
                            yield table(found)
                            found = []
                    held.append(row[len(CELL) :])
        if now:
            found += body(now, held)
        yield table(found)

    dealt = rows.select(*columns).repartition(shards(rows), *CELL).sortWithinPartitions(*CELL, "block", "node")
    return dealt.mapInArrow(releasing(run), made)


def joined_in(rows: list[tuple], percent: int) -> Iterator[tuple[bytes, bytes]]:
    """Links among a cell's rows (block, node, component, n_shingles, shingles): exact, between parts, and none between classes that the cell has joined.

    The sets are laid end to end as places in the cell's shingles; for one class, the sums of its marks at the
    others' places are all its intersections.
    """
    known: dict[bytes, int] = {}
    of = np.array([known.setdefault(row[2], len(known)) for row in rows])
    counts = np.array([row[3] for row in rows])
    blocks = np.array([row[0] for row in rows])
    within = blocks.min() == blocks.max()
    names, places = np.unique(np.frombuffer(b"".join(row[4] for row in rows), "<u8"), return_inverse=True)
    starts = np.r_[0, np.cumsum(counts)[:-1]]
    marks = np.zeros(len(names), np.int32)
    # parts of each class, merged as links are found: equal labels are joined already
    label = of.copy()
    least = np.flatnonzero(blocks == (blocks.max() if within or (blocks == blocks.max()).sum() <= (blocks == blocks.min()).sum() else blocks.min()))
    for x in least.tolist():
        fits = (label != label[x]) & (100 * np.minimum(counts, counts[x]) >= percent * np.maximum(counts, counts[x]))
        if not within:
            fits &= blocks != blocks[x]
        if not fits.any():
            continue
        own = places[starts[x] : starts[x] + counts[x]]
        marks[own] = 1
        both = np.add.reduceat(marks[places], starts)
        marks[own] = 0
        for y in np.flatnonzero(fits & (100 * both >= percent * (counts + counts[x] - both))).tolist():
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                a, b = rows[x][1], rows[y][1]
                yield (a, b) if a < b else (b, a)


def meeting(classes: DataFrame, docs: DataFrame, every: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a < b) between the parts of `classes` (with_regions): exact ones, enough to join what is similar."""
    least = least_equal(percent)
    met = cells(classes).join(classes.select("node", "component", "n_shingles", "regions", "low"), "node")

    def seen(cell: tuple, rows: list[tuple]) -> list[tuple]:
        found = allowed(cell[0], rows, least, percent)
        return [(*cell, row[0], row[1]) for row, yes in zip(rows, found.tolist()) if yes]

    worth = staged(walked_cells(met, ["regions", "low"], seen, "tree int, region binary, i int, j int, block int, node binary"), "worth")
    texts = with_texts(docs, every, worth.select("node").distinct())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 200) for at in range(0, len(whole), 200)):
                sets = [shingles(words_of(t), size).astype("<u8").tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.large_binary()).cast(pa.binary())], ["node", "shingles"])

    sets = texts.select("node", "text").mapInArrow(releasing(cut), "node binary, shingles binary")
    whole = worth.join(sets, "node").join(classes.select("node", "component", "n_shingles"), "node")
    return walked_cells(whole, ["shingles"], lambda cell, rows: list(joined_in(rows, percent)), "a binary, b binary").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        held = 0
        for whole in batches:
            for batch in (whole.slice(at, 100) for at in range(0, len(whole), 100)):
                kept = []
                for a, text_a, text_b in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                    if a not in known:
                        if held > HELD:
                            known.clear()
                            held = 0
                        known[a] = shingles(words_of(text_a), size)
                        held += len(known[a])
                    kept.append(similar(known[a], shingles(words_of(text_b), size), percent))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    named = texts.select("node", "text", "n_shingles")
    left = pairs.join(named.select(F.col("node").alias("b"), F.col("text").alias("text_b"), F.col("n_shingles").alias("n_b")), "b")
    both = left.join(named.select(F.col("node").alias("a"), F.col("text").alias("text_a"), F.col("n_shingles").alias("n_a")), "a")
    close = both.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return close.select("a", "b", "text_a", "text_b").mapInArrow(releasing(run), "a binary, b binary")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id that can be reached), kept, n_class (rows of equal words) and h (hash of the text)."""
    rows = staged(sized(docs, size), "sized")
    named = rows.where("node is not null and doc_id is not null")
    least = [F.min(F.struct("doc_id", "h")).alias("low"), F.max("n_shingles").alias("n_shingles"), F.max("values").alias("values"), F.count(F.lit(1)).alias("n_class")]
    classes = staged(named.groupBy("node").agg(*least).select("node", "low.doc_id", "low.h", "n_shingles", "values", "n_class"), "classes")
    pairs = staged(neighbours(forest(classes)), "neighbours")
    paired = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    links = staged(confirmed(pairs, with_texts(docs, classes, paired), size, percent), "links")
    label = staged(components(links), "labels")

    apart = classes.join(label.select("node", F.col("label").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = staged(meeting(staged(with_regions(apart), "regions"), docs, classes, size, percent), "links")
    if not more.isEmpty():
        label = staged(components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more)), "labels")

    known = classes.select("node", F.col("doc_id").alias("least"), "n_class").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = known.groupBy("label").agg(F.min("least").alias("component_id"))
    of = known.join(least, "label").select("node", "component_id", "n_class")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return (
        rows.drop("values")
        .join(of, "node", "left")
        .withColumn("component_id", component)
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), F.coalesce("n_class", F.lit(0).cast("long")).alias("n_class"), "h")
    )


def with_texts(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text, n_shingles of each class in `nodes`: the text of its smallest doc_id, by its hash too, as rows of one doc_id may differ."""
    wanted = classes.join(nodes, "node").select(F.col("doc_id").alias("id"), F.col("h").alias("hash"), "node", "n_shingles")
    found = docs.select("doc_id", "text").join(wanted, (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("hash")))
    return staged(found.groupBy("node").agg(F.first("text").alias("text"), F.first("n_shingles").alias("n_shingles")), "texts")
