r"""Line dedup over content-defined chunks of lines.

A document's lines (cut at \n) are hashed, a hash rolling over two lines picks the lines after which a
chunk may end, and of neighbouring candidates only the first counts. So chunks hold two lines at least
and their ends depend on nothing but the lines around: text put in before a passage doesn't move the
cuts inside it. Documents of one line are one chunk that is never removed.

A chunk of several lines that stands at several places of the corpus is kept at the first place, in the
order of doc_id, text hash and position, and removed elsewhere, after its bytes have been compared with
the kept chunk's. Distinct chunks are found by pre-aggregation on the text itself, so a chunk that a
third of the documents share meets as one row per task; joins on a chunk's hash are plain equi-joins
that adaptive execution splits where one hash is hot.

Null texts count as empty and are never changed except that null becomes empty. Rows equal in doc_id
and text count as one document and get equal results; null ids come first. Texts are read whole, however long; an
empty table gives no rows. Columns other than doc_id and text play no part; `carry` names some to pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A line is a candidate for a chunk's end if the rolling hash is divisible by this: the mean length of chunks follows.
DIVISOR = 3


def chunked(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, h (hash of the text), n_lines and chunks: array<struct<n int, t string>> in order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    passed = F.struct(F.lit(0).alias("c"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)]).alias("passed")
    lines = docs.select("doc_id", passed, F.xxhash64(text).alias("h"), F.split(text, "\n").alias("ls"))
    hashed = lines.select("*", F.expr("transform(ls, x -> cast(conv(substring(md5(x), 1, 8), 16, 10) as bigint))").alias("hs"))
    marks = hashed.select("doc_id", "passed", "h", "ls", F.expr(f"transform(hs, (x, i) -> (coalesce(get(hs, i - 1), 0L) * 31 + x) % {DIVISOR} = 0)").alias("ms"))
    ends = marks.select(
        "doc_id",
        "passed",
        "h",
        "ls",
        F.expr("filter(sequence(1, size(ls)), i -> i = size(ls) or (i >= 2 and i <= size(ls) - 2 and ms[i - 1] and not ms[i - 2]))").alias("es"),
    )
    return ends.select(
        "doc_id",
        "passed",
        "h",
        F.size("ls").alias("n_lines"),
        F.expr(
            "transform(es, (e, i) -> named_struct('n', e - coalesce(get(es, i - 1), 0),"
            " 't', array_join(slice(ls, coalesce(get(es, i - 1), 0) + 1, e - coalesce(get(es, i - 1), 0)), '\n')))"
        ).alias("chunks"),
    )


def dedup_lines(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row: doc_id, n_lines int, n_chunks int, n_removed_lines int, text (what is left, lines joined by \\n)."""
    cut = chunked(docs, carry)
    # the outer form, as the inner one would push a test of `chunks` below the projections and evaluate them twice, nested
    chunks = cut.select("doc_id", "h", F.posexplode_outer("chunks").alias("at", "c")).where("c.n >= 2")
    place = F.struct(F.col("doc_id"), F.col("h"), F.col("at"))
    repeated = (
        chunks.select(F.md5("c.t").alias("k"), F.col("c.t").alias("t"), place.alias("p"))
        .groupBy("k", "t")
        .agg(F.min("p").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("k", "t", "first")
    )
    others = (
        chunks.select("doc_id", "h", "at", F.md5("c.t").alias("k"))
        .join(repeated, "k")
        .where("not (first.doc_id <=> doc_id and first.h = h and first.at = at)")
        .groupBy("doc_id", "h")
        .agg(F.collect_set(F.struct("at", "t")).alias("gone"))
        .withColumnRenamed("doc_id", "id2")
        .withColumnRenamed("h", "h2")
    )
    joined = cut.join(others, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left")
    left = joined.select(
        "doc_id",
        "passed",
        "n_lines",
        F.size("chunks").alias("n_chunks"),
        F.expr("if(gone is null, chunks, filter(chunks, (c, i) -> not array_contains(gone, named_struct('at', i, 't', c.t))))").alias("kept"),
    )
    return left.select(
        "doc_id",
        "n_lines",
        "n_chunks",
        F.expr("n_lines - aggregate(kept, 0, (a, c) -> a + c.n)").alias("n_removed_lines"),
        F.expr("array_join(transform(kept, c -> c.t), '\n')").alias("text"),
        *[F.col("passed").getField(f"c{k}").alias(c) for k, c in enumerate(carry)],
    )
