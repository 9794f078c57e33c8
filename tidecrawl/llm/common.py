"""Helpers that several operators share: Arrow text access, hashed words, components."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecrawl.operators.bitmaps import bitmap_of, likely, unused  # noqa: F401
from tidecrawl.operators.tables import dropped as unstage  # noqa: F401
from tidecrawl.operators.tables import written as stage  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- columns
def without(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """docs without the rows that agree with one of lost(doc_id, th) in doc_id and xxhash64 of the text.

    Null agrees with null. Rows of one doc_id but with other texts stay.
    """
    doc, th = unused(docs.columns, "lost_doc", "lost_text")
    gone = lost.select(F.col("doc_id").alias(doc), F.col("th").alias(th)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(th))
    return docs.join(gone, same, "left_anti")


# ---------------------------------------------------------------- text in Arrow batches
def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its row offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offs[0] : offs[-1]], offs - offs[0]


def slices(batches, column: str, limit: int):
    """Record batches of about limit bytes of the column at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def chained(*steps):
    """A function for mapInArrow that takes the batches through all steps in one Python worker.

    When a task ends, what it has freed goes back to the system: workers live on, and would hold it beside the JVM
    and the workers of later stages.
    """

    def run(batches):
        for step in steps:
            batches = step(batches)
        try:
            yield from batches
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # of glibc
                ctypes.CDLL(None).malloc_trim(0)

    return run


# ---------------------------------------------------------------- hashed words
U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCK = 1 << 20
LANES = 8  # words of more than LANES * 8 bytes are hashed one by one
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, true where a byte belongs to a word; ranges of separator bytes are inclusive."""
    word = np.ones(256, bool)
    for lo, hi in ranges:
        word[lo : hi + 1] = False
    return word


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection in which every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(letters: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of letters[start : start + size].

    Eight bytes after eight go through the mixer, so different words of one length up to 8 never share a hash. Words
    of more than LANES * 8 bytes get their XXH3.
    """
    padded = np.concatenate((letters, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(letters),), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    out = mix(size.astype(np.uint64) + U(0xD6E8FEB86659FD93))
    short = np.flatnonzero(size <= 8 * LANES)
    lane = 0
    while len(short):
        out[short] = mix((out[short] ^ (eight[start[short] + 8 * lane] & MASKS[np.minimum(8, size[short] - 8 * lane)])) * U(0x9E3779B97F4A7C15))
        lane += 1
        short = short[size[short] > 8 * lane]
    for i in np.flatnonzero(size > 8 * LANES).tolist():
        out[i] = xxhash.xxh3_64_intdigest(letters[start[i] : start[i] + size[i]].tobytes())
    return out


def hashed_words(data: np.ndarray, offs: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows, A-Z lower-cased, in order; and the number of words of each row.

    A word is a run of word bytes. Rows are read in blocks that end at separators, so that memory follows the
    number of words and not a multiple of the bytes.
    """
    hashes, starts, at, total = [], [], 0, len(data)
    while at < total:
        end = min(total, at + BLOCK)
        while end < total:
            gaps = np.flatnonzero(~word[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(total, end + BLOCK)
        part = LOWER[data[at:end]]
        inside = word[part]
        first = np.zeros(end - at + 1, bool)
        first[offs[np.searchsorted(offs, at) : np.searchsorted(offs, end)] - at] = True
        first[0] = first[-1] = True
        before = np.concatenate(([False], inside[:-1]))
        after = np.concatenate((inside[1:], [False]))
        s = np.flatnonzero(inside & (first[:-1] | ~before))
        e = np.flatnonzero(inside & (first[1:] | ~after))
        if len(s):
            hashes.append(word_hashes(part, s, e - s + 1))
            starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offs) - 1, np.int64)
    starts = np.concatenate(starts)
    return np.concatenate(hashes), np.diff(np.searchsorted(starts, offs))


# ---------------------------------------------------------------- connected components
def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges(a, b) that is not its component's least vertex.

    Alternating large-star and small-star steps, each a grouped minimum and an equi-join, until a whole round
    changes nothing. Every round is a written table; the driver sees one count and one checksum.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stage(pairs, "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("v"), F.col("b").alias("root"))
        seen = mark
        both = now.select("a", "b").union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).repartition("a")  # an exchange on either side lets AQE split a hot vertex
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = stage(small, "edges")
        unstage(large)
        unstage(now)
        now = after
