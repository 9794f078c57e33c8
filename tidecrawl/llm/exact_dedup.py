"""Exact deduplication by Grace hash partitioning.

Each task first folds the copies in its own rows together in an open-addressing table, so a text that a third of
all rows share reaches the shuffle once per task. The remaining texts are hash-partitioned; a partition too large
for memory is split into spill files, again and again, until the distinct texts of a file fit the table. Texts are
compared in full; hashes only choose slots and files. Spill files lie in the folders where Spark itself spills, end
with their task, and nothing else reads them: a task of a lost executor starts anew elsewhere.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import struct
import tempfile
from array import array

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecrawl.llm.common import slices, stage, unused

FANOUT_BITS = 4
HEAD = "<qQqqI"
MASK = (1 << 63) - 1


class ContentTable:
    """Open addressing with linear probing; an entry is found only when its whole content is equal."""

    def __init__(self) -> None:
        self.slots, self.mask = array("q", [-1]) * 1024, 1023
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def entry(self, h: int, content: bytes) -> tuple[int, bool]:
        """Index of the content's entry, and whether it is new."""
        at = h & self.mask
        while (i := self.slots[at]) >= 0:
            if self.hashes[i] == h and self.contents[i] == content:
                return i, False
            at = (at + 1) & self.mask
        self.slots[at] = i = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 64
        if 2 * len(self.contents) > self.mask:
            self.grow()
        return i, True

    def grow(self) -> None:
        self.mask = 4 * (self.mask + 1) - 1
        self.slots = array("q", [-1]) * (self.mask + 1)
        for i, h in enumerate(self.hashes):
            at = h & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = i


LOCAL = pa.schema([("doc_id", pa.int64()), ("rep", pa.int64()), ("sha", pa.binary()), ("hash", pa.int64()), ("content", pa.binary()), ("n", pa.int64()), ("top", pa.int64())])
LOCAL_DDL = "doc_id long, rep long, sha binary, hash long, content binary, n long, top long"


def fold_copies(memory: int):
    """Rows (doc_id, text) -> a row per document; the first of each text in this task also carries the content."""

    def run(batches):
        base, used = TaskContext.get().partitionId() << 36, 0
        seen, rows, stats = ContentTable(), [], []

        def flush():
            nonlocal seen, rows, stats
            size, part = 0, []
            for doc, i, row in rows:
                whole = stats[i][0] == row
                part.append((doc, stats[i][0], stats[i][3], seen.hashes[i] & MASK if whole else None, seen.contents[i] if whole else None, stats[i][1] if whole else None, stats[i][2] if whole else None))
                size += 80 + (len(seen.contents[i]) if whole else 0)
                if size > 8 << 20:
                    yield batch_of(part)
                    size, part = 0, []
            if part:
                yield batch_of(part)
            seen, rows, stats = ContentTable(), [], []

        for batch in slices(batches, "text", 4 << 20):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                content = (text or b"").lower()  # bytes.lower() changes A-Z only
                i, new = seen.entry(xxhash.xxh3_64_intdigest(content), content)
                row = base + used
                used += 1
                if new:
                    stats.append([row, 1, doc, hashlib.sha256(content).digest()])
                else:
                    stats[i][1] += 1
                    if doc is not None and (stats[i][2] is None or doc > stats[i][2]):
                        stats[i][2] = doc
                rows.append((doc, i, row))
            if seen.bytes + 100 * len(rows) > memory:
                yield from flush()
        yield from flush()

    return run


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), LOCAL)], schema=LOCAL)


GROUPS = pa.schema([("rep", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def grace_groups(memory: int):
    """Rows (rep, hash, content, n, top) -> (rep, keep_id, group_size) by recursive partitioning."""

    def fits(records):
        """The groups of the records, or None once their distinct contents exceed the memory."""
        seen, stats, reps = ContentTable(), [], []
        for rep, h, n, top, content in records:
            i, new = seen.entry(h, content)
            if new:
                if seen.bytes > memory and len(stats):  # one text fits always
                    return None
                stats.append([n, top])
            else:
                stats[i][0] += n
                if top is not None and (stats[i][1] is None or top > stats[i][1]):
                    stats[i][1] = top
            reps.append((rep, i))
        return [(rep, stats[i][1], stats[i][0]) for rep, i in reps]

    def stored(path):
        with open(path, "rb", 1 << 20) as f:
            while head := f.read(struct.calcsize(HEAD)):
                rep, h, n, top, size = struct.unpack(HEAD, head)
                yield rep, h, n, None if top == -(1 << 63) else top, f.read(size)

    def split(records, folder, level):
        """Write the records to one spill file for each value of the next bits of their hash."""
        os.makedirs(folder)
        paths = [f"{folder}/{k}" for k in range(1 << FANOUT_BITS)]
        files = [open(p, "wb", 1 << 16) for p in paths]
        try:
            for rep, h, n, top, content in records:
                f = files[(h >> (58 - FANOUT_BITS * level)) & ((1 << FANOUT_BITS) - 1)]
                f.write(struct.pack(HEAD, rep, h, n, -(1 << 63) if top is None else top, len(content)))
                f.write(content)
        finally:
            for f in files:
                f.close()
        return paths

    def solve(path, level):
        found = fits(stored(path))
        if found is None and level > 12:
            raise MemoryError("distinct texts with one 64-bit hash exceed the memory")
        if found is not None:
            os.remove(path)
            yield found
            return
        parts = split(stored(path), f"{path}.d", level)
        os.remove(path)
        for p in parts:
            yield from solve(p, level + 1)

    def run(batches):
        def arriving():
            for batch in slices(batches, "content", 4 << 20):
                yield from zip(*(batch.column(c).to_pylist() for c in ("rep", "hash", "n", "top", "content")))

        def emit(found):
            for k in range(0, len(found), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found[k : k + 50_000])], schema=GROUPS)

        source, held, size = arriving(), [], 0
        for record in source:
            held.append(record)
            size += len(record[4]) + 100
            if size > memory:
                break
        else:
            yield from emit(fits(held) or [])
            return
        disks = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if d] or [None]
        folder = tempfile.mkdtemp(prefix="grace-", dir=disks[TaskContext.get().taskAttemptId() % len(disks)])
        try:
            def rest():
                while held:
                    yield held.pop()
                yield from source

            for path in split(rest(), f"{folder}/0", 0):
                for found in solve(path, 1):
                    yield from emit(found)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return run


def exact_groups(docs: DataFrame, memory: int = 48 << 20) -> DataFrame:
    """Groups of equal texts (A-Z lower-cased) over docs(doc_id, text, ...).

    Returns a row for each input row: doc_id, keep_id (the largest doc_id of the group), group_size, kept,
    text_sha256. Null text counts as empty; empty texts are one group; a row that occurs twice counts twice, and
    both are kept if theirs is the largest doc_id; a null doc_id never outranks another. Other columns are ignored.
    An empty table gives an empty result. memory bounds the table of one task, in bytes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    local = stage(rows.mapInArrow(fold_copies(memory), LOCAL_DDL), "exact")
    texts = local.where("content is not null").select("rep", "hash", "content", "n", "top").repartition("hash")
    groups = texts.mapInArrow(grace_groups(memory), "rep long, keep_id long, group_size long")
    return local.select("doc_id", "rep", "sha").join(groups, "rep").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, memory: int = 48 << 20) -> DataFrame:
    """docs without the rows that exact_groups() doesn't keep.

    A row goes by doc_id and text together: rows that share a doc_id but not the text are judged one by one, and a
    row that occurs twice stays or goes as one. A null doc_id is one like others, below all. All columns of docs are
    kept as they are.
    """
    doc, sha = unused(docs.columns, "lost_doc", "lost_sha")
    lost = exact_groups(docs, memory).where("not kept").select(F.col("doc_id").alias(doc), F.col("text_sha256").alias(sha)).distinct()
    plain = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.sha2(plain, 256) == F.col(sha)), "left_anti")
