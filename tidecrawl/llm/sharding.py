"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Equal texts are one group. Groups of one size are a run, so there are sqrt(2 * total bytes) runs at most. These are
packed in one stream, the largest first: each group goes into the bin with the tightest remaining capacity that fits,
found in a balanced tree of remaining capacities. The stream's task holds the bins and nothing else; neither it nor the
driver ever holds the runs. Groups then look up their run, in Spark.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecrawl.llm.common import stage, unstage

SALTS = 64
SLOT_BUCKETS = 1024


@dataclass
class Node:
    key: tuple[int, int]
    rank: float = field(default_factory=random.Random(9).random)
    left: Node | None = None
    right: Node | None = None


def split(node: Node | None, key) -> tuple[Node | None, Node | None]:
    if node is None:
        return None, None
    if node.key < key:
        node.right, rest = split(node.right, key)
        return node, rest
    rest, node.left = split(node.left, key)
    return rest, node


def merge(a: Node | None, b: Node | None) -> Node | None:
    if a is None or b is None:
        return a or b
    if a.rank < b.rank:
        a.right = merge(a.right, b)
        return a
    b.left = merge(a, b.left)
    return b


class Bins:
    """Open bins in a treap, ordered by remaining capacity, then number."""

    def __init__(self) -> None:
        self.tree: Node | None = None

    def add(self, remaining: int, number: int) -> None:
        low, high = split(self.tree, (remaining, number))
        self.tree = merge(merge(low, Node((remaining, number))), high)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return the bin with the smallest remaining capacity that is least or more."""
        low, high = split(self.tree, (least, -1))
        if high is None:
            self.tree = low
            return None
        node = high
        while node.left:
            node = node.left
        _, high = split(high, (node.key[0], node.key[1] + 1))
        self.tree = merge(low, high)
        return node.key

    def take_emptiest(self) -> tuple[int, int]:
        node = self.tree
        while node.right:
            node = node.right
        self.tree, _ = split(self.tree, node.key)
        return node.key


def pack(runs: Iterable[tuple[int, int]], bins: int | None, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """Best fit of runs (size, how many) that come with falling sizes: (size, first, end, bin) for ranks first..end-1.

    With bins None, new bins open as needed, and a group larger than the capacity has a bin to itself. With a fixed
    number of bins, what fits in none goes to the bin with most room.
    """
    found, opened = Bins(), bins or 0
    for b in range(opened):
        found.add(capacity, b)
    for size, n in runs:
        rank = 0
        while rank < n:
            at = found.take(size)
            if at is None and bins is None:
                at, opened = (max(capacity, size), opened), opened + 1
            if at is None:
                at = found.take_emptiest()
                some = 1
            else:
                some = min(n - rank, at[0] // size)
            yield size, rank, rank + some, at[1]
            found.add(at[0] - some * size, at[1])
            rank += some


def level(total: int, runs: Iterable[tuple[int, int]], bins: int) -> int:
    """The capacity that makes bins of near equal size: groups above the mean get a bin each and leave the rest.

    Reads no more than the first bins runs, which come with falling sizes.
    """
    left, free = total, bins
    for size, n in runs:
        for _ in range(min(n, free)):
            if free > 1 and size * free > left:
                left, free = left - size, free - 1
            else:
                return -(-left // free)
    return max(1, -(-left // max(1, free)))


def packed(bins: int | None, capacity: int):
    """Sorted rows (whole, n) -> (whole, first, end, shard), in a stream."""
    names = ["whole", "first", "end", "shard"]

    def run(batches):
        runs = ((size, n) for batch in batches for size, n in zip(batch.column("whole").to_pylist(), batch.column("n").to_pylist()))
        out = []

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=names)

        for row in pack(runs, bins, capacity):
            out.append(row)
            if len(out) == 10_000:
                yield batch_of()
                out = []
        if out:
            yield batch_of()

    return run


def shard_documents(docs: DataFrame, shards: int | None = 16, capacity: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs(doc_id, text, ...).

    A row's size is the UTF-8 bytes of its text, 0 for null, plus 1; null and empty texts are one group. With
    shards, the law "bytes" holds: sizes near equal, a group larger than its share alone in its shard. With
    capacity instead, as few shards of that capacity as best-fit-decreasing finds. Slots run from 0 in each shard,
    without gaps, in an order that a hash of doc_id gives. grown_shard is null, as it is for this law. Null doc_ids and
    repeated rows have a slot each. Other columns are ignored. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"))
    rows = stage(rows, "sizes")
    groups = rows.groupBy("key").agg(F.sum("size").alias("whole")).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    groups = stage(groups, "bins")
    cells = groups.groupBy("whole", "salt").agg(F.count("*").alias("n"))
    runs = stage(cells.groupBy("whole").agg(F.sum("n").alias("n")), "runs")
    if not capacity:
        total = runs.agg(F.sum(F.col("whole") * F.col("n"))).first()[0] or 0
        largest = [(r.whole, r.n) for r in runs.orderBy(F.desc("whole")).limit(shards + 1).collect()]
        at, bins = level(total, largest, shards), shards
    else:
        at, bins = capacity, None
    ordered = runs.repartition(1).sortWithinPartitions(F.desc("whole"))  # best fit is one sequence; it streams
    plan = stage(ordered.mapInArrow(packed(bins, at), "whole long, first long, end long, shard int"), "plan")

    before = F.sum("n").over(Window.partitionBy("whole").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("whole", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = groups.withColumn("k", F.row_number().over(Window.partitionBy("whole", "salt").orderBy("key")) - 1)
    ranked = ranked.join(cells, ["whole", "salt"]).select("key", "whole", (F.col("base") + F.col("k")).alias("rank"))
    placed = ranked.join(plan, (ranked["whole"] == plan["whole"]) & (ranked["rank"] >= plan["first"]) & (ranked["rank"] < plan["end"])).select("key", "shard")
    placed = stage(rows.join(placed, "key").select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SLOT_BUCKETS)).alias("bucket")), "placed")
    unstage(rows, groups, runs, plan)

    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    slotted = placed.withColumn("k", F.row_number().over(order) - 1).join(counts, ["shard", "bucket"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
