"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is a slice of documents. Its word sequence gets a suffix array, sparse in that only suffixes whose leading
words start some benchmark window are held, and ordered as far as a window reaches. Every benchmark suffix of a window
or more, equal beginnings once, is binary-searched in it, all at once; ranges give the occurrences, which joined are
the longest verbatim stretches of a document, and on one diagonal the longest matches with an item. No shuffle takes
place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecrawl.llm.common import U, chained, flat, hashed_words, mix, separators, slices, stage, unused

WORD = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
SHARD_BYTES = 2 << 20
GRAM = 3
ROUND = 8  # blocks of the benchmark that one plan passes through


def windows_of(ids: list[str], texts: list[bytes], width: int) -> dict:
    """The distinct windows of a block of items: words (zero after the end), lengths, and who has them where."""
    data, offs = flat(pa.array(texts, pa.large_binary()))
    words, counts = hashed_words(data, offs, WORD)
    rows, lengths, item, start, at = [], [], [], [], 0
    for i, n in enumerate(counts.tolist()):
        for s in range(max(1, n - width + 1) if n else 0):
            k = min(width, n)
            rows.append(np.concatenate((words[at + s : at + s + k], np.zeros(width - k, np.uint64))))
            lengths.append(k)
            item.append(i)
            start.append(s)
        at += n
    if not rows:
        return {"n": 0}
    unique, back = np.unique(np.array(rows), axis=0, return_inverse=True)
    back = back.ravel()
    length = np.zeros(len(unique), np.int64)
    length[back] = lengths
    order = np.argsort(back, kind="stable")
    lead = {k: np.unique(gram(unique[length == k] if k < GRAM else unique[length >= k], k)) for k in range(1, GRAM + 1) if ((length == k) if k < GRAM else (length >= k)).any()}
    return {"n": len(unique), "words": unique, "length": length, "lead": lead, "has_at": np.searchsorted(back[order], np.arange(len(unique) + 1)), "item": np.array(item)[order], "start": np.array(start)[order], "ids": ids}


def gram(rows: np.ndarray, k: int) -> np.ndarray:
    """One hash of the first k columns."""
    out = np.full(len(rows), k, np.uint64)
    for j in range(k):
        out = mix(out * U(0x9E3779B97F4A7C15) + rows[:, j])
    return out


def below(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differ = a != b
    first = differ.argmax(1)
    at = np.arange(len(a))
    return differ[at, first] & (a[at, first] < b[at, first])


class Shard:
    """Words of some documents and the sparse suffix array over them, ordered by the first width words."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, width: int, lead: dict[int, np.ndarray]) -> None:
        self.ends = np.cumsum(counts)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        left = self.ends[self.doc] - np.arange(len(words))  # words up to the end of the document
        padded = np.concatenate((words, np.zeros(width, np.uint64)))
        keep = np.zeros(len(words), bool)
        for k, grams in lead.items():
            hashed = np.full(len(words), k, np.uint64)
            for j in range(k):
                hashed = mix(hashed * U(0x9E3779B97F4A7C15) + padded[j : j + len(words)])
            bits = np.zeros(1 << 20, bool)
            bits[grams >> U(44)] = True
            some = np.flatnonzero(bits[hashed >> U(44)] & (left >= k))
            at = np.minimum(np.searchsorted(grams, hashed[some]), len(grams) - 1)
            keep[some[grams[at] == hashed[some]]] = True
        self.at = np.flatnonzero(keep)
        reach = np.arange(width)
        rows = padded[self.at[:, None] + reach]
        rows[reach >= left[self.at][:, None]] = 0  # a suffix ends with its document
        order = np.lexsort(rows.T[::-1]) if len(rows) else np.zeros(0, np.int64)
        self.at, self.rows = self.at[order], rows[order]

    def ranges(self, windows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window the range of suffixes that begin with its first length words."""
        inside = np.arange(windows.shape[1]) < length[:, None]

        def bound(upper: bool) -> np.ndarray:
            lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), len(self.at), np.int64)
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                row = np.where(inside, self.rows[np.minimum(mid, len(self.at) - 1)], U(0))
                right = open_ & (~below(windows, row) if upper else below(row, windows))
                lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
            return lo

        if not len(self.at):
            return np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
        return bound(False), bound(True)


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) for all values of the ranges."""
    n = hi - lo
    owner = np.repeat(np.arange(len(lo)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + lo[owner]


def occurrences(words, counts, block, width):
    """(position, window) of every occurrence of a window in the shard, and the shard."""
    shard = Shard(words, counts, width, block["lead"])
    lo, hi = shard.ranges(block["words"], block["length"])
    window, rank = spread(lo, hi)
    return shard, shard.at[rank], window


def spans_pass(sent, width: int, keep: list[str], made: list[str], first: bool):
    """Adds a broadcast block's covered word spans and items to each row.

    keep: the columns that pass through; made: names for the number of words, the spans and the items.
    """

    def run(batches):
        block = sent.value
        for batch in slices(batches, "text", SHARD_BYTES):
            data, offs = flat(batch.column("text"))
            words, counts = hashed_words(data, offs, WORD)
            n = batch.num_rows
            spans = [b""] * n if first else batch.column(made[1]).to_pylist()
            items = [[] for _ in range(n)] if first else batch.column(made[2]).to_pylist()
            if block["n"] and len(words):
                shard, at, window = occurrences(words, counts, block, width)
                if len(at):
                    begin = shard.ends - counts
                    doc = shard.doc[at]
                    order = np.lexsort((at, doc))
                    pairs = np.stack((at - begin[doc], at - begin[doc] + block["length"][window]), 1)[order].astype("<i4")
                    touched, where = np.unique(doc[order], return_index=True)
                    for d, p in zip(touched.tolist(), np.split(pairs, where[1:])):
                        spans[d] += merged(p).tobytes()
                    seen = np.unique(doc * block["n"] + window)
                    owner, holder = spread(block["has_at"][seen % block["n"]], block["has_at"][seen % block["n"] + 1])
                    found = np.unique((seen // block["n"])[owner] * len(block["ids"]) + block["item"][holder])
                    for d, i in zip((found // len(block["ids"])).tolist(), (found % len(block["ids"])).tolist()):
                        items[d].append(block["ids"][i])
            out = [batch.column(c) for c in keep] + [pa.array(counts, pa.int64()), pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(out, names=[*keep, *made])

    return run


def merged(pairs: np.ndarray) -> np.ndarray:
    """Sorted disjoint spans that cover the same words."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate(([True], pairs[1:, 0] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(pairs) - 1]))
    return np.stack((pairs[new, 0], reach[last]), 1).astype("<i4")


def report(keep: list[str], made: list[str], names: list[str]):
    """Sums up the spans and items of each row under the names."""

    def run(batches):
        for batch in batches:
            hit, n_items, digest = [], [], []
            for spans, items in zip(batch.column(made[1]).to_pylist(), batch.column(made[2]).to_pylist()):
                pairs = np.frombuffer(spans, "<i4").reshape(-1, 2)
                hit.append(int(np.diff(merged(pairs), axis=1).sum()) if len(pairs) else 0)
                ids = set(items)
                n_items.append(len(ids))
                digest.append(hashlib.sha256(",".join(sorted(ids - {None})).encode()).hexdigest())
            cols = [*(batch.column(c) for c in keep), batch.column(made[0]), pa.array(hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), batch.column(made[1])]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *names])

    return run


def blocks_of(benchmark: DataFrame, width: int, limit: int):
    """Blocks of items, each of at most limit bytes (or one item), so that what tasks receive is bounded."""
    ids, texts, size = [], [], 0
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    for item, text in rows.toLocalIterator():
        if ids and size + len(text) > limit:
            yield windows_of(ids, texts, width)
            ids, texts, size = [], [], 0
        ids.append(item)
        texts.append(bytes(text))
        size += len(text)
    yield windows_of(ids, texts, width)


FOUND = ["n_words", "n_hit", "n_items", "items_sha256", "spans"]


def _matched(docs: DataFrame, benchmark: DataFrame, width: int, block_bytes: int, keep: list[str], names: list[str]) -> DataFrame:
    """The columns keep of docs plus what FOUND lists under the names."""
    kinds = dict(docs.dtypes)
    made = unused(keep, "words", "spans", "items")
    passed = ", ".join(f"`{c}` {kinds[c]}" for c in dict.fromkeys([*keep, "text"]))
    carried = list(dict.fromkeys([*keep, "text"]))
    now, passes = docs.select(carried), []
    for i, block in enumerate(blocks_of(benchmark, width, block_bytes)):
        if len(passes) == ROUND:
            now, passes = stage(now.mapInArrow(chained(*passes), f"{passed}, `{made[0]}` long, `{made[1]}` binary, `{made[2]}` array<string>"), "matched"), []
        passes.append(spans_pass(docs.sparkSession.sparkContext.broadcast(block), width, carried, made, i == 0))
    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"`{n}` {t}" for n, t in zip(names, ("long", "long", "long", "string", "binary")))])
    return now.mapInArrow(chained(*passes, report(keep, made, names)), ddl)


def match_documents(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """All columns of docs plus n_words, n_hit, n_items, items_sha256, spans and contaminated, which replace own ones
    of these names.

    Words are runs of bytes outside 00-2F, 3A-60 and 7B-7F after lower-casing A-Z. A window is width consecutive
    words of an item; a shorter item is one window. n_hit counts document words inside any occurrence of a window;
    spans lists the covered word ranges, as pairs of little-endian 32-bit integers: the longest verbatim matches,
    joined where they touch. A null or empty text has no words; items without words match nothing; equal items all
    count; items with a null item_id mark words like others, count as one in n_items and are left out of items_sha256;
    an empty benchmark leaves every document clean; repeated rows are treated alike. A benchmark beyond block_bytes is
    searched block by block, each in a further narrow pass; after every ROUND blocks the rows are written.
    """
    keep = [c for c in docs.columns if c not in (*FOUND, "contaminated")]
    return _matched(docs, benchmark, width, block_bytes, keep, FOUND).withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """docs without the rows that share a window with the benchmark; all columns are kept as they are.

    Each row is judged by its own text, whatever its doc_id, null included.
    """
    names = unused(docs.columns, *FOUND)
    found = _matched(docs, benchmark, width, block_bytes, docs.columns, names)
    return found.where(F.col(names[1]) == 0).drop(*names)


def longest_matches(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, doc_start, item_id, item_start, n_words): every maximal verbatim match of width words or more.

    Starts count words from 0. Items shorter than width match as a whole.
    """
    names = ["doc_id", "doc_start", "item_id", "item_start", "n_words"]

    def found(block):
        def run(batches):
            for batch in slices(batches, "text", SHARD_BYTES):
                words, counts = hashed_words(*flat(batch.column("text")), WORD)
                if not block["n"] or not len(words):
                    continue
                shard, at, window = occurrences(words, counts, block, width)
                owner, holder = spread(block["has_at"][window], block["has_at"][window + 1])
                pos, item, start = at[owner], block["item"][holder], block["start"][holder]
                size, doc = block["length"][window][owner], shard.doc[at][owner]
                order = np.lexsort((pos, pos - start, item, doc))
                pos, item, start, size, doc = (x[order] for x in (pos, item, start, size, doc))
                if not len(pos):
                    continue
                new = np.ones(len(pos), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (pos[1:] - start[1:] != pos[:-1] - start[:-1]) | (pos[1:] != pos[:-1] + 1)
                head = np.flatnonzero(new)
                tail = np.concatenate((head[1:] - 1, [len(pos) - 1]))
                begin = (shard.ends - counts)[doc[head]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc[head])), pa.array(pos[head] - begin), pa.array([block["ids"][i] for i in item[head].tolist()], pa.string()), pa.array(start[head]), pa.array(pos[tail] - pos[head] + size[tail])], names=names)

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in blocks_of(benchmark, width, block_bytes):
        part = rows.mapInArrow(chained(found(block)), "doc_id long, doc_start long, item_id string, item_start long, n_words long")
        out = part if out is None else out.unionByName(part)
    return out
