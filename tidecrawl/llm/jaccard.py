"""Similarity join on word shingles with a token-group matrix.

Equal shingle sets are one set from the start. All shingles have one order: those with rare words first, known common
shingles last. Sets within the threshold share several of their first shingles, by the prefix principle. Those, with a
class of sizes, are the rows of the matrix. Sets are partitioned into groups around sets with which they share most
rows; a group too large for a task is cut into several. The matrix (row, group) gives each query set's overlap with
every group, and a group with less than the threshold needs is never looked at. Where a query arrives, its overlap
with the stored union of the group's shingles bounds every similarity; only groups that pass are opened and compared
member by member. The order decides how much work there is, never the result: every link between different sets joins
its components.
"""

from __future__ import annotations

import hashlib
import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecrawl.llm.common import U, bitmap_of, chained, components, flat, hashed_words, likely, mix, separators, slices, stage, unstage, without

WORD = separators((0x20, 0x20), (0x09, 0x0D))
SLICE_BYTES = 2 << 20
SHARED, TOKENS_PER_SHARED = (4, 12), 24  # rows that a query and a partner share at least: more in larger sets, where a passage in both is not enough
LOCAL, COMMON, MOST_COMMON = 3, 16, 50_000  # a common one's count in a slice and in all; entries of each list
GROUP_TOKENS = 1 << 18
QUERIES_PER_SALT = 4096
SALTS = 64  # tasks that may learn how a large group is cut
SEEN = 200_000  # sets that a task remembers so as to give their rows once


def shingles(column, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, the number of words of each row, and at each word the hash of k from it on."""
    words, counts = hashed_words(*flat(column), WORD)
    n = len(words)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled[: max(0, n - j)] = mix(rolled[: max(0, n - j)] * U(0xD1B54A32D192ED03) + words[j:] + U(j + 1))
    return words, counts, rolled


def sets_of(words: np.ndarray, counts: np.ndarray, rolled: np.ndarray, k: int):
    """The sorted distinct shingle hashes of each row, and where in all words each occurs."""
    at = 0
    for c in counts.tolist():
        if c >= k:
            tokens, first = np.unique(rolled[at : at + c - k + 1], return_index=True)
            yield tokens, at + first
        elif c:
            h = np.full(1, c, np.uint64)
            for w in words[at : at + c]:
                h = mix(h * U(0x8CB92BA72F3D8DD7) + w)
            yield h, np.full(1, at)
        else:
            yield np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at += c


def needed(n: int, num: int, den: int) -> int:
    """ceil(n * num / den)"""
    return -(-n * num // den)


class Order:
    """The order of shingles: a place below 2^58 of the hash, above it how common the words and the shingle are.

    words and shingles: known common ones, sorted, with the logarithms of their counts.
    """

    def __init__(self, words: tuple[np.ndarray, np.ndarray], shingles: tuple[np.ndarray, np.ndarray]) -> None:
        self.words, self.shingles = words, shingles

    @staticmethod
    def known(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        tokens, logs = table
        if not len(tokens):
            return np.zeros(len(keys), np.uint64)
        at = np.minimum(np.searchsorted(tokens, keys), len(tokens) - 1)
        return np.where(tokens[at] == keys, logs[at], U(0))

    def places(self, words: np.ndarray, rolled: np.ndarray, k: int) -> np.ndarray:
        """The place of the shingle at each word."""
        logs = self.known(self.words, words)
        level = np.zeros(len(words), np.uint64)
        for j in range(min(k, len(words))):
            level[: len(words) - j] += logs[j:]
        level = np.minimum(U(15), level // U(4 * k))  # coarse, so that one passage of rare words doesn't fill a prefix
        return self.known(self.shingles, rolled) << U(58) | level << U(54) | mix(rolled + U(0xA0761D6478BD642F)) >> U(10)


def common_order(rows: DataFrame, k: int, most: int) -> Order:
    """The most common words and shingles of all rows.

    Each slice of documents counts its own words and shingles and reports those that occur LOCAL times or more (a
    shingle: in so many documents); reports are summed. The lists, of most entries each, only order shingles, so a
    missed one costs time, not links.
    """

    def count(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            words, counts, rolled = shingles(batch.column("text"), k)
            each = [t for t, _ in sets_of(words, counts, rolled, k)]
            for word, found in ((True, words), (False, np.concatenate([np.zeros(0, np.uint64), *each]))):
                tokens, n = np.unique(found, return_counts=True)
                tokens, n = tokens[n >= LOCAL], n[n >= LOCAL]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), word)), pa.array(tokens.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "token", "n"])

    counts = rows.select("text").mapInArrow(chained(count), "word boolean, token long, n long").groupBy("word", "token").agg(F.sum("n").alias("n"))
    counts = stage(counts.where(F.col("n") >= COMMON), "counts")
    lists = []
    for word in (True, False):
        found = counts.where(F.col("word") == word).orderBy(F.desc("n"), "token").limit(most).toPandas()
        tokens = found["token"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(tokens)
        lists.append((tokens[order], np.minimum(63, np.log2(np.maximum(2, found["n"].to_numpy(np.int64)))).astype(np.uint64)[order]))
    unstage(counts)
    return Order(*lists)


def shared_rows(n: int, num: int, den: int) -> int:
    """How many of their first shingles two sets within the threshold share at least, if both have n or more."""
    return min(max(SHARED[0], min(SHARED[1], n // TOKENS_PER_SHARED)), needed(n, num, den))


def prefix(places: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first places of a set: two sets within the threshold share shared_rows() of them, taken for the smaller one."""
    n = len(places)
    size = min(n, n - needed(n, num, den) + shared_rows(n, num, den))
    return np.partition(places, size - 1)[:size]


def size_classes(n: int, num: int, den: int) -> list[int]:
    """The class of a set's size, then the lower ones that a smaller partner may be in; classes double."""
    own = n.bit_length()
    return [own, *range(needed(n, num, den).bit_length(), own)]


def class_id(tokens: np.ndarray, text: bytes, k: int) -> tuple[int, int] | tuple[None, None]:
    """128 bits that name a shingle set. A single shingle is named by its words, as one 64-bit hash is too little."""
    if not len(tokens):
        return None, None
    named = tokens.tobytes()
    if len(tokens) == 1:
        named = b"\n" + b" ".join(w[0] for w in islice(re.finditer(rb"[^\x20\x09-\x0D]+", text.lower()), k))
    digest = hashlib.blake2b(named, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def texts_of(batch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]


SETS_DDL = "doc_id long, th long, n_shingles long, uid long, cid long, cid2 long, own array<long>, lower array<long>"


def signed(batches, k: int, order: Order, num: int, den: int):
    """Rows (doc_id, th, text) -> SETS_DDL: set size, a number of the row, the set's name in two halves, matrix rows
    for the set's size and for smaller partners, unless this task gave them before.

    A set of one shingle that can link with equal sets only has no matrix rows.
    """
    seen: set[tuple] = set()
    alone = 1 if 2 * num > den else 0  # a set of so many shingles links with equal ones only
    row = TaskContext.get().partitionId() << 36
    kind = pa.list_(pa.int64())
    for batch in slices(batches, "text", SLICE_BYTES):
        words, counts, rolled = shingles(batch.column("text"), k)
        places = order.places(words, rolled, k)
        out = []
        for (tokens, first), text in zip(sets_of(words, counts, rolled, k), texts_of(batch)):
            n, own, lower = len(tokens), None, None
            name = class_id(tokens, text, k)
            if n > alone and name not in seen:
                seen.add(name)
                if len(seen) > SEEN:
                    seen.clear()
                first = prefix(places[first], num, den)
                own, *others = (mix(first + U(c * 0xE7037ED1A0B428DB & (1 << 64) - 1)).view(np.int64) for c in size_classes(n, num, den))
                lower = np.concatenate(others) if others else None
            out.append((n, row, *name, own, lower))
            row += 1
        n, uid, cid, cid2, own, lower = zip(*out)
        made = [pa.array(x, pa.int64()) for x in (n, uid, cid, cid2)] + [pa.array(own, kind), pa.array(lower, kind)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), *made], names=[x.split()[0] for x in SETS_DDL.split(", ")])


def tokenised(batches, k: int):
    """Rows (vid, cid, cid2, work, text) -> (vid, work, tokens), of the texts whose set has that name."""
    for batch in slices(batches, "text", SLICE_BYTES):
        names = zip(*(batch.column(c).to_pylist() for c in ("cid", "cid2")))
        some = [(i, s.tobytes()) for i, (name, (s, _), text) in enumerate(zip(names, sets_of(*shingles(batch.column("text"), k), k), texts_of(batch))) if class_id(s, text, k) == name]
        if some:
            at = pa.array([i for i, _ in some], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vid").take(at), batch.column("work").take(at), pa.array([t for _, t in some], pa.binary())], names=["vid", "work", "tokens"])


class Group:
    """A group's members, the union of their shingles, and for each shingle the members that have it."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]) -> None:
        self.ids = ids
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets])
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.union, start = np.unique(tokens[order], return_index=True)
        self.start = np.append(start, len(tokens))
        self.member = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.parent = list(range(len(ids)))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def linked(self, tokens: np.ndarray, num: int, den: int) -> np.ndarray:
        """Members within the threshold; none without opening the group if the union's overlap is too small."""
        at = np.searchsorted(self.union, tokens)
        at = at[self.union[np.minimum(at, len(self.union) - 1)] == tokens]
        if den * len(at) < num * len(tokens):
            return np.zeros(0, np.int64)
        n = self.start[at + 1] - self.start[at]
        where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[at], n)
        common = np.bincount(self.member[where], minlength=len(self.ids))
        return np.flatnonzero(den * common >= num * (len(tokens) + self.sizes - common))

    def join(self, members: np.ndarray) -> None:
        if len(members):
            r = self.root(int(members[0]))
            for m in members[1:].tolist():
                self.parent[self.root(m)] = r

    def inside(self, num: int, den: int) -> None:
        """Join all linked members; a member already joined to every other is not asked again."""
        for i, s in enumerate(self.sets):
            self.join(self.linked(s, num, den))
            if i % 64 == 0 and len({self.root(j) for j in range(len(self.ids))}) == 1:
                return


def opened(batches, num: int, den: int):
    """Rows sorted by (g, part, salt, asks), members first -> edges (a, b) that connect what links connect."""
    key, group, ids, sets, edges = None, None, [], [], []

    def close():
        if group is not None:
            edges.extend((group.ids[i], group.ids[group.root(i)]) for i in range(len(group.ids)) if group.root(i) != i)

    def build():
        g = Group(ids, sets)
        g.inside(num, den)
        return g

    for batch in slices(batches, "tokens", 2 << 20):
        for g, part, salt, asks, vid, raw in zip(*(batch.column(c).to_pylist() for c in ("g", "part", "salt", "asks", "vid", "tokens"))):
            if (g, part, salt) != key:
                if group is None and ids:
                    group = build()
                close()
                key, group, ids, sets = (g, part, salt), None, [], []
            tokens = np.frombuffer(raw, np.uint64)
            if not asks:
                ids.append(vid)
                sets.append(tokens)
                continue
            if group is None:
                group = build() if ids else None
            if group is not None:
                found = group.linked(tokens, num, den)
                if len(found):
                    group.join(found)
                    edges.append((vid, group.ids[int(found[0])]))
        if len(edges) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges)], names=["a", "b"])
            edges.clear()
    if group is None and ids:
        group = build()
    close()
    if edges:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges)], names=["a", "b"])


def document_key(doc_id: str) -> list:
    """A doc_id, null or not, as two columns that are never null."""
    return [F.isnull(doc_id).alias("no_id"), F.coalesce(doc_id, F.lit(0)).alias("id")]


def classified(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, th, n_shingles, first) for each row of docs: th hashes the text, first is the component's least
    struct(no_id, doc_id, th); null without words.

    Inside the join a set goes by 64 bits of its name (cid); two sets that share them are asked about together, and
    each counts by itself (vid) as soon as its shingles are there.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    order = common_order(rows, k, MOST_COMMON)
    order = docs.sparkSession.sparkContext.broadcast((order.words, order.shingles))
    sets = stage(rows.mapInArrow(chained(lambda b: signed(b, k, Order(*order.value), num, den)), SETS_DDL), "sets")
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "th")).alias("first")
    classes = stage(sets.where("cid is not null").groupBy("cid", "cid2").agg(F.min("uid").alias("vid"), first), "classes")

    cells = sets.where("own is not null").select(F.explode("own").alias("row"), "cid", "n_shingles", F.lit(True).alias("stores"))
    cells = cells.union(sets.where("lower is not null").select(F.explode("lower").alias("row"), "cid", "n_shingles", F.lit(False)))
    lead = F.min(F.when(F.col("stores"), F.col("cid"))).alias("lead")
    shared = cells.groupBy("row").agg(lead, F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo <> hi and lead is not null").select("row", "lead")
    hits = stage(cells.join(shared, "row").distinct(), "hits")

    smallest = f"(n_shingles * {num} + {den - 1}) div {den}"  # partner
    enough = F.expr(f"least(greatest({SHARED[0]}, least({SHARED[1]}, {smallest} div {TOKENS_PER_SHARED})), ({smallest} * {num} + {den - 1}) div {den})")
    stored = hits.where("stores")
    near = stored.groupBy("cid", "n_shingles", "lead").agg(F.count("*").alias("n")).where(F.col("n") >= F.least(F.lit(SHARED[0]), enough))
    # of leads with about as many rows the least, so that families don't fall apart
    best = near.groupBy("cid").agg(F.max(F.struct(F.floor(F.log2("n")).alias("n"), F.negative(F.col("lead").cast("decimal(20)")).alias("order"), "lead")).alias("best"))
    home = stored.select("cid", "n_shingles").distinct().join(best, "cid", "left").select("cid", "n_shingles", F.coalesce("best.lead", "cid").alias("g"))
    homes = stage(home.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS))), "homes")
    large = homes.groupBy("g").agg(F.sum("n_shingles").alias("load")).where(F.col("load") > GROUP_TOKENS)
    large = large.select("g", F.ceil(F.col("load") / GROUP_TOKENS).alias("cut"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")).alias("salt"))
    part = F.pmod(F.xxhash64("cid"), F.coalesce("cut", F.lit(1))).cast("int").alias("part")
    home = stage(homes.join(large, ["g", "salt"], "left").select("cid", "n_shingles", "g", part), "groups")
    matrix = stored.select("row", "cid").join(home.select("cid", "g"), "cid").select("row", "g").distinct()  # by whole groups: a family's parts have the same rows
    asks = hits.select("row", "cid", "n_shingles").join(matrix, "row").groupBy("cid", "n_shingles", "g").agg(F.count("*").alias("n")).where(F.col("n") >= enough)
    sizes = home.groupBy("g", "part").agg(F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"))
    asks = asks.join(sizes, "g").where(f"{den} * hi >= {num} * n_shingles and {den} * n_shingles >= {num} * lo")
    asks = stage(asks.select("cid", "g", "part").join(home, ["cid", "g", "part"], "left_anti"), "asks")
    unstage(hits, homes)

    width = asks.groupBy("g", "part").agg(F.ceil(F.count("*") / QUERIES_PER_SALT).cast("int").alias("salts"))
    several = home.groupBy("g", "part").agg(F.count("*").alias("n")).where("n > 1").select("g", "part")
    wanted = several.join(width, ["g", "part"], "full").select("g", "part", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    members = home.join(wanted, ["g", "part"]).select("cid", "g", "part", "salt", F.lit(False).alias("asks"))
    queries = asks.join(width, ["g", "part"]).select("cid", "g", "part", F.pmod(F.xxhash64("cid"), "salts").cast("int").alias("salt"), F.lit(True).alias("asks"))
    work = members.unionByName(queries).groupBy("cid").agg(F.collect_list(F.struct("g", "part", "salt", "asks")).alias("work"))
    candidates = stage(work.join(classes, "cid").select("vid", "cid", "cid2", "work", *document_key("first.doc_id"), "first.th"), "candidates")
    texts = likely(rows, "th", bitmap_of(candidates, "th")).groupBy(*document_key("doc_id"), "th").agg(F.first("text").alias("text"))
    texts = texts.join(candidates.hint("merge"), ["no_id", "id", "th"])  # how many there are grows with docs: no broadcast
    found = texts.mapInArrow(chained(lambda b: tokenised(b, k)), "vid long, work array<struct<g:long,part:int,salt:int,asks:boolean>>, tokens binary")
    found = found.select("vid", F.explode("work").alias("at"), "tokens").select("at.*", "vid", "tokens")
    found = found.repartition("g", "part", "salt").sortWithinPartitions("g", "part", "salt", "asks")
    edges = stage(found.mapInArrow(chained(lambda b: opened(b, num, den)), "a long, b long"), "links")
    unstage(candidates, asks, home)

    roots = components(edges).withColumnRenamed("v", "vid")
    named = classes.join(roots, "vid", "left").select("cid", "cid2", "first", F.coalesce("root", "vid").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("least")).repartition("root")  # lets AQE split a large component
    named = named.join(least, "root").select("cid", "cid2", F.col("least").alias("first"))
    return sets.select("doc_id", "th", "n_shingles", "cid", "cid2").join(named, ["cid", "cid2"], "left").select("doc_id", "th", "n_shingles", "first")


def similar_components(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text, ...).

    Words are runs of bytes other than 20 and 09-0D, A-Z lower-cased; a set holds the distinct k-word shingles, or
    with fewer words the whole sequence as one. Documents link when den * intersection >= num * union; component_id
    is the least doc_id that links reach. Null and empty texts have n_shingles 0 and are linked with nothing. Equal
    sets, repeated rows included, are one component; rows of one doc_id with unlike texts are in different ones. Null
    doc_ids never name a component that has others. Other columns are ignored. Sets are told apart by 128 bits of
    hash, shingles within a comparison by 64.
    """
    return classified(docs, k, num, den).select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def drop_similar(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """docs with one document of each component, that of the least doc_id; of texts that share it, that of least hash.

    Rows that agree in doc_id and text are one document: they stay or go together. Texts without words all stay. All
    columns of docs are kept as they are.
    """
    rows = classified(docs, k, num, den).where("first is not null")
    return without(docs, rows.where("not (doc_id <=> first.doc_id and th = first.th)").select("doc_id", "th"))
