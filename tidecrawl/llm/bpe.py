"""Byte-level BPE with sentencepiece.

A sentencepiece BPE model is serialised straight from a rank vocabulary: piece i is the token of rank i, its bytes
mapped to printable characters, with score -i, and normalisation is the identity. Each match of the pre-token
pattern is encoded by itself; ids decode by the inverse byte mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecrawl.llm.common import chained, slices

CACHE_BYTES = 64 << 20  # of remembered pre-tokens and their ids
ENTRY = 200  # bytes that an entry takes besides
LONGEST = 1 << 10  # characters of a pre-token that is remembered
NORMAL, UNKNOWN = 1, 2  # piece types of the model format
BPE = 2  # model type of the model format


def byte_letters() -> list[str]:
    """A printable character for each byte: itself if it is a visible Latin-1 character, else the next from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(0x100 + hidden.index(b)) for b in range(256)]


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def field(number: int, value) -> bytes:
    """One field of a protocol buffer: bytes or str, float, or int."""
    if isinstance(value, str):
        value = value.encode()
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece model whose piece i is tokens[i]; one unknown piece follows, as the format asks for it."""
    letters = byte_letters()
    out = [field(1, field(1, "".join(letters[b] for b in t)) + field(2, float(-rank)) + field(3, NORMAL)) for rank, t in enumerate(tokens)]
    out.append(field(1, field(1, "<unk>") + field(2, 0.0) + field(3, UNKNOWN)))
    trainer = field(3, BPE) + field(4, len(tokens) + 1) + field(40, len(tokens)) + b"".join(field(k, -1) for k in (41, 42, 43))
    normaliser = field(1, "identity") + field(2, b"") + field(3, 0) + field(4, 0) + field(5, 0)
    return b"".join(out) + field(2, trainer) + field(3, normaliser)


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks from a file of lines 'base64 rank'."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


class ByteBpe:
    """Encoder and decoder; remembers pre-tokens seen so far, up to CACHE_BYTES of them."""

    def __init__(self, model: bytes, pattern: str) -> None:
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.letters = byte_letters()
        back = {c: b for b, c in enumerate(self.letters)}
        size = self.processor.get_piece_size() - 1  # without the unknown piece
        self.tokens = [bytes(back[c] for c in self.processor.id_to_piece(i)) for i in range(size)]
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.seen: dict[str, bytes] = {}
        self.held = 0

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        words = self.split(text)
        seen = self.seen
        try:
            return b"".join([seen[w] for w in words])
        except KeyError:
            pass
        if self.held > CACHE_BYTES:
            seen.clear()
            self.held = 0
        found: dict[str, bytes] = {}
        missing = [w for w in set(words) if w not in seen]
        mapped, left = [], []
        for w in missing:
            raw = w.encode()
            if (i := self.whole.get(raw)) is not None:  # a whole token needs no merges
                found[w] = struct.pack("<I", i)
            else:
                mapped.append("".join([self.letters[b] for b in raw]))
                left.append(w)
        for w, ids in zip(left, self.processor.encode(mapped, num_threads=1) if mapped else []):
            found[w] = np.array(ids, "<u4").tobytes()
        for w, ids in found.items():
            if len(w) <= LONGEST:
                seen[w] = ids
                self.held += 4 * len(w) + len(ids) + ENTRY
        return b"".join([found[w] if w in found else seen[w] for w in words])

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """All columns of docs plus ids (array<int>, unless with_ids is false), n_tokens, ids_sha256, decoded_sha256.

    The vocabulary is read once, on the driver, and its serialised model (about the file's size) broadcast. Null
    and empty texts have no ids. A text's special-token strings are ordinary text. Own columns of the same names
    are replaced.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(serialise(read_ranks(rank_path)))
    made = ["ids"] * with_ids + ["n_tokens", "ids_sha256", "decoded_sha256"]
    kinds = dict(docs.dtypes)
    keep = [c for c in docs.columns if c not in {"ids", "n_tokens", "ids_sha256", "decoded_sha256"}]

    def run(batches: Iterable[pa.RecordBatch]):
        coder = ByteBpe(model.value, pattern)
        for batch in slices(batches, "text", 4 << 20):
            ids = [coder.encode(t) if t else b"" for t in batch.column("text").to_pylist()]
            out = [batch.column(c) for c in keep]
            if with_ids:
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
            out += [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids])]
            yield pa.RecordBatch.from_arrays(out, names=[*keep, *made])

    ddl = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["ids array<int>"] * with_ids + ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"])
    return docs.select(*keep).mapInArrow(chained(run), ddl)


def decode_documents(rows: DataFrame, rank_path: str) -> DataFrame:
    """All columns of rows plus decoded (binary): the bytes of the column ids; null ids give no bytes."""
    model = rows.sparkSession.sparkContext.broadcast(serialise(read_ranks(rank_path)))

    @F.pandas_udf("binary")
    def decoded(ids):
        coder = ByteBpe(model.value, "")
        return ids.map(lambda x: b"" if x is None else coder.decode(np.asarray(x, "<u4").tobytes()))

    return rows.withColumn("decoded", decoded("ids"))
