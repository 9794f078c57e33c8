"""Quality classification by regularised quadratic discriminant analysis.

Transformed statistics of a text (lengths, shares of character classes, repetition) are taken first for the documents
that have a label. For each class these training rows give a mean and a covariance, shrunk towards a multiple of the identity. The score is
the logistic of the difference of the two log densities, from Mahalanobis distances under cached Cholesky factors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecrawl.llm.common import bitmap_of, chained, likely, slices, unused

STATS = ("chars", "words", "word_length", "long_words", "upper", "digits", "symbols", "points", "bars", "lines", "distinct", "top_word", "adjacent", "capital", "odd_ends", "repeated_lines", "high_bytes")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"!#$%&*+<=>@[]^_`{}~", np.uint8)] = True


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text; shares as square roots, counts as logarithms."""
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size = max(1, int(raw.sum()))
    words = text.split()
    n = len(words) + 8  # shares of few words or lines count less
    n_lines = text.count("\n") + 4
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = text.split("\n")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = sum([not w[-1].isalnum() and w[-1] not in ".,;:?" for w in words])
    root = math.sqrt
    letters = max(1, int(raw[65:91].sum() + raw[97:123].sum()))
    return [
        math.log1p(len(text)),
        math.log1p(len(words)),
        math.log1p(lengths.mean()) if len(words) else 0.0,
        root((lengths > 12).sum() / n),
        root(raw[65:91].sum() / letters),
        root(raw[48:58].sum() / size),
        root(raw[SYMBOLS].sum() / size),
        root((raw[44] + raw[46]) / n),
        root(raw[124] / n),
        root(len(lines) / n),
        root((len(counts) + 8) / n),
        root(max(0, max(counts.values(), default=0) - 1) / n),
        root(sum([a == b for a, b in zip(words, words[1:])]) / n),
        root(sum([w[0].isupper() for w in words]) / max(1, len(words))),
        root(ends / n),
        root((len(lines) - len(set(lines))) / n_lines),
        root(raw[128:].sum() / size),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of each row."""

    def run(batches):
        for batch in slices(batches, "text", 2 << 20):
            rows = np.array([statistics(t) for t in batch.column("text").to_pylist()])
            ends = np.arange(0, rows.size + 1, len(STATS), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))], names=["doc_id", "stats"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(chained(run), "doc_id long, stats array<double>")


@dataclass
class Model:
    """For classes 0 and 1: prior, mean, inverse Cholesky factor and log determinant; over scaled statistics."""

    centre: np.ndarray
    scale: np.ndarray
    prior: tuple[float, float]
    means: list[np.ndarray]
    factors: list[np.ndarray]
    logdets: list[float]
    temper: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if min(self.prior) == 0:  # one class or none is known
            return np.full(len(x), self.prior[1] if max(self.prior) else 0.5)
        z = (x - self.centre) / self.scale
        density = []
        for c in (0, 1):
            y = (z - self.means[c]) @ self.factors[c].T
            density.append(math.log(self.prior[c]) - 0.5 * ((y * y).sum(1) + self.logdets[c]))
        return 1 / (1 + np.exp(-np.clip(self.temper * (density[1] - density[0]), -30, 30)))


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of products of the statistics for each class of rows(stats, quality), over all rows.

    Tasks fold their rows; what is shuffled and sent to the driver is one number for each pair of statistics.
    """
    d = len(STATS) + 1

    def run(batches):
        total = np.zeros((2, d, d))
        for batch in batches:
            x = np.array(batch.column("stats").to_pylist(), float).reshape(-1, d - 1)
            x = np.hstack((np.ones((len(x), 1)), x))
            y = batch.column("quality").to_numpy(zero_copy_only=False)
            for c in (0, 1):
                total[c] += x[y == c].T @ x[y == c]
        flat = total.ravel()
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(flat[some])], names=["cell", "v"])

    cells = rows.select("stats", F.col("quality").cast("int").alias("quality")).mapInArrow(chained(run), "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    total = np.zeros(2 * d * d)
    for r in cells.collect():
        total[r.cell] = r.v
    total = total.reshape(2, d, d)
    return {c: (total[c, 0, 0], total[c, 0, 1:], total[c, 1:, 1:]) for c in (0, 1)}


def fit(rows: DataFrame, shrinkage: float = 0.1, temper: float = 0.5) -> Model:
    """Model from rows(stats, quality); shrinkage is the identity's share of each covariance.

    temper flattens the scores, as the statistics are not independent; it doesn't move the point where both
    classes are as likely.
    """
    found = moments(rows)
    n = [found[c][0] for c in (0, 1)]
    d, all_n = len(STATS), max(1.0, sum(n))
    centre = (found[0][1] + found[1][1]) / all_n
    spread = np.diag(found[0][2] + found[1][2]) / all_n - centre**2
    scale = np.sqrt(np.maximum(spread, 1e-6))
    means, factors, logdets = [], [], []
    for c in (0, 1):
        mean = found[c][1] / max(1.0, n[c])
        cov = (found[c][2] / max(1.0, n[c]) - np.outer(mean, mean)) / np.outer(scale, scale)
        share = min(1.0, shrinkage + d / max(1.0, n[c]) * 0.5)
        cov = (1 - share) * cov + share * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        means.append((mean - centre) / scale)
        factors.append(np.linalg.inv(factor))
        logdets.append(2 * float(np.log(np.diag(factor)).sum()))
    return Model(centre, scale, (n[0] / all_n, n[1] / all_n), means, factors, logdets, temper)


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs plus the score of each row's text, row by row: no join, whatever doc_ids there are."""
    kinds = dict(docs.dtypes)

    def run(batches):
        for batch in slices(batches, "text", 2 << 20):
            x = np.array([statistics(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], names=[*batch.schema.names, name])

    return docs.mapInArrow(chained(run), ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + f", `{name}` double")


def held_out(doc_id="doc_id", parts: int = 4, part: int = 2):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, shrinkage: float) -> Model:
    """The model of the labels that are not held out. Texts without a label are mostly passed over by a bitmap of
    doc_ids; the statistics of the others, not their texts, are joined with the labels."""
    train = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(~held_out())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return fit(with_statistics(likely(rows, "doc_id", bitmap_of(train, "doc_id"))).join(train, "doc_id"), shrinkage)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, shrinkage: float = 0.1) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text, ...).

    Learns from labels(doc_id, quality) whose crc32(doc_id as text) mod 4 is not 2; only the text's statistics are
    inputs. Null and empty texts are scored like any other, from zeros. Labels that are neither 0 nor 1, or of no
    document, are left out; repeated ones count each time. Without labels of both classes the score is the share
    of label 1, or 0.5 without any. A null doc_id is never held out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = scored(rows, trained(rows, labels, shrinkage))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs without the rows whose text the classifier rejects (a score below threshold).

    Each row is judged by its own text: of rows that share a doc_id, null or not, only those with a bad text go, and
    repeated rows are treated alike. All columns of docs are kept as they are, also those named like scores.
    """
    (score,) = unused(docs.columns, "score")
    return scored(docs, trained(docs, labels, 0.1), score).where(F.col(score) >= threshold).drop(score)
