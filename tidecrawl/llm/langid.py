"""Language identification of words and documents by a linear-chain conditional random field.

Emission features of a word are its affixes, character n-grams and entries of a lexicon of frequent training words;
learned transitions carry the language from word to word, so that code-switched text is labelled piecewise. Marginals
come from forward-backward. A document's language is the one with the greatest expected number of words.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecrawl.llm.common import U, mix, slices

BITS = 15
SEGMENT = 32
CACHE_BYTES = 64 << 20  # of remembered words and their potentials
ENTRY = 200  # bytes that an entry takes besides
FIND = regex.compile(r"\p{L}+").findall  # letters only: other numerals than digits are none


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, feature) pairs: prefixes and suffixes of 1 to 3, inner 2- and 3-grams, lexicon entries."""
    n = len(words)
    length = np.fromiter(map(len, words), np.int64, n)
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    start = np.cumsum(length) - length
    owner = np.repeat(np.arange(n), length)
    at = np.arange(len(code)) - start[owner]
    left = length[owner] - at
    owners, found = [np.arange(n)], [np.zeros(n, np.uint64)]
    rolled = np.zeros(len(code), np.uint64)
    for k in (1, 2, 3):
        rolled[: len(code) - k + 1] = rolled[: len(code) - k + 1] * U(0x100000001B3) + code[k - 1 :]
        inside = left >= k
        kinds = [(1, inside & (at == 0)), (2, inside & (left == k))] + ([(3, inside)] if k > 1 else [])
        for kind, where in kinds:
            owners.append(owner[where])
            found.append(mix(rolled[where] + U((kind << 8 | k) << 48)))
    known = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    size = 1 << BITS
    who = np.concatenate(owners)
    what = (np.concatenate(found) >> U(64 - BITS)).astype(np.int64)
    if known:
        i, entry = np.array(known).T
        who, what = np.concatenate((who, i)), np.concatenate((what, size + entry))
    return who, what


def emissions(words: list[str], lexicon: dict[str, int], weights: np.ndarray) -> np.ndarray:
    who, what = features(words, lexicon)
    return np.stack([np.bincount(who, weights[what, s], len(words)) for s in range(weights.shape[1])], 1)


def marginals(potential: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many sequences at once.

    potential: exp(emission) of all words, one sequence after the other; step: exp(transition). Sequences are cut
    into segments whose transfer matrices are multiplied first, so that a long sequence takes few sequential steps.
    Returns the marginals, and the expected transition counts and log partition summed over all sequences.
    """
    k, total = len(step), int(lengths.sum())
    pieces = -(-lengths // SEGMENT)
    n = int(pieces.sum())
    seq = np.repeat(np.arange(len(lengths)), pieces)
    order = np.arange(n) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = (np.cumsum(lengths) - lengths)[seq] + order * SEGMENT
    size = np.minimum(SEGMENT, lengths[seq] - order * SEGMENT)
    reach = np.arange(SEGMENT)
    real = reach < size[:, None]
    psi = np.where(real[:, :, None], potential[np.minimum(first[:, None] + reach, total - 1)], 1.0)
    eye = np.eye(k)

    transfer = np.broadcast_to(eye, (n, k, k)).copy()
    for t in range(SEGMENT):
        m = real[:, t]
        transfer[m] = (transfer[m] @ step) * psi[m, t][:, None, :]
        transfer[m] /= transfer[m].max(axis=(1, 2), keepdims=True)

    # between segments; the first word has no transition, which a start vector s with s @ step = 1 stands for
    start = np.linalg.solve(step.T, np.ones(k))
    ahead, behind = np.empty((n, k)), np.ones((n, k))
    base = np.cumsum(pieces) - pieces
    ahead[base[lengths > 0]] = start
    for j in range(1, int(pieces.max(initial=0))):
        i = base[pieces > j] + j
        v = np.einsum("ni,nij->nj", ahead[i - 1], transfer[i - 1])
        ahead[i] = v / v.sum(1, keepdims=True)
    last = base + pieces - 1
    for j in range(1, int(pieces.max(initial=0))):
        i = last[pieces > j] - j
        v = np.einsum("nij,nj->ni", transfer[i + 1], behind[i + 1])
        behind[i] = v / v.sum(1, keepdims=True)

    alpha, beta, prior = np.empty((n, SEGMENT, k)), np.empty((n, SEGMENT, k)), np.empty((n, SEGMENT, k))
    v, loglik = ahead, 0.0
    for t in range(SEGMENT):
        prior[:, t] = v
        m = real[:, t]
        nxt = (v @ step) * psi[:, t]
        norm = nxt.sum(1, keepdims=True)
        loglik += float(np.log(norm[m]).sum())
        v = np.where(m[:, None], nxt / norm, v)
        alpha[:, t] = v
    v = behind
    for t in range(SEGMENT - 1, -1, -1):
        beta[:, t] = v
        m = real[:, t]
        nxt = (psi[:, t] * v) @ step.T
        v = np.where(m[:, None], nxt / nxt.sum(1, keepdims=True), v)
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    use = real.copy()
    use[order == 0, 0] = False
    right = (psi * beta)[use]
    pairs = prior[use][:, :, None] * step * right[:, None, :]
    pairs /= pairs.sum(axis=(1, 2), keepdims=True)
    return post[real], pairs.sum(0), np.array(loglik)


class Crf:
    def __init__(self, langs: list[str], lexicon: dict[str, int], weights: np.ndarray, transitions: np.ndarray) -> None:
        self.langs, self.lexicon, self.weights, self.step = langs, lexicon, weights, np.exp(transitions)
        self.index: dict[str, int] = {}
        self.known = np.zeros((0, len(langs)))
        self.held = 0

    def potentials(self, words: list[str]) -> np.ndarray:
        """exp(emission) of each word; distinct words are scored once and remembered, up to CACHE_BYTES."""
        if self.held > CACHE_BYTES:
            self.index, self.known, self.held = {}, self.known[:0], 0
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if new:
            e = emissions(new, self.lexicon, self.weights)
            self.index |= zip(new, range(len(self.index), len(self.index) + len(new)))
            self.held += sum([4 * len(w) for w in new]) + len(new) * (ENTRY + 8 * len(self.langs))
            self.known = np.concatenate((self.known, np.exp(e - e.max(1, keepdims=True))))
        return self.known[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))]

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, share of the words expected in it) of each text; und without any letter."""
        found = [FIND(t.lower()) if t else [] for t in texts]
        lengths = np.array([len(w) for w in found])
        if not lengths.sum():
            return [("und", 0.0)] * len(texts)
        post, _, _ = marginals(self.potentials([w for ws in found for w in ws]), lengths, self.step)
        ends = np.cumsum(lengths)
        sums = np.concatenate((np.zeros((1, post.shape[1])), np.cumsum(post, 0)))
        share = (sums[ends] - sums[ends - lengths]) / np.maximum(1, lengths)[:, None]
        best = share.argmax(1)
        return [(self.langs[b], float(min(1.0, max(0.0, share[i, b])))) if n else ("und", 0.0) for i, (b, n) in enumerate(zip(best.tolist(), lengths.tolist()))]

    def label_words(self, text: str) -> list[tuple[str, str]]:
        """The words of one text, each with its language."""
        words = FIND(text.lower())
        if not words:
            return []
        post, _, _ = marginals(self.potentials(words), np.array([len(words)]), self.step)
        return list(zip(words, (self.langs[i] for i in post.argmax(1))))


def train(samples: list[tuple[str, str]], rounds: int = 30, lexicon_size: int = 3000, decay: float = 1e-4) -> Crf:
    """A field from (text, language) samples.

    Texts are cut into runs of 5 to 60 words, and runs of all languages are shuffled and chained, so that transitions
    are learned from switches; weights by Adagrad on the full gradient of the log likelihood.
    """
    rng = np.random.default_rng(7)
    langs = sorted({lang for _, lang in samples})
    at = {lang: i for i, lang in enumerate(langs)}
    runs, counts = [], Counter()
    for text, lang in samples:
        words = FIND(text.lower())
        counts.update((w, lang) for w in words)
        i = 0
        while i < len(words):
            n = int(rng.integers(5, 61))
            runs.append((words[i : i + n], at[lang]))
            i += n
    order = rng.permutation(len(runs))
    words = [w for i in order for w in runs[i][0]]
    gold = np.repeat([runs[i][1] for i in order], [len(runs[i][0]) for i in order])
    top = [w for (w, _), _ in counts.most_common(2 * lexicon_size)]
    lexicon = {w: i for i, w in enumerate(list(dict.fromkeys(top))[:lexicon_size])}
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))
    who, what = features(list(vocabulary), lexicon)
    k, n, size = len(langs), len(words), (1 << BITS) + len(lexicon)
    weights, step = np.zeros((size, k)), np.zeros((k, k))
    square_w, square_s = np.full((size, k), 1e-6), np.full((k, k), 1e-6)
    lengths = np.full(-(-n // 2000), 2000)
    lengths[-1] = n - lengths[:-1].sum()
    begin = np.zeros(n, bool)
    begin[np.cumsum(lengths) - lengths] = True
    truth = np.zeros((n, k))
    truth[np.arange(n), gold] = 1
    follow = np.flatnonzero(~begin)
    pairs_gold = np.zeros((k, k))
    np.add.at(pairs_gold, (gold[follow - 1], gold[follow]), 1)
    for _ in range(rounds if k > 1 else 0):
        e = np.stack([np.bincount(who, weights[what, s], len(vocabulary)) for s in range(k)], 1)
        e = np.exp(np.clip(e - e.max(1, keepdims=True), -30, 0))
        post, pairs, _ = marginals(e[ids], lengths, np.exp(step) + 1e-3 * np.eye(k))
        short = truth - post
        by_word = np.stack([np.bincount(ids, short[:, s], len(vocabulary)) for s in range(k)], 1)
        g = np.stack([np.bincount(what, by_word[who, s], size) for s in range(k)], 1) / n - decay * weights
        h = (pairs_gold - pairs) / n - decay * step
        square_w += g * g
        square_s += h * h
        weights += 0.3 * g / np.sqrt(square_w)
        step += 0.3 * h / np.sqrt(square_s)
    return Crf(langs, lexicon, weights, np.clip(step, -8, 8) + 1e-3 * np.eye(k))


LONG = 100_000  # bytes of a text beyond which shorter ones are learned from first


def training_sample(docs: DataFrame, per_language: int) -> list[tuple[str, str]]:
    """Whole texts of up to per_language documents of each language, those with the least hashes of doc_id.

    Texts of more than LONG bytes come last. One pass picks the documents: each task keeps the first per_language of a
    language before anything is shuffled. A second reads their texts, by a join with the picks.
    """
    rows = docs.where("doc_id is not null and lang is not null and text is not null")
    first = Window.partitionBy("lang").orderBy("long", "h", "doc_id", "th")
    keyed = rows.select("lang", "doc_id", (F.octet_length("text") > LONG).alias("long"), F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("th"))
    picked = keyed.withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_language).select("lang", "doc_id", "th").distinct()
    texts = rows.withColumn("th", F.xxhash64("text")).join(F.broadcast(picked), ["lang", "doc_id", "th"], "left_semi").select("text", "lang", "doc_id").distinct()
    return [(r.text, r.lang) for r in sorted(texts.collect(), key=lambda r: (r.doc_id, r.text, r.lang))]


def identify_languages(docs: DataFrame, per_language: int = 150) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs(doc_id, text, lang, ...).

    Fitted, on the driver, on a bounded sample: whole texts of at most per_language documents of each language whose
    crc32(doc_id as text) mod 3 is not 1; rows without a doc_id are not learned from. Every document is labelled in
    full. lang_pred is und, with score 0, if the text is null, empty or has no letter, or if no document has a language
    to learn from; score is the expected share of the text's words in lang_pred. Repeated rows are labelled alike.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    samples = training_sample(rows.where(~held), per_language)
    model = spark.sparkContext.broadcast((lambda m: (m.langs, m.lexicon, m.weights.astype(np.float32), np.log(m.step)))(train(samples)) if samples else None)

    def run(batches):
        field = Crf(*model.value) if model.value else None
        for batch in slices(batches, "text", 2 << 20):
            out = field.label(batch.column("text").to_pylist()) if field else [("und", 0.0)] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = rows.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
