"""The whole pipeline against a brute-force version on the smallest tables."""

import hashlib
import zlib

import numpy as np
import pytest

from tests.llm.test_operators import brute, clean_lines, hits
from tidecrawl.llm import bpe, quality

SF = "/root/testdata/sf0.001"


def good_documents(docs, labels):
    """The discriminant from its textbook formula, with explicit inverses."""
    stats = {i: np.array(quality.statistics(t)) for i, t in docs}
    train = [(stats[i], q) for i, q in labels if i in stats and q in (0, 1) and zlib.crc32(str(i).encode()) % 4 != 2]
    x, y = np.array([s for s, _ in train]), np.array([q for _, q in train])
    centre, scale = x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-6))
    d, parts = x.shape[1], []
    for c in (0, 1):
        z = (x[y == c] - centre) / scale
        share = min(1.0, 0.1 + d / len(z) * 0.5)
        cov = np.cov(z.T, bias=True)
        cov = (1 - share) * cov + share * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        parts.append((len(z) / len(x), z.mean(0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]))

    def score(s):
        z = (s - centre) / scale
        density = [np.log(p) - 0.5 * ((z - m) @ inv @ (z - m) + logdet) for p, m, inv, logdet in parts]
        return 1 / (1 + np.exp(-np.clip(0.5 * (density[1] - density[0]), -30, 30)))

    return [(i, t) for i, t in docs if score(stats[i]) >= 0.7]


def test_pipeline(spark):
    import corpus_pipeline

    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    read = lambda name: [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]
    docs = good_documents([(r[0], r[1]) for r in read("documents")], [(r[0], r[1]) for r in read("labels")])
    docs = [(i, t) for i, t, _, gone in clean_lines(docs) if not (gone and not t.strip(" "))]
    docs = [(i, t) for (i, t), (_, _, c) in zip(sorted(docs), brute(docs, 5, 8, 10)) if c == i]
    docs = [(i, t) for (i, t), h in zip(docs, hits(docs, read("benchmark"), 10)) if not h[-1]]
    ranks = {t: k for k, t in enumerate(bpe.read_ranks(public.path("byte_bpe_50k.tiktoken")))}
    plain = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: hashlib.sha256(np.array(plain.encode_ordinary(t), "<u4").tobytes()).hexdigest() for i, t in docs}
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and len(got) > 50


def test_stages(spark):
    """Every filtering stage on nulls, empty and long texts, repeated ids with unlike texts, repeated rows and columns
    that are called like the operators' own."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kind = docs.schema
    odd = [(None, None), (None, ""), (7, "short"), (7, "another text under the same number"), (7, "short"), (10**6, "word " * 30_000), (10**6 + 1, "é" * 100_000)]
    rows = [tuple({"doc_id": i, "text": t}.get(f.name, 0 if "long" in f.dataType.simpleString() or "int" in f.dataType.simpleString() else "x") for f in kind) for i, t in odd]
    own = {"n_lines": "mine", "n_removed": "mine", "n_hit": "mine", "score": "mine", "th": "mine", "first": "mine"}
    whole = docs.union(spark.createDataFrame(rows, kind)).withColumns({k: F.lit(v) for k, v in own.items()})
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, whole, SF)
        assert out.columns == whole.columns and out.dtypes == whole.dtypes, name
        left = out.collect()
        assert left and all(r[k] == v for r in left for k, v in own.items()), name
        assert step(spark, whole.limit(0), SF).count() == 0, name
        if name != "quality classifier":  # the others leave these alone
            assert sum(r.text is None for r in left) >= 1 and {"short", "another text under the same number"} <= {r.text for r in left}, name
