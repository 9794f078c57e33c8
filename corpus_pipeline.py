"""A corpus pipeline in five stages; each reads what the stage before it wrote.

Only the first stage can lose a document for its quality; line dedup loses those of which nothing is left; the join
keeps one document of each group; decontamination loses those that share a window with the benchmark; the last stage
encodes what remains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecrawl.llm import bpe, decontam, jaccard, line_dedup, quality
from tidecrawl.llm.common import stage, table, unused


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text scores 0.7 or more. Null and empty texts are scored like others; each row is judged by its
    own text, whatever its doc_id; an empty table stays empty, and without labels every text scores 0.5 and goes."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without repeated three-line windows; documents of which nothing but blanks is left go. Null and empty
    texts, and those of fewer than three lines, stay as they are. n_chars, if there is one, is brought up to date."""
    lines, gone = unused(docs.columns, "n_lines", "n_removed")
    clean = line_dedup.drop_repeated_lines(docs, names=(lines, gone))
    clean = clean.where(~((F.col(gone) > 0) & (F.trim("text") == "")))  # every line is in other documents
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def similar_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id. Texts without words all stay; rows that
    agree in doc_id and text are one document."""
    return jaccard.drop_similar(docs, k=5, num=8, den=10)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that share no window of ten words, and no shorter item, with the benchmark. Null texts share none."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), width=10)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens and digests of each row; null and empty texts have no ids."""
    import public_tokenizers

    coded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", similar_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-level BPE", encode_stage),
]

#: SQL can't express the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
