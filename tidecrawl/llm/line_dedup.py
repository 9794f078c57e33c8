"""Line deduplication over overlapping three-line windows, in DataFrame functions only.

Every three consecutive lines are hashed. A window that occurs more than once anywhere keeps its first occurrence,
in the order of doc_id and line; the lines that later occurrences cover are removed, overlapping cover merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecrawl.llm.common import stage, unused

WIDTH = 3


def drop_repeated_lines(docs: DataFrame, width: int = WIDTH, names: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with cleaned text, plus n_lines and n_removed, or what names calls them.

    Lines end at a line feed. A window of blank lines only doesn't count. Documents of fewer than width lines have
    no window and stay as they are, as do null (n_lines 0) and empty texts (n_lines 1). Rows that agree in doc_id
    and text are one document: all are cleaned alike. A null doc_id is one like others and comes first in the order.
    A window is identified by 96 bits of hash. Columns of docs itself that have these names are replaced, all others
    are kept as they are.
    """
    keep = [c for c in docs.columns if c not in names]
    kind = F.col("doc_id"), F.xxhash64("text")
    lines = docs.select(kind[0].alias("_id"), kind[1].alias("_text"), F.split("text", "\n").alias("l")).where(F.size("l") >= width)
    marks = F.transform(
        F.sequence(F.lit(1), F.size("l") - (width - 1)),
        lambda i: F.struct(
            (i - 1).alias("at"),
            F.xxhash64(*[F.element_at("l", i + j) for j in range(width)]).alias("h"),
            F.hash(*[F.element_at("l", i + j) for j in range(width)]).alias("g"),
            F.concat(*[F.element_at("l", i + j) for j in range(width)]).rlike(r"\S").alias("some"),
        ),
    )
    windows = stage(lines.select("_id", "_text", F.explode(marks).alias("w")).where("w.some").select("_id", "_text", "w.at", "w.h", "w.g").distinct(), "windows")

    first = windows.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(F.struct("_id", "_text", "at")).alias("first")).where("n > 1")
    later = windows.join(first.select("h", "g", "first"), ["h", "g"]).where("struct(_id, _text, at) > first")
    cover = later.groupBy("_id", "_text").agg(F.sort_array(F.collect_set("at")).alias("_starts"))

    of, th, starts, parts, left = unused(keep, "of", "th", "starts", "parts", "left")
    cover = cover.select(F.col("_id").alias(of), F.col("_text").alias(th), F.col("_starts").alias(starts))
    text = docs.select(*keep).join(cover, kind[0].eqNullSafe(F.col(of)) & (kind[1] == F.col(th)), "left")
    kept = F.expr(f"""flatten(transform(sequence(0, size({starts})), i -> slice({parts},
        if(i = 0, 0, element_at({starts}, greatest(i, 1)) + {width}) + 1,
        greatest(0, if(i = size({starts}), size({parts}), element_at({starts}, least(i + 1, size({starts})))) - if(i = 0, 0, element_at({starts}, greatest(i, 1)) + {width})))))""")
    text = text.withColumn(parts, F.split("text", "\n")).withColumn(left, F.when(F.col(starts).isNotNull(), kept))
    size = F.coalesce(F.when(F.col("text").isNotNull(), F.size(parts)), F.lit(0))
    out = {c: F.col(c) for c in keep} | {"text": F.when(F.col(starts).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))}
    return text.select(*[v.alias(c) for c, v in out.items()], size.cast("long").alias(names[0]), F.when(F.col(starts).isNull(), 0).otherwise(F.size(parts) - F.size(left)).cast("long").alias(names[1]))
