"""Sliding passages and encoder windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from quillon.functions.text import words


def windows(docs: DataFrame, size: int, stride: int, text: str = "text") -> DataFrame:
    """(doc_id, chunk_index, n_words, chunk): `size` words every `stride` (at most size), the last one reaching the end.

    A document without words has no chunk.
    """
    step = min(stride, size)
    w = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda x: x != "")
    rows = docs.select("doc_id", w.alias("w")).filter(F.size("w") > 0)
    more = F.greatest(F.lit(0), F.ceil((F.size("w") - size) / step)).cast("int")
    # passages are cut out before rows multiply, so that no row carries the words of the whole document
    cut = F.transform(F.sequence(F.lit(0), more), lambda i: F.slice(F.col("w"), i * step + 1, size))
    part = rows.select("doc_id", F.posexplode(cut).alias("i", "part"))
    return part.select("doc_id", F.col("i").cast("long").alias("chunk_index"), F.size("part").cast("long").alias("n_words"), F.array_join("part", " ").alias("chunk"))


def truncated(docs: DataFrame, most: int = 256) -> DataFrame:
    """docs with the column `words`, the first `most` lower-cased words of text."""
    return docs.withColumn("words", F.slice(words("text"), 1, most))


def overflow(docs: DataFrame, length: int = 512, overlap: int = 64) -> DataFrame:
    """Encoder windows of `length` words that share `overlap` words with the one before."""
    return windows(docs, length, length - overlap)
