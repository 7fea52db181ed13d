"""Lines of text files in their order, point lookups by line, and a dense order of any rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from quillon.session import partitions, saved

LOW = (1 << 33) - 1


def numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line_no, value) of text files, plain or compressed by their extension.

    line_no orders all lines: by file, then the split's offset in it, then the row in the split. It is not dense.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(place.alias("line_no"), "value")


def ordinals(rows: DataFrame, *by: str, name: str = "ord") -> DataFrame:
    """rows with their dense place from 0 in the order of columns `by`.

    Rows are range-partitioned and sorted; only the sizes of partitions, one row each, meet in one task.
    """
    n = partitions(rows.sparkSession)
    placed = saved(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ordinals")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    both = placed.withColumn("_part", part).join(F.broadcast(before.select("_part", "_before")), "_part")  # one row a partition
    return both.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit(LOW))).drop("_at", "_part", "_before")


def corpus_order(lines: DataFrame, key: str = "$.id") -> DataFrame:
    """(ord, doc_id) of JSON lines (line_no, value); lines that are no JSON or have no id take no place."""
    ids = lines.select("line_no", F.get_json_object("value", key).alias("doc_id")).filter(F.coalesce(F.trim("doc_id"), F.lit("")) != "")
    return ordinals(ids, "line_no").select("ord", "doc_id")


def lines_at(ordered: DataFrame, places: list[int]) -> DataFrame:
    """The rows of a table with `ord` (sorted by it, so that row groups are skipped) at the given places."""
    return ordered.filter(F.col("ord").isin([int(p) for p in places]))
