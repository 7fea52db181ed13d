"""TREC run and qrel lines, both ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fields(line: str = "value") -> Column:
    return F.split(F.trim(F.regexp_replace(F.col(line), r"\s+", " ")), " ")


def qrel_fields(lines: DataFrame, least: int, comments: bool) -> DataFrame:
    rows = lines.withColumn("f", fields()).filter(F.size("f") >= least)
    return rows.filter(~F.trim("value").startswith("#")) if comments else rows


def parse_qrels(lines: DataFrame, bad_rel: int | None = 1, comments: bool = True, least: int = 4) -> DataFrame:
    """(query_id, doc_id, rel), the last line of a pair winning. Short lines and comments are skipped; a relevance that
    is no integer becomes `bad_rel`, or fails if that is None."""
    f = F.col("f")
    rel = F.try_element_at(f, F.lit(4)).try_cast("int")
    rel = F.coalesce(rel, F.lit(bad_rel)) if bad_rel is not None else F.coalesce(rel, F.raise_error(F.lit("relevance is no integer")).cast("int"))
    rows = qrel_fields(lines, least, comments).select(f[0].alias("query_id"), f[2].alias("doc_id"), rel.alias("rel"), "line_no")
    last = Window.partitionBy("query_id", "doc_id").orderBy(F.col("line_no").desc())
    return rows.withColumn("r", F.row_number().over(last)).filter("r = 1").select("query_id", "doc_id", "rel")


def parse_gold(lines: DataFrame) -> DataFrame:
    """(query_id, doc_id): one document a query, its last line winning; lines of three or more fields, no comments."""
    f = F.col("f")
    rows = qrel_fields(lines, 3, True).select(f[0].alias("query_id"), f[2].alias("doc_id"), "line_no")
    return rows.groupBy("query_id").agg(F.max_by("doc_id", "line_no").alias("doc_id"))


def parse_relevant(lines: DataFrame) -> DataFrame:
    """Distinct (query_id, doc_id) of lines with exactly four fields."""
    f = F.col("f")
    return lines.withColumn("f", fields()).filter(F.size("f") == 4).select(f[0].alias("query_id"), f[2].alias("doc_id")).distinct()


def parse_run(lines: DataFrame, strict: bool = False) -> DataFrame:
    """(query_id, doc_id, rank, score, run_id) of six-column lines or five-column ones without Q0. A bad rank becomes
    10**9, a bad score 0; the best rank of a pair wins. strict: six columns only, the last line of a pair wins."""
    f, six = F.col("f"), F.size("f") == 6
    rows = lines.withColumn("f", fields()).filter(six if strict else six | (F.size("f") == 5))
    at = lambda i: F.when(six, f[i]).otherwise(F.try_element_at(f, F.lit(i)))
    rows = rows.select(
        f[0].alias("query_id"), at(2).alias("doc_id"), F.coalesce(at(3).try_cast("int"), F.lit(10**9)).alias("rank"),
        F.coalesce(at(4).try_cast("double"), F.lit(0.0)).alias("score"), at(5).alias("run_id"), "line_no",
    )
    order = [F.col("line_no").desc()] if strict else ["rank", "line_no"]
    best = Window.partitionBy("query_id", "doc_id").orderBy(*order)
    return rows.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r", "line_no")


def grouped_run(lines: DataFrame) -> DataFrame:
    """(query_id, doc_ids): the documents of each query in the order of the file, of lines with six columns or more."""
    f = F.col("f")
    rows = lines.withColumn("f", fields()).filter(F.size("f") >= 6).select(f[0].alias("query_id"), F.struct("line_no", f[2].alias("doc_id")).alias("x"))
    return rows.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["doc_id"]).alias("doc_ids"))


def run_lines(run: DataFrame, tag: str, digits: int | None = 6) -> DataFrame:
    """(item_id, rnk, line) of run(item_id, doc_id, rnk, score); without digits the score is written in full."""
    score = F.col("score").cast("string") if digits is None else F.format_string(f"%.{digits}f", "score")
    return run.select("item_id", "rnk", F.concat_ws(" ", F.col("item_id").cast("string"), F.lit("Q0"), F.col("doc_id").cast("string"), F.col("rnk").cast("string"), score, F.lit(tag)).alias("line"))


def write_run(run: DataFrame, path: str, tag: str, gzip: bool = False, digits: int | None = 6) -> None:
    lines = run_lines(run, tag, digits).repartitionByRange("item_id").sortWithinPartitions("item_id", "rnk")
    lines.select("line").write.option("compression", "gzip" if gzip else "none").text(path)


def natural(column: str) -> list[Column]:
    """Order of ids of one kind as numbers without parsing them: by length, then text."""
    text = F.col(column).cast("string")
    return [F.length(text), text]


def qrel_lines(qrels: DataFrame) -> DataFrame:
    """qrels(query_id, doc_id, rel, ...) with its `line`."""
    return qrels.withColumn("line", F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("0"), F.col("doc_id").cast("string"), F.col("rel").cast("string")))


def write_lines(rows: DataFrame, path: str, by: str | None = None, gzip: bool = False) -> None:
    """`line` of rows(query_id, line, ...) in natural order; with `by`, a folder for each of its values."""
    keys = [F.col(by)] if by else []
    ordered = rows.repartitionByRange(*keys, *natural("query_id")).sortWithinPartitions(*keys, *natural("query_id"), "line")
    out = ordered.select(*([by] if by else []), F.col("line").alias("value")).write.mode("overwrite").option("compression", "gzip" if gzip else "none")
    (out.partitionBy(by) if by else out).text(path)


def read_lines_by(spark: SparkSession, path: str, by: str) -> DataFrame:
    """(by, value) of write_lines(..., by); without any line there is no folder to name a value of `by`."""
    rows = spark.read.text(path)
    return rows.select(F.col(by).cast("string") if by in rows.columns else F.lit(None).cast("string").alias(by), "value")
