"""Documents, queries and keyword queries as JSON lines, and what is written of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from quillon.functions.text import falsy, titled
from quillon.session import small

FORMS = ("titled", "plain", "strict", "spaced")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed and blank ones are dropped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def parsed(lines: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """lines(line_no, value) with the text of JSON fields; lines that are no JSON object are dropped."""
    kind = ", ".join(f"{n} string" for n in names)
    rows = lines.filter(F.trim("value") != "").withColumn("j", F.from_json("value", f"{kind}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    return rows.filter("j is not null and j._bad is null").select("line_no", *(F.col(f"j.{n}").alias(n) for n in names))


def documents(lines: DataFrame, form: str = "titled") -> DataFrame:
    """(line_no, doc_id, text) of JSON lines; lines without an id are dropped.

    titled: title and text by a newline, where both are there. plain: the text alone. strict: as titled, with the id
    under doc_id or id, and nothing for an empty text. spaced: title and text by a space, trimmed.
    """
    rows = parsed(lines, ("doc_id", "id", "title", "text"))
    key = falsy("doc_id", "id") if form == "strict" else falsy("id")
    title, text = (F.coalesce(F.col(c), F.lit("")) for c in ("title", "text"))
    body = {
        "titled": titled("title", "text"),
        "plain": text,
        "strict": F.regexp_replace(F.concat(title, F.lit("\n"), text), r"^\s+|\s+$", ""),
        "spaced": F.regexp_replace(F.concat(title, F.lit(" "), text), r"^\s+|\s+$", ""),
    }[form]
    found = rows.select("line_no", key.alias("doc_id"), body.alias("text")).filter(F.col("doc_id").isNotNull())
    return found.filter(F.length("text") > 0) if form == "strict" else found


def queries(lines: DataFrame) -> DataFrame:
    """(query_id, query): the first of query_id, qid, id, and of query, text, title, that is not empty; the last line of an id wins."""
    rows = parsed(lines, ("query_id", "qid", "id", "query", "text", "title"))
    rows = rows.select("line_no", falsy("query_id", "qid", "id").alias("query_id"), F.coalesce(falsy("query", "text", "title"), F.lit("")).alias("query")).filter(F.col("query_id").isNotNull())
    return rows.groupBy("query_id").agg(F.max_by("query", "line_no").alias("query"))


IMPROVED = "id long, keywords array<struct<term: string, weight: double, extra: array<string>>>, guesses array<string>"


def improved_queries(spark: SparkSession, path: str) -> DataFrame:
    """(split, item_id, pos, term, weight) of keyword queries; split from the file's name ..._queries-<split>_improved_queries.jsonl."""
    name = F.regexp_extract(F.input_file_name(), r"queries-([^/]+?)_improved_queries", 1)
    return read_jsonl(spark, path, IMPROVED).select(name.alias("split"), F.col("id").alias("item_id"), F.posexplode("keywords").alias("pos", "k")).select("split", "item_id", "pos", "k.term", "k.weight")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def copy_lines(lines: DataFrame, ids: DataFrame, path: str, key: str = "$.id") -> None:
    """Copies the JSON lines whose key is in ids(id), a written table, byte for byte; the lines stay where they are unless ids are very many."""
    lines.withColumn("id", F.get_json_object("value", key)).join(small(ids.select(F.col("id").cast("string")).distinct()), "id", "left_semi").select("value").write.mode("overwrite").text(path)


def stats_json(stats: DataFrame) -> DataFrame:
    """One row `value`: the JSON object of stats(part, n), its few rows in order of their names."""
    return stats.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("part", "n"))))).alias("value"))


def id_list(lines: DataFrame) -> DataFrame:
    """Distinct doc_id of lines with one id each; blank lines are skipped."""
    return lines.select(F.trim("value").alias("doc_id")).filter("doc_id <> ''").distinct()


def missing_log(lines: DataFrame) -> DataFrame:
    """(split, query_id, doc_id) of tab-separated lines; shorter ones are skipped."""
    f = F.split("value", "\t")
    return lines.withColumn("f", f).filter(F.size("f") >= 3).select(*(F.trim(F.col("f")[i]).alias(c) for i, c in enumerate(("split", "query_id", "doc_id")))).distinct()


def prompts(queries: DataFrame, head: str, size: int = 25) -> DataFrame:
    """(part, n, prompt) of queries(ord, item_id, text): `size` queries below a heading, in order."""
    line = F.concat_ws("\t", F.col("item_id").cast("string"), F.col("text"))
    rows = queries.select(F.floor(F.col("ord") / size).alias("part"), F.struct("ord", line.alias("line")).alias("x")).groupBy("part").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("x")).alias("x"))
    return rows.select("part", "n", F.concat(F.lit(head + "\n"), F.array_join(F.transform("x", lambda x: x["line"]), "\n")).alias("prompt"))


def by_last(rows: DataFrame, key: str, order: Column | str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc() if isinstance(order, str) else order.desc()))).filter("_r = 1").drop("_r")


class KeyValue:
    """A keyed table on parquet: put() upserts, get() looks keys up with a default. Writes are new generations, as files are not changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.turn = spark, path, 0

    def rows(self) -> DataFrame:
        if not self.turn:
            return self.spark.createDataFrame([], "key string, value string")
        return self.spark.read.parquet(f"{self.path}/{self.turn}")

    def put(self, rows: DataFrame) -> None:
        """rows(key, value, order): later ones replace earlier ones and what is stored."""
        fresh = by_last(rows, "key", "order").select("key", "value")
        fresh.unionByName(self.rows().join(fresh, "key", "left_anti")).repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{self.path}/{self.turn + 1}")
        self.turn += 1

    def get(self, keys: DataFrame, default: str) -> DataFrame:
        """(key, value) for each row of keys(key)."""
        return keys.join(self.rows(), "key", "left").select("key", F.coalesce("value", F.lit(default)).alias("value"))
