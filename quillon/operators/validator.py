"""Building corpus subsets as files, and checking such files against what they were built from."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from quillon.operators import subsets
from quillon.session import saved
from quillon.sources import jsonl, lines, trec

SIDES = ("train80", "eval20")
SAMPLE = 20


@dataclass
class Source:
    """lines(line_no, value) of the corpus as JSON; queries(split, query_id, query) and gold(split, query_id, doc_id), ids as text;
    runs(model, item_id, doc_id, rnk) may be absent."""

    lines: DataFrame
    queries: DataFrame
    gold: DataFrame
    runs: DataFrame | None = None
    key: str = "$.id"


@dataclass
class Plan:
    """Documents on each side, neighbours of a gold document, documents that each model adds for a query, and the seed of the split."""

    sizes: dict[str, int] = field(default_factory=lambda: {"train80": 100_000, "eval20": 250_000})
    near: tuple[int, int] = (2, 2)
    quota: int = 5
    seed: str = "seed-1"


def paths(out: str, side: str) -> dict[str, str]:
    return {k: f"{out}/{side}/{k}" for k in ("corpus", "ids", "qrels", "qrels_by_split", "queries", "queries_by_split")}


def build(spark: SparkSession, out: str, source: Source, plan: Plan) -> None:
    """Writes corpus, id list, qrels, queries (together and by split) for both sides, the log of missing gold, and counts as JSON."""
    order = saved(lines.corpus_order(source.lines, source.key), "order")
    sides = saved(subsets.split_80_20(source.queries.select("split", "query_id"), plan.seed), "sides")
    gold = saved(source.gold.join(sides, ["split", "query_id"]), "gold")
    missing = gold.join(order, "doc_id", "left_anti")
    trec.write_lines(missing.select("query_id", F.concat_ws("\t", "split", "query_id", "doc_id").alias("line")), f"{out}/missing")
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    stats = n(missing, "missing")
    for side in SIDES:
        to, mine = paths(out, side), gold.filter(F.col("side") == side)
        held = mine.join(order, "doc_id", "left_semi").select("doc_id").distinct()
        have = held.union(subsets.neighbours(order, held, *plan.near)).distinct()
        if source.runs is not None and plan.quota:
            asked = sides.filter(F.col("side") == side).select(F.col("query_id").alias("item_id"))
            ran = source.runs.join(order.select("doc_id"), "doc_id", "left_semi").join(asked, "item_id", "left_semi")
            have = have.union(subsets.pool_quota(ran, have, plan.quota).select("doc_id")).distinct()
        chosen = saved(subsets.filled(order, have, held, plan.sizes[side]), "chosen")
        jsonl.copy_lines(source.lines, chosen.select(F.col("doc_id").alias("id")), to["corpus"], source.key)
        trec.write_lines(chosen.select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("line")), to["ids"])
        left = saved(mine.join(chosen, "doc_id", "left_semi").withColumn("rel", F.lit(1)), "left")
        asked = source.queries.join(left.select("split", "query_id").distinct(), ["split", "query_id"])
        rows = asked.withColumn("line", F.to_json(F.struct("query_id", "query")))
        for kind, out_rows in (("qrels", trec.qrel_lines(left)), ("queries", rows)):
            trec.write_lines(out_rows, to[kind])
            trec.write_lines(out_rows, to[f"{kind}_by_split"], "split")
        stats = stats.union(n(chosen, f"{side}_docs")).union(n(held, f"{side}_gold")).union(n(asked, f"{side}_queries"))
    jsonl.stats_json(stats).write.mode("overwrite").text(f"{out}/stats")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def validate(spark: SparkSession, out: str, source: Source, plan: Plan) -> DataFrame:
    """(check, side, ok, detail, sample) of the files below `out`: detail counts offending rows, sample has up to 20 of them in order.

    Fails with FileNotFoundError, naming them, if files are missing.
    """
    gone = [p for side in SIDES for p in paths(out, side).values() if not exists(spark, p)]
    if gone or not exists(spark, f"{out}/missing"):
        raise FileNotFoundError("FATAL: missing inputs: " + ", ".join(gone or [f"{out}/missing"]))
    text = lambda path: spark.read.text(path)
    rows: list[tuple[str, str, DataFrame]] = []
    missing = jsonl.missing_log(text(f"{out}/missing")).select("split", "query_id")
    hashed = lambda df: df.select(F.get_json_object("value", source.key).alias("doc_id"), F.sha2("value", 256).alias("hash"))
    original = hashed(source.lines)
    qrels, queries, by_split = {}, {}, {}
    for side in SIDES:
        at = paths(out, side)
        qrels[side] = trec.parse_gold(text(at["qrels"]).withColumn("line_no", F.lit(0)))
        queries[side] = text(at["queries"]).select(F.get_json_object("value", "$.query_id").alias("query_id"))
        by_split[side] = trec.read_lines_by(spark, at["qrels_by_split"], "split").select("split", F.split("value", " ")[0].alias("query_id"))
    both = by_split["train80"].union(by_split["eval20"])
    expected = source.gold.select("split", "query_id").join(missing, ["split", "query_id"], "left_anti")
    differ = lambda a, b: a.distinct().exceptAll(b.distinct()).union(b.distinct().exceptAll(a.distinct()))
    rows.append(("coverage", "both", differ(both, expected).select("query_id")))
    rows.append(("overlap", "qrels", qrels["train80"].join(qrels["eval20"], "query_id", "left_semi").select("query_id")))
    rows.append(("overlap", "queries", queries["train80"].join(queries["eval20"], "query_id", "left_semi").select("query_id")))
    for side in SIDES:
        at = paths(out, side)
        corpus = hashed(text(at["corpus"]))
        listed = text(at["ids"]).select(F.trim("value").alias("doc_id")).filter("doc_id <> ''")
        q = qrels[side]
        was = source.gold.select("query_id", F.col("doc_id").alias("was"))
        rows.append(("docids", side, q.join(was, "query_id", "left").filter("was is null or was <> doc_id").select("query_id")))
        rows.append(("gold_in_ids", side, q.join(listed, "doc_id", "left_anti").select("doc_id").distinct()))
        rows.append(("gold_in_corpus", side, q.join(corpus, "doc_id", "left_anti").select("doc_id").distinct()))
        rows.append(("qids", side, differ(queries[side], q.select("query_id"))))
        rows.append(("count", side, corpus.agg(F.count("*").alias("n")).filter(F.col("n") != plan.sizes[side]).select(F.col("n").cast("string"))))
        rows.append(("duplicates", side, corpus.groupBy("doc_id").count().filter("count > 1").select("doc_id").union(listed.groupBy("doc_id").count().filter("count > 1").select("doc_id"))))
        rows.append(("ids_are_corpus", side, differ(listed, corpus.select("doc_id"))))
        rows.append(("lines", side, corpus.join(original.select("doc_id", F.col("hash").alias("was")), "doc_id", "left").filter("was is null or was <> hash").select("doc_id").distinct()))
    found = None
    for check, side, bad in rows:
        part = bad.toDF("id").select(F.lit(check).alias("check"), F.lit(side).alias("side"), "id")
        found = part if found is None else found.union(part)
    names = spark.createDataFrame([(c, s) for c, s, _ in rows], "check string, side string")
    first = sampled(found, ["check", "side"], "id", SAMPLE)
    every = names.join(F.broadcast(first), ["check", "side"], "left")  # one row a check
    return every.select("check", "side", F.col("detail").isNull().alias("ok"), F.coalesce("detail", F.lit(0)).alias("detail"), F.coalesce("sample", F.array().cast("array<string>")).alias("sample"))


def sampled(rows: DataFrame, keys: list[str], column: str, most: int = SAMPLE) -> DataFrame:
    """For each key the number of rows (detail) and the first `most` distinct values in order (sample), never all of them together."""
    total = rows.groupBy(*keys).agg(F.count("*").alias("detail"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(column))
    first = rows.select(*keys, column).distinct().withColumn("_r", place).filter(F.col("_r") <= most)
    return total.join(first.groupBy(*keys).agg(F.sort_array(F.collect_list(column)).alias("sample")), keys)


def status(report: DataFrame) -> int:
    """What a command returns: 0 if all checks passed, else 1."""
    return int(not report.filter(~F.col("ok")).isEmpty())
