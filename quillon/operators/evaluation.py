"""Ranking measures over qrels(item_id, doc_id, rel) and run(item_id, doc_id, score)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Aliases of measure names.
ALIASES = {"recall": "r", "precision": "p", "mrr": "rr", "recip_rank": "rr", "ap": "map"}
CUT = {"ndcg", "r", "p", "f1", "success"}


def parse_metric(label: str) -> tuple[str, int | None]:
    """A label such as NDCG@10, recall@100, MRR or map to (family, k)."""
    m = re.fullmatch(r"([A-Za-z_0-9]+?)(?:@(\d+))?", label.strip())
    family = ALIASES.get(m[1].lower(), m[1].lower()) if m else None
    k = int(m[2]) if m and m[2] else None
    if family not in CUT | {"rr", "map"} or (family in CUT and not k) or (family == "rr" and k):
        raise ValueError(f"unknown measure {label!r}")
    return family, k


def judged(qrels: DataFrame, run: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Relevant rows of qrels with the rank in the run: by score, ties by doc_id as text, descending.

    keys: further columns of both that tell several evaluations apart.
    """
    by = [*(keys or []), "item_id"]
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").cast("string").desc())
    ranks = run.select(*by, "doc_id", F.row_number().over(order).alias("rank"))
    rows = qrels.filter("rel > 0").join(ranks, [*by, "doc_id"], "left")
    return rows.withColumn("hit", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("rank").asc_nulls_last(), "doc_id"))).withColumn(
        "ideal", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("rel").desc(), "doc_id"))
    )


def measure(family: str, k: int | None) -> Column:
    """An aggregate over the rows of one query."""
    inside = F.col("rank").isNotNull() if k is None else F.col("rank") <= k
    hits, n = F.sum(F.when(inside, 1.0).otherwise(0.0)), F.count("*")
    gain = lambda rel, at: rel / F.log2(at + 1.0)
    if family == "ndcg":
        return F.coalesce(F.sum(F.when(inside, gain(F.col("rel"), F.col("rank")))), F.lit(0.0)) / F.sum(F.when(F.col("ideal") <= k, gain(F.col("rel"), F.col("ideal"))))
    if family == "r":
        return hits / n
    if family == "p":
        return hits / k
    if family == "f1":
        return F.when(hits > 0, 2 * (hits / k) * (hits / n) / (hits / k + hits / n)).otherwise(0.0)
    if family == "success":
        return (hits > 0).cast("double")
    if family == "rr":
        return F.coalesce(1.0 / F.min("rank"), F.lit(0.0))
    return F.coalesce(F.sum(F.when(inside, F.col("hit") / F.col("rank"))), F.lit(0.0)) / n


def per_query(qrels: DataFrame, run: DataFrame, labels: list[str], keys: list[str] | None = None) -> DataFrame:
    """One row a query of qrels, all measures from one pass; a query missing from the run scores 0."""
    return judged(qrels, run, keys).groupBy(*(keys or []), "item_id").agg(*(measure(*parse_metric(x)).alias(x) for x in labels))


def evaluate(qrels: DataFrame, run: DataFrame, labels: list[str], digits: int = 6, keys: list[str] | None = None) -> DataFrame:
    """(metric, value), for each value of keys: means over all queries of qrels."""
    means = per_query(qrels, run, labels, keys).groupBy(*(keys or [])).agg(*(F.round(F.avg(F.col(f"`{x}`")), digits).alias(x) for x in labels))
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("metric"), F.col(f"`{x}`").alias("value")) for x in labels))).alias("m")
    return means.select(*(keys or []), each).select(*(keys or []), "m.metric", "m.value")


def sweep(qrels: DataFrame, runs: DataFrame, subsets: DataFrame, labels: list[str]) -> DataFrame:
    """(model, split, subset, metric, value) of all runs(model, ...) on each split of qrels(split, ...) within each subset(subset, doc_id), in one pass."""
    asked = qrels.join(subsets, "doc_id").crossJoin(F.broadcast(runs.select("model").distinct()))  # one row a model
    asked = asked.select("model", "split", "subset", "item_id", "doc_id", "rel")
    kinds = asked.select("model", "split", "subset", "item_id").distinct()
    ran = runs.select("model", "item_id", "doc_id", "score").join(kinds, ["model", "item_id"])
    return evaluate(asked, ran, labels, keys=["model", "split", "subset"])


def report_lines(values: DataFrame, labels: list[str], digits: int = 3) -> DataFrame:
    """(place, line) of (metric, value): one line a measure, in the order in which they were asked for."""
    place = F.array_position(F.array(*(F.lit(x) for x in labels)), F.col("metric")).cast("long") - 1
    return values.select(place.alias("place"), F.concat_ws("\t", "metric", F.format_string(f"%.{digits}f", "value")).alias("line"))


def missing(qrels: DataFrame, run: DataFrame) -> DataFrame:
    """Queries of qrels without a row in the run."""
    return qrels.select("item_id").distinct().join(run.select("item_id").distinct(), "item_id", "left_anti")
