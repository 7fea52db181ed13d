"""Temperature mixing of sources, realised as budgeted block permutations.

A source with share p of all tokens gets a weight proportional to p**x. Entropy falls and repetition of the
smallest source falls as x grows from 0 to 1, so both limits are met by bisecting x: the largest x whose
entropy reaches the target, or, where that would repeat a source more than allowed, the smallest x that
does not. A source's tokens in the mixture are whole passes over it and the beginning of one more pass, in
the order of a hash permutation. The permutation is cut into about sqrt(documents) consecutive blocks, so
that running totals are taken over blocks first and inside a block next, never over a source in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from quillon.llm.blocks import partitions, salted_join
from quillon.session import saved

ENTROPY, REPEATS, STEPS, GRID, SEED = 0.95, 4.0, 40, 6, "mix-1"


def powers(shares: DataFrame, points: list[float]) -> list[tuple[float, float]]:
    """For each x of points the sums of p**x and of p**x * ln p over shares(p): one distributed aggregation."""
    grid = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(x).alias("x")) for i, x in enumerate(points)))).alias("g")
    raised = F.pow("p", F.col("g.x"))
    rows = shares.select("p", grid).groupBy("g.i").agg(F.sum(raised).alias("z"), F.sum(raised * F.log("p")).alias("s")).collect()
    found = {r["i"]: (r["z"], r["s"]) for r in rows}
    return [found[i] for i in range(len(points))]


def bisected(hits: Callable[[list[float]], list[bool]]) -> tuple[float, float]:
    """The last [lo, hi] of x after STEPS halvings of [0, 1], where lo moves up if hits holds at the middle.

    GRID halvings are settled by one call, for all points that they could ask for.
    """
    lo, hi, left = 0.0, 1.0, STEPS
    while left:
        n = 1 << min(GRID, left)
        width = (hi - lo) / n
        found = [True, *hits([lo + width * j for j in range(1, n)])]
        a, b = 0, n
        while b - a > 1:
            middle = (a + b) // 2
            a, b = (middle, b) if found[middle] else (a, middle)
        lo, hi, left = lo + width * a, lo + width * b, left - min(GRID, left)
    return lo, hi


def exponent(sources: DataFrame, target: float, repeats: float) -> tuple[float, float, int]:
    """(x, z, total): exponent, normaliser and tokens of the stored table sources(source, tokens, ...).

    Sources stay where they are, however many there are; the driver gets the sums at 2**GRID - 1 points at a time.
    """
    live = sources.filter("tokens > 0")
    total, k, least = live.agg(F.sum("tokens"), F.count("*"), F.min("tokens")).first()
    if not k:
        return 0.0, 1.0, 0
    shares, low = live.select((F.col("tokens") / F.lit(float(total))).alias("p")), least / total
    by_entropy = bisected(lambda xs: [math.log(z) - x * s / z >= target * math.log(k) for x, (z, s) in zip(xs, powers(shares, xs))])[0]
    by_repeats = 0.0 if 1 / low / k <= repeats else bisected(lambda xs: [low ** (x - 1) / z > repeats for x, (z, _) in zip(xs, powers(shares, xs))])[1]
    x = max(by_entropy, by_repeats)
    return x, powers(shares, [x])[0][0], total


def mixture(docs: DataFrame, target: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, seed: str = SEED) -> DataFrame:
    """How often each document of docs(doc_id, text, source, ...) is drawn: doc_id, source, n_tokens, weight, block, ahead, copies.

    Tokens are words; target is the entropy of the source weights over its most, ln of the number of sources;
    repeats the most passes over a source (it wins over the target); budget the tokens of the mixture, by
    default those of docs. ahead counts the tokens before the document in its source's permutation, and
    copies the passes that contain it: a document lies in the last, partial pass if it ends inside it.
    A null source is the source ''. Sources without a token have weight 0 and no copies; null text has no
    tokens. Repeated rows are documents of their own, next to each other in the permutation, so the last pass may end
    between them. Other columns are ignored. Empty input gives none.
    """
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^ \t-\r]+")).cast("long")
    place = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")
    rows = saved(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), words.alias("n_tokens"), place.alias("place")), "mixing")
    sources = saved(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")), "sources")
    x, z, total = exponent(sources, target, repeats)
    plan = (
        sources.withColumn("weight", F.when(F.col("tokens") > 0, F.round(F.pow(F.col("tokens") / F.lit(float(total)), F.lit(x)) / F.lit(z), 9)).otherwise(0.0))
        .withColumn("quota", F.floor(F.col("weight") * F.lit(total if budget is None else budget)))
        .withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(0))
        .select("source", "weight", F.ceil(F.sqrt("n")).alias("blocks"), "whole", (F.col("quota") - F.col("whole") * F.col("tokens")).alias("rest"), (F.col("tokens") > 0).alias("live"))
    )
    dealt = salted_join(rows, plan, ["source"], "place").withColumn("block", F.expr("shiftright(place * blocks, 32)"))
    dealt = dealt.repartition(partitions(docs.sparkSession), "source", "block")
    blocks = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("t"))
    before = blocks.withColumn("before", F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    drawn = dealt.withColumn("inside", inside).join(before, ["source", "block"])
    ahead = F.col("before") + F.col("inside") - F.col("n_tokens")
    part = (F.col("live") & (F.col("rest") > 0) & (ahead + F.col("n_tokens") <= F.col("rest"))).cast("long")
    return drawn.select("doc_id", "source", "n_tokens", "weight", "block", ahead.alias("ahead"), (F.col("whole") + part).alias("copies"))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """The mixture of all documents by source: doc_id, source, n_tokens, weight, block, ahead, copies. Edge cases as in mixture."""
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# One statement over `docs` rows (doc_id, text, source); doc_id must be unique.
MIXING_SQL = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
         ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS place
  FROM @docs),
sources_ AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS n FROM rows_ GROUP BY source),
one_ AS (SELECT sum(tokens)::BIGINT AS total, count(*) AS k, min(tokens) AS least FROM sources_ WHERE tokens > 0),
shares_ AS (SELECT tokens / total::DOUBLE AS p, k, least / total::DOUBLE AS q FROM sources_, one_ WHERE tokens > 0),
h_ AS (
  SELECT 0 AS i, 0::DOUBLE AS lo, 1::DOUBLE AS hi
  UNION ALL
  SELECT i + 1,
         CASE WHEN ln(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2)) >= {ENTROPY} * ln(any_value(k)) THEN (lo + hi) / 2 ELSE lo END,
         CASE WHEN ln(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2)) >= {ENTROPY} * ln(any_value(k)) THEN hi ELSE (lo + hi) / 2 END
  FROM h_, shares_ WHERE i < {STEPS} GROUP BY i, lo, hi),
r_ AS (
  SELECT 0 AS i, 0::DOUBLE AS lo, 1::DOUBLE AS hi
  UNION ALL
  SELECT i + 1,
         CASE WHEN pow(any_value(q), (lo + hi) / 2 - 1) / sum(pow(p, (lo + hi) / 2)) > {REPEATS} THEN (lo + hi) / 2 ELSE lo END,
         CASE WHEN pow(any_value(q), (lo + hi) / 2 - 1) / sum(pow(p, (lo + hi) / 2)) > {REPEATS} THEN hi ELSE (lo + hi) / 2 END
  FROM r_, shares_ WHERE i < {STEPS} GROUP BY i, lo, hi),
x_ AS (SELECT greatest((SELECT lo FROM h_ WHERE i = {STEPS}), (SELECT CASE WHEN total / least::DOUBLE / k <= {REPEATS} THEN 0 ELSE (SELECT hi FROM r_ WHERE i = {STEPS}) END FROM one_)) AS x),
z_ AS (SELECT x, sum(pow(p, x)) AS z FROM shares_, x_ GROUP BY x),
weights_ AS (
  SELECT source, tokens, ceil(sqrt(n))::BIGINT AS blocks, total,
         CASE WHEN tokens > 0 THEN round(pow(tokens / total::DOUBLE, x) / z, 9) ELSE 0 END AS weight
  FROM sources_ LEFT JOIN z_ ON true LEFT JOIN one_ ON true),
quotas_ AS (SELECT *, floor(weight * total)::BIGINT AS quota FROM weights_),
plan_ AS (SELECT *, CASE WHEN tokens > 0 THEN quota // tokens ELSE 0 END AS whole FROM quotas_),
dealt_ AS (SELECT r.*, p.weight, p.whole, p.tokens, p.quota - p.whole * p.tokens AS rest, (r.place * p.blocks) >> 32 AS block FROM rows_ r JOIN plan_ p USING (source)),
drawn_ AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT - n_tokens AS ahead FROM dealt_)
SELECT doc_id, source, n_tokens, weight, block, ahead, whole + (CASE WHEN tokens > 0 AND rest > 0 AND ahead + n_tokens <= rest THEN 1 ELSE 0 END) AS copies
FROM drawn_
"""
