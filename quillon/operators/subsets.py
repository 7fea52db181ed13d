"""Reproducible corpus subsets: query split, gold documents, neighbours, pooled runs, filling and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from quillon.session import discard, saved
from quillon.sources.lines import ordinals


def parse_neighbours(spec: str) -> tuple[int, int]:
    """"2" or "1-3" to (low, high)."""
    low, _, high = spec.partition("-")
    lo, hi = int(low), int(high or low)
    if not 0 <= lo <= hi:
        raise ValueError(f"bad neighbours {spec!r}")
    return lo, hi


def split_80_20(queries: DataFrame, seed: str = "seed-1", share: float = 0.8) -> DataFrame:
    """(split, query_id, side): the first floor(share * n + 1e-9) of each split in hash order are train80."""
    key = F.sha2(F.concat_ws("#", F.lit(seed), "split", F.col("query_id").cast("string")), 256)
    by = Window.partitionBy("split")
    rows = queries.withColumn("r", F.row_number().over(by.orderBy(key, "query_id"))).withColumn("n", F.count("*").over(by))
    side = F.when(F.col("r") <= F.floor(share * F.col("n") + 1e-9), "train80").otherwise("eval20")
    return rows.select("split", "query_id", side.alias("side"))


def neighbours(order: DataFrame, gold: DataFrame, lo: int, hi: int, seed: str = "near-1") -> DataFrame:
    """Documents within k places of a gold one in order(ord, doc_id), k from [lo, hi] by a hash of the gold document.

    Places are those of the corpus, whatever the ids are; an equi-join on places. Gold ones near another are included.
    """
    k = lo + F.pmod(F.crc32(F.concat_ws("#", F.lit(seed), F.col("doc_id").cast("string")).cast("binary")), F.lit(hi - lo + 1)).cast("int")
    around = order.join(gold.select("doc_id").distinct(), "doc_id", "left_semi").select("ord", F.explode(F.sequence(-k, k)).alias("d")).filter("d <> 0")
    return order.join(around.select((F.col("ord") + F.col("d")).alias("ord")).distinct(), "ord", "left_semi").select("doc_id")


def pool_quota(runs: DataFrame, have: DataFrame, quota: int) -> DataFrame:
    """runs(model, item_id, doc_id, rnk), have(doc_id): in the order of items, then models, each adds up to `quota`
    documents not taken so far, from its ranks on: (item_id, model, doc_id).

    All documents prefer the earliest that asks for them, so the greedy result is the one stable assignment, and
    rounds of asking find it: everyone asks for its best `quota` rows that are left, each document keeps the
    earliest that has asked, and all rows of later ones are gone. Rounds are written tables; none gathers the rows.
    """
    best = Window.partitionBy("item_id", "model").orderBy("rnk", "doc_id")
    first = runs.groupBy("item_id", "model", "doc_id").agg(F.min("rnk").alias("rnk"))
    left = saved(first.join(have.select("doc_id").distinct(), "doc_id", "left_anti"), "pool")
    while True:
        asked = saved(left.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= quota).drop("r"), "asked")
        held = asked.groupBy("doc_id").agg(F.min(F.struct("item_id", "model")).alias("by"))
        lost = saved(left.join(held, "doc_id").filter(F.struct("item_id", "model") > F.col("by")).select("item_id", "model", "doc_id"), "lost")
        if asked.join(lost, ["item_id", "model", "doc_id"], "left_semi").isEmpty():
            return asked.select("item_id", "model", "doc_id")
        fresh = saved(left.join(lost, ["item_id", "model", "doc_id"], "left_anti"), "pool")
        discard(left, asked, lost)
        left = fresh


def filled(order: DataFrame, have: DataFrame, gold: DataFrame, size: int, seed: str = "fill-1") -> DataFrame:
    """Exactly `size` documents of order(ord, doc_id) where there are as many: gold first, then the others of `have`,
    both in corpus order, then the rest in hash order."""
    mark = lambda df, c: df.select("doc_id").distinct().withColumn(c, F.lit(1))
    rows = order.select("ord", "doc_id").join(mark(gold, "g"), "doc_id", "left").join(mark(have, "h"), "doc_id", "left")
    kind = F.when(F.col("g") == 1, 0).when(F.col("h") == 1, 1).otherwise(2)
    key = F.when(kind == 2, F.sha2(F.concat_ws("#", F.lit(seed), F.col("doc_id").cast("string")), 256)).otherwise("")
    return ordinals(rows.select("doc_id", "ord", kind.alias("kind"), key.alias("key")), "kind", "key", "ord", name="place").filter(F.col("place") < size).select("doc_id")


def report(*checks: tuple[str, DataFrame]) -> DataFrame:
    """(check, ok, detail): a check passes if its frame of offending rows is empty."""
    out = None
    for name, bad in checks:
        row = bad.agg(F.count("*").alias("detail")).select(F.lit(name).alias("check"), (F.col("detail") == 0).alias("ok"), "detail")
        out = row if out is None else out.union(row)
    return out
