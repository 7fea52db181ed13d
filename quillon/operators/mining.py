"""Training pairs for a dual encoder: best positive passages, hard and random negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from quillon.functions.text import words
from quillon.operators.lexical import ranked


def hashed(tag: str, *names: str) -> Column:
    """A reproducible random order."""
    return F.sha2(F.concat_ws("#", F.lit(tag), *(F.col(x).cast("string") for x in names)), 256)


def best_chunks(rel: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(item_id, doc_id, chunk_index, score): for each (query, document) of rel the passage with the best Okapi score inside that document."""
    tok = chunks.join(rel.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "chunk_index", F.explode(words("chunk")).alias("term"))
    tf = tok.groupBy("doc_id", "chunk_index", "term").agg(F.count("*").alias("tf"))
    size = tf.groupBy("doc_id", "chunk_index").agg(F.sum("tf").alias("len"))
    mean = size.groupBy("doc_id").agg(F.avg("len").alias("avglen"), F.count("*").alias("n"))
    plain = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    df = tf.groupBy("doc_id", "term").agg(F.count("*").alias("df")).join(mean, "doc_id").withColumn("plain", plain)
    w = df.withColumn("w", F.when(F.col("plain") < 0, 0.25 * F.avg("plain").over(Window.partitionBy("doc_id"))).otherwise(F.col("plain")))
    q = queries.select("item_id", F.explode(words("text")).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("qtf"))
    hits = rel.select("item_id", "doc_id").join(q, "item_id").join(w.select("doc_id", "term", "w", "avglen"), ["doc_id", "term"]).join(tf, ["doc_id", "term"]).join(size, ["doc_id", "chunk_index"])
    part = F.col("qtf") * F.col("w") * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("len") / F.col("avglen")))
    scores = hits.groupBy("item_id", "doc_id", "chunk_index").agg((F.round(F.sum(part), 6) + 0.0).alias("score"))
    first = Window.partitionBy("item_id", "doc_id").orderBy(F.col("score").desc(), "chunk_index")
    return scores.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")


def hard_documents(scores: DataFrame, rel: DataFrame, top: int = 10) -> DataFrame:
    """(item_id, doc_id): the first of a query's `top` best documents that is not relevant."""
    best = ranked(scores, top).join(rel, ["item_id", "doc_id"], "left_anti")
    return best.groupBy("item_id").agg(F.min_by("doc_id", "rnk").alias("doc_id"))


def one_passage(first: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item_id, doc_id, chunk_index): one passage in hash order for each row of first(item_id, doc_id)."""
    pick = first.join(chunks.select("doc_id", "chunk_index"), "doc_id").groupBy("item_id", "doc_id").agg(F.min_by("chunk_index", hashed("neg", "item_id", "doc_id", "chunk_index")).alias("chunk_index"))
    return pick.select("item_id", "doc_id", "chunk_index")


def random_negatives(best: DataFrame, chunks: DataFrame, rel: DataFrame, negatives: int = 7, pool: int = 64) -> DataFrame:
    """(item_id, pos_doc, pos_chunk, neg_doc, neg_chunk): up to `negatives` passages that are relevant to no query for each
    positive, from `pool` of them in hash order."""
    some = chunks.select("doc_id", "chunk_index").join(rel.select("doc_id").distinct(), "doc_id", "left_anti").orderBy(hashed("pool", "doc_id", "chunk_index")).limit(pool)
    some = some.select(F.col("doc_id").alias("neg_doc"), F.col("chunk_index").alias("neg_chunk"))
    pairs = best.select("item_id", F.col("doc_id").alias("pos_doc"), F.col("chunk_index").alias("pos_chunk")).crossJoin(F.broadcast(some))  # `pool` rows
    first = Window.partitionBy("item_id", "pos_doc").orderBy(hashed("rand", "item_id", "pos_doc", "neg_doc", "neg_chunk"))
    return pairs.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= negatives).drop("r")
