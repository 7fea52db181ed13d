"""Dense ranking by dot product, pooling of vectors, encoding and the contrastive loss over given vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from quillon.functions.vectors import dot, unit
from quillon.operators.lexical import ranked

QUERY_BLOCK = 4096
STEP = 128
FOUND = "item_id long, doc_id long, score double"


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are vectors of `dim` numbers as unit vectors (a zero vector stays), and which rows those are."""
    offsets = column.offsets.to_numpy()
    good = np.flatnonzero((np.diff(offsets) == dim) & ~column.is_null().to_numpy(zero_copy_only=False))
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    v = values[offsets[good][:, None] + np.arange(dim)] if len(good) else np.zeros((0, dim))
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300), good


def best_of(item: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each item, ties by doc."""
    order = np.lexsort((doc, -score, item))
    i = item[order]
    begin = np.maximum.accumulate(np.where(np.r_[True, i[1:] != i[:-1]], np.arange(len(i)), 0)) if len(i) else i
    order = order[np.arange(len(i)) - begin < k]
    return item[order], doc[order], score[order]


def searched(shared, k: int):
    """The best k of each query in a partition. Vectors are compared STEP at a time; of their scores only those are kept
    that reach the k-th best so far, so that memory does not follow the size of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = shared.value
        bound, kept, size, most = np.full(len(names), -np.inf), [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)], 0, 0

        def cut() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return best_of(*(np.concatenate(x) for x in zip(*kept)), k)

        for batch in batches:
            v, good = matrix(batch.column("v"), queries.shape[1])
            docs = batch.column("doc_id").to_numpy()[good]
            for at in range(0, len(docs), STEP):
                scores = queries @ v[at : at + STEP].T
                item, doc = np.nonzero(scores >= bound[:, None])
                kept.append((item, docs[at + doc], np.round(scores[item, doc], 5) + 0.0))
                size += len(item)
                if size > most:
                    item, doc, score = cut()
                    kept, size = [(item, doc, score)], len(item)
                    most = 2 * size + 100_000
                    n = np.bincount(item, minlength=len(names))
                    full = n >= k
                    bound[full] = score[np.cumsum(n)[full] - 1] - 1e-5  # scores below are lower when rounded, too
        item, doc, score = cut()
        ids = np.asarray(names, np.int64)[item]
        yield from pa.table([pa.array(ids), pa.array(doc), pa.array(score)], ["item_id", "doc_id", "score"]).to_batches(10_000)

    return run


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = 100, block: int = QUERY_BLOCK) -> DataFrame:
    """vectors(doc_id, v) by cosine with queries(item_id, q), best k each, rounded to 5 places, ties by doc_id.

    Queries are taken `block` at a time as a matrix against all vectors. Every partition keeps its best k of
    a query, and those are merged. Null vectors, and vectors of another length than a query, are not
    compared with it; no queries give no rows.
    """
    sc = vectors.sparkSession.sparkContext
    found = vectors.sparkSession.createDataFrame([], FOUND)

    def search(rows: list, dim: int) -> DataFrame:
        q = np.array([r["q"] for r in rows], np.float64).reshape(len(rows), dim)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        return vectors.select("doc_id", "v").mapInArrow(searched(sc.broadcast(([r["item_id"] for r in rows], q)), k), FOUND)

    waiting: dict[int, list] = {}  # by length
    for r in queries.select("item_id", "q").filter("q is not null").toLocalIterator():
        rows = waiting.setdefault(len(r["q"]), [])
        rows.append(r)
        if len(rows) == block:
            found = found.union(search(waiting.pop(len(r["q"])), len(r["q"])))
    for dim, rows in waiting.items():
        found = found.union(search(rows, dim))
    return ranked(found, k, 5)


def merged_topk(parts: list[DataFrame], k: int) -> DataFrame:
    """The best k of each query over ranked shards (item_id, doc_id, score), which need not be there at the same time."""
    best = parts[0].select("item_id", "doc_id", "score")
    for p in parts[1:]:
        best = ranked(best.union(p.select("item_id", "doc_id", "score")), k, 5).select("item_id", "doc_id", "score")
    return ranked(best, k, 5)


def without_padding(run: DataFrame) -> DataFrame:
    """run without the rows that pad it: no document, or a score of minus infinity."""
    return run.filter((F.col("doc_id") >= 0) & (F.col("score") > F.lit(float("-inf"))))


def weighted_mean(vectors: DataFrame, key: str, weight: str = "w") -> DataFrame:
    """Weighted mean of v by key, component by component, then unit length, as (key, dim, value)."""
    parts = vectors.select(key, weight, F.posexplode("v").alias("dim", "x"))
    mean = parts.groupBy(key, "dim").agg((F.sum(F.col("x").cast("double") * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1.0))).alias("x"))
    size = mean.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    return mean.join(size, key).select(key, F.col("dim").cast("long").alias("dim"), F.round(F.col("x") / F.greatest("size", F.lit(1e-300)), 6).alias("value"))


def masked_mean(vectors: DataFrame, key: str, mask: str = "mask") -> DataFrame:
    """Mean of the token vectors v that the mask keeps, over at least one, as (key, dim, value)."""
    parts = vectors.select(key, F.col(mask).cast("double").alias("m"), F.posexplode("v").alias("dim", "x"))
    mean = F.sum(F.col("x").cast("double") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1.0))
    return parts.groupBy(key, "dim").agg(F.round(mean, 6).alias("value")).select(key, F.col("dim").cast("long").alias("dim"), "value")


def hashed(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """An encoder of texts without a model: counts of lower-cased words by a hash."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                out[i, int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % dim] += 1
        return out

    return encode


def encoded(chunks: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 256) -> DataFrame:
    """chunks(doc_id, n_words, chunk) with `v`; make() loads the encoder once in each task, which gets `batch` texts at a time.

    An encoder that runs out of memory is asked again with half as many, down to one, and stays at that size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, most = make(), batch
        for b in batches:
            i = 0
            while i < b.num_rows:
                part = b.slice(i, most)
                try:
                    v = encode(part.column("chunk").to_pylist())
                except MemoryError:
                    if most == 1:
                        raise
                    most = max(1, most // 2)
                    continue
                i += part.num_rows
                yield pa.record_batch([part.column("doc_id"), part.column("n_words"), pa.array(list(v), pa.list_(pa.float64()))], ["doc_id", "n_words", "v"])

    return chunks.select("doc_id", "n_words", "chunk").mapInArrow(run, "doc_id long, n_words long, v array<double>")


def contrastive_loss(pairs: DataFrame, size: int) -> DataFrame:
    """(batch, n, loss) of pairs(ord, q, p) in batches of `size`: cross-entropy of each query's own passage against all of its batch."""
    rows = pairs.select(F.floor(F.col("ord") / size).alias("batch"), "ord", unit(F.col("q")).alias("q"), unit(F.col("p")).alias("p"))
    other = rows.select("batch", F.col("ord").alias("other"), F.col("p").alias("r"))
    scores = rows.select("batch", "ord", "q").join(other, "batch").select("batch", "ord", "other", dot(F.col("q"), F.col("r")).alias("s"))
    top = F.max("s").over(Window.partitionBy("batch", "ord"))
    each = scores.withColumn("top", top).groupBy("batch", "ord").agg((F.log(F.sum(F.exp(F.col("s") - F.col("top")))) + F.max("top") - F.sum(F.when(F.col("ord") == F.col("other"), F.col("s")))).alias("loss"))
    return each.groupBy("batch").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("loss"))
