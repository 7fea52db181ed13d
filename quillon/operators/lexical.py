"""Lexical ranking: boolean, coordination, TF-IDF and BM25 families, as one plan shape.

Query terms meet the documents of a stored index, each document's scores are summed where it lies, and the first k
are taken by a window rank, which is cut before and after the one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from quillon.functions.text import ANALYZERS
from quillon.operators import index as stored
from quillon.operators.index import Index

TOP = 1000
DIGITS = 6


def ranked(scores: DataFrame, k: int = TOP, digits: int = DIGITS) -> DataFrame:
    """(item_id, doc_id, rnk, score): rounded scores, best first, ties by doc_id."""
    rows = scores.withColumn("score", F.round("score", digits) + 0.0)  # no negative zero
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return rows.withColumn("rnk", F.row_number().over(order)).filter(F.col("rnk") <= k).select("item_id", "doc_id", F.col("rnk").cast("long").alias("rnk"), "score")


def query_terms(queries: DataFrame, analyzer: str = "stop") -> DataFrame:
    """(item_id, pos, term), pos from 0."""
    return queries.select("item_id", F.posexplode(ANALYZERS[analyzer]("text")).alias("pos", "term"))


#: What a weight may use of a term and the corpus.
OF_TERM = ["df", "idf", "plain", "n_docs", "avgdl", "mean_idf"]


def codes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each row, and the values that they stand for; null is a value."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    found = whole.dictionary_encode(null_encoding="encode")
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def grouped(code: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The group of each row, and the code of each group in ascending order."""
    if cells > 16 * len(code):
        found, at = np.unique(code, return_inverse=True)
        return at, found
    seen = np.zeros(cells, bool)
    seen[code] = True
    return (np.cumsum(seen) - 1)[code], np.flatnonzero(seen)


def first_ones(item: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the first k of an item by rounded score, then doc: of one score the first k by doc, and all
    scores that reach the k-th or come nearer to it than rounding can tell."""
    order = np.lexsort((doc, -score, item))
    i, s, n = item[order], score[order], np.arange(len(order))
    new = np.r_[True, i[1:] != i[:-1]]
    same = np.maximum.accumulate(np.where(new | np.r_[True, s[1:] != s[:-1]], n, 0))
    begin = np.maximum.accumulate(np.where(new, n, 0))
    last = np.minimum(begin + k - 1, len(n) - 1)
    bound = np.where(i[last] == i, s[last], -np.inf) - 2 * 10.0**-DIGITS
    return order[(n - same < k) & (s >= bound)]


def searched(shared, top: int | None, least: float):
    """(doc_id, item_id, score, need) of rows (doc_id, tid, x) or (doc_id, tid, tf, idf, z) in which those of a document stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        items, of, need = q["items"], q["of"], q["need"]

        def scores(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
            """Numbers of documents and items with their scores, and the documents."""
            doc, docs = codes(t.column("doc_id"))
            tid = t.column("tid").to_numpy()
            n = q["count"][tid]
            at = np.repeat(q["start"][tid] - np.cumsum(n) + n, n) + np.arange(n.sum())
            group, values = q["group"][at], [np.repeat(t.column(c).to_numpy(), n) for c in t.column_names[2:]]
            place, code = grouped(np.repeat(doc, n) * len(of) + group, len(docs) * len(of))
            doc, group, size = code // len(of), code % len(of), len(code)
            if len(values) == 1:
                score = np.bincount(place, values[0] * q["factor"][at], size)
            else:  # the least frequency and the greatest idf of a group that is there as a whole
                tf, idf, z = np.full(size, np.inf), np.full(size, -np.inf), np.zeros(size)
                np.minimum.at(tf, place, values[0])
                np.maximum.at(idf, place, values[1])
                z[place] = values[2]
                full = np.flatnonzero(np.bincount(place, minlength=size) == need[group])
                if not len(full):
                    return *(np.zeros(0, np.int64),) * 2, np.zeros(0), docs
                group, part = group[full], np.log(tf[full] + 1.0) * idf[full] * q["weight"][group[full]] * z[full]
                place, code = grouped(doc[full] * len(items) + of[group], len(docs) * len(items))
                return code // len(items), code % len(items), np.bincount(place, part, len(code)), docs
            if least:
                enough = score >= least * need[group]
                doc, group, score = doc[enough], group[enough], score[enough]
            return doc, of[group], score, docs

        def out(doc: pa.Array, item: np.ndarray, score: np.ndarray) -> list[pa.RecordBatch]:
            needs = need[item] if len(of) == len(items) else np.zeros(len(item), np.int64)
            return pa.table([doc, items.take(pa.array(item)), pa.array(score), pa.array(needs)], ["doc_id", "item_id", "score", "need"]).to_batches(10_000)

        kept, size, bound = [], 0, 0
        for t in by_document(batches):
            doc, item, score, docs = scores(t)
            if not top or not pa.types.is_integer(docs.type):
                yield from out(docs.take(pa.array(doc)), item, score)
                continue
            ids, null = docs.fill_null(0).to_numpy()[doc], docs.is_null().to_numpy(zero_copy_only=False)[doc]
            yield from out(pa.nulls(int(null.sum()), docs.type), item[null], score[null])
            kept.append((item[~null], ids[~null], score[~null]))
            size += len(item)
            if size > bound:
                kept = [tuple(np.concatenate(x) for x in zip(*kept))]
                kept = [tuple(x[first_ones(*kept[0], top)] for x in kept[0])]
                size = len(kept[0][0])
                bound = 2 * size + 200_000
        if kept:
            item, ids, score = (np.concatenate(x) for x in zip(*kept))
            rows = first_ones(item, ids, score, top)
            yield from out(pa.array(ids[rows], docs.type), item[rows], score[rows])

    return run


def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of whole documents, of about a batch; those of a document stand together in batches."""
    held: list[pa.RecordBatch] = []  # of the last document so far
    for b in batches:
        if not b.num_rows:
            continue
        doc = codes(b.column("doc_id"))[0]
        start = int(np.argmax(doc == doc[-1]))
        if not start and held and b.column("doc_id")[0] == held[-1].column("doc_id")[-1]:
            held.append(b)
            continue
        if start or held:
            yield pa.Table.from_batches([*held, b.slice(0, start)])
        held = [b.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


class Lexical:
    """All models over one index and query set; scores are (doc_id, item_id, score, ...), each pair once.

    top: if given, scores may leave out what cannot be among a query's first `top`. norm: scores are divided by
    ln(dl + 2)**3; a document without an id has no length and scores -1.
    """

    def __init__(self, index: Index, queries: DataFrame, analyzer: str = "stop", top: int | None = None):
        self.index, self.queries, self.top = index, queries, top
        self.terms = query_terms(queries, analyzer)

    def scored(self, q: DataFrame, values: list[Column], norm: bool = False, factor: Column | None = None, known: Callable[[DataFrame], DataFrame] = lambda x: x, least: float = 0.0) -> DataFrame:
        """q(item_id, term, ...) against all documents.

        One value: the sum over q's terms of value * factor, value of tf, dl and the term, factor of q. Two, for
        q(item_id, phrase, weight, need, term): ln(least tf + 1) * greatest idf * weight of phrases that are there as a whole.
        known(q) gets the terms that have documents. A pass over the documents takes the queries with about BLOCK terms.
        """
        spark, asked = self.queries.sparkSession, self.index.asked(q)
        passes = -(-asked.count() // stored.BLOCK) or 1
        asked, turn = known(asked), F.pmod(F.xxhash64("item_id"), F.lit(passes))
        kind = self.queries.schema["item_id"].dataType.simpleString()
        doc = self.index.documents.schema["doc_id"].dataType.simpleString()
        names = [c for c in ("phrase", "need", "weight") if c in asked.columns]

        def once(rows: DataFrame) -> DataFrame:
            t = rows.select("term", "item_id", *OF_TERM, *names, (F.lit(1.0) if factor is None else factor).cast("double").alias("factor")).toArrow()
            (tid, terms), (item, items) = codes(t.column("term")), codes(t.column("item_id"))
            order = np.argsort(tid, kind="stable")
            count = np.bincount(tid, minlength=len(terms))
            start = np.cumsum(count) - count
            group, cell = item, np.arange(len(items))
            if "phrase" in names:
                phrase = codes(t.column("phrase"))
                group, cell = grouped(item * len(phrase[1]) + phrase[0], len(items) * len(phrase[1]))
                cell //= len(phrase[1])
            of_group = {c: np.zeros(len(cell), t.column(c).to_numpy().dtype) for c in names if c != "phrase"}
            for c, x in of_group.items():
                x[group] = t.column(c).to_numpy()
            shared = {"need": np.zeros(len(cell), np.int64), **of_group, "start": start, "count": count, "group": group[order], "factor": t.column("factor").to_numpy()[order], "of": cell, "items": items}
            few = t.select(["term", *OF_TERM]).take(pa.array(order[start])).append_column("tid", pa.array(np.arange(len(terms))))
            hits = self.index.postings.join(F.broadcast(spark.createDataFrame(few)), "term")  # BLOCK rows
            z = F.lit(1.0)
            if norm:
                z = F.when(F.col("doc_id").isNotNull(), 1 / F.pow(F.log(F.col("dl") + 2.0), 3.0)).otherwise(F.lit(1.0))
            each = [values[0] * z] if len(values) == 1 else [*values, z]
            hits = hits.select("doc_id", "tid", *(F.coalesce(x.cast("double"), F.lit(0.0)).alias(f"x{i}") for i, x in enumerate(each)))
            return hits.mapInArrow(searched(spark.sparkContext.broadcast(shared), self.top, least), f"doc_id {doc}, item_id {kind}, score double, need long")

        found = reduce(DataFrame.union, (once(asked if passes == 1 else asked.filter(turn == i)) for i in range(passes)))
        return found.withColumn("score", F.when(F.col("doc_id").isNull(), -1.0).otherwise(F.col("score"))) if norm else found

    def boolean(self, every: bool) -> DataFrame:
        return self.coordination(least=1.0 if every else 0.0).select("item_id", "doc_id")

    def coordination(self, norm: bool = False, least: float = 0.0) -> DataFrame:
        """How many distinct terms of the query are there, also `need`, how many it has; only of documents with the share `least` of them."""
        q = self.terms.select("item_id", "term").distinct().withColumn("need", F.count("*").over(Window.partitionBy("item_id")))
        return self.scored(q, [F.lit(1.0)], norm, least=least)

    def tfidf(self, q: DataFrame | None = None, norm: bool = False) -> DataFrame:
        q = (self.terms if q is None else q).groupBy("item_id", "term").agg(F.count("*").alias("qtf"))
        return self.scored(q, [F.log(F.col("tf") + 1.0) * F.col("idf")], norm, F.col("qtf"))

    def decayed(self, q: DataFrame | None = None, norm: bool = False, low: float = 0.4) -> DataFrame:
        """TF-IDF with weight 1 - (1 - low)(i / n)**2, i the place among in-vocabulary tokens, n all tokens."""
        q = (self.terms if q is None else q).withColumn("n", F.count("*").over(Window.partitionBy("item_id")))
        place = F.row_number().over(Window.partitionBy("item_id").orderBy("pos")) - 1
        w = 1 - (1 - low) * F.pow(F.col("i") / F.col("n"), 2.0)
        return self.scored(q, [F.log(F.col("tf") + 1.0) * F.col("idf")], norm, w, lambda known: known.withColumn("i", place))

    def phrases(self, phrases: DataFrame, norm: bool = False) -> DataFrame:
        """phrases(item_id, phrase, weight, term): ln(least tf + 1) * greatest idf * weight of every phrase whose terms a document all holds."""
        need = phrases.groupBy("item_id", "phrase").agg(F.countDistinct("term").alias("need"), F.first("weight").alias("weight"))
        return self.scored(phrases.select("item_id", "phrase", "term").distinct().join(need, ["item_id", "phrase"]), [F.col("tf"), F.col("idf")], norm)

    def bm25(self, flavour: str, k1: float | None = None, b: float | None = None) -> DataFrame:
        """lucene (k1 0.9, b 0.4), terrier (k1 1.2, b 0.75, k3 8), okapi (k1 1.5, b 0.75, epsilon 0.25)."""
        k1 = {"lucene": 0.9, "terrier": 1.2, "okapi": 1.5}[flavour] if k1 is None else k1
        b = {"lucene": 0.4, "terrier": 0.75, "okapi": 0.75}[flavour] if b is None else b
        q = self.terms.groupBy("item_id", "term").agg(F.count("*").alias("qtf"))
        df, n, plain, qtf = F.col("df"), F.col("n_docs"), F.col("plain"), F.col("qtf")
        w = {
            "lucene": F.log(1 + (n - df + 0.5) / (df + 0.5)),
            "terrier": F.log2((n - df + 0.5) / (df + 0.5)),
            "okapi": F.when(plain < 0, 0.25 * F.col("mean_idf")).otherwise(plain),
        }[flavour]
        tf, long = F.col("tf"), k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
        part = w * tf / (tf + long) if flavour == "lucene" else w * tf * (k1 + 1) / (tf + long)
        return self.scored(q, [part], factor=9.0 * qtf / (8.0 + qtf) if flavour == "terrier" else qtf).filter(F.col("doc_id").isNotNull())


def reduced(queries: DataFrame, keep: int = 8) -> DataFrame:
    """Stand-in for hand-made keyword queries: (item_id, pos, term, weight) of the first distinct terms, weight 1 - 0.05 pos."""
    first = F.slice(F.array_distinct(ANALYZERS["stop"]("text")), 1, keep)
    return queries.select("item_id", F.posexplode(first).alias("pos", "term")).withColumn("weight", 1 - 0.05 * F.col("pos"))


def phrase_queries(queries: DataFrame) -> DataFrame:
    """Reduced terms in pairs as phrases: (item_id, phrase, weight, term), the weight of a phrase that of its first term."""
    r = reduced(queries).withColumn("phrase", F.floor(F.col("pos") / 2))
    return r.select("item_id", "phrase", "term", (1 - 0.1 * F.col("phrase")).alias("weight"))
