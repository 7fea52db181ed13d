"""Every query by name over the tables of a folder, and the same in SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from quillon.functions.text import ENDINGS, STOPWORDS, TERM, TREEBANK, tokens, treebank, words
from quillon.functions.vectors import norm
from quillon.operators import chunking, dense, evaluation, index, lexical, mining, subsets, validator
from quillon.session import saved, small, table_path
from quillon.sources import jsonl, shards, trec
from quillon.sources import lines as ordered_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# -- SQL fragments ---------------------------------------------------------------------------------------------
STOP = "(" + ",".join(f"'{w}'" for w in STOPWORDS) + ")"


def sql_tokens(text: str, stop: bool = True) -> str:
    found = f"regexp_extract_all(lower(coalesce({text}, '')), '{TERM}')"
    return f"list_filter({found}, lambda x: x NOT IN {STOP})" if stop else found


def sql_words(text: str, lower: bool = True) -> str:
    return f"list_filter(regexp_split_to_array({f'lower({text})' if lower else text}, '\\s+'), lambda x: x <> '')"


BASE = f"""
WITH RECURSIVE toks AS (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents),
posts AS (SELECT term, doc_id, count(*) AS tf FROM toks GROUP BY ALL),
n AS (SELECT count(*) AS n_docs FROM documents),
stats AS (SELECT term, count(*) AS df, ln(n_docs / count(*)::DOUBLE) AS idf FROM posts, n GROUP BY term, n_docs),
dl AS (SELECT doc_id, len({sql_tokens('text')})::BIGINT AS dl FROM documents),
q AS (SELECT item_id, unnest(range(len(l))) AS pos, unnest(l) AS term FROM (SELECT item_id, {sql_tokens('text')} AS l FROM benchmark)),
qd AS (SELECT DISTINCT item_id, term FROM q),
red AS (SELECT item_id, unnest(range(least(len(l), 8))) AS pos, unnest(l[1:8]) AS term FROM (
  SELECT item_id, list(term ORDER BY pos) AS l FROM (SELECT item_id, term, min(pos) AS pos FROM q GROUP BY ALL) GROUP BY item_id)),
phr AS (SELECT item_id, pos // 2 AS phrase, term, 1 - 0.1 * (pos // 2) AS weight FROM red),
tfidf AS (SELECT item_id, doc_id, sum(ln(tf + 1.0) * idf) AS score FROM q JOIN stats USING (term) JOIN posts USING (term) GROUP BY ALL),
coord AS (SELECT item_id, doc_id, count(*)::DOUBLE AS score FROM qd JOIN posts USING (term) GROUP BY ALL),
"""


def sql_ranked(scores: str, k: int = lexical.TOP, digits: int = lexical.DIGITS) -> str:
    return (
        "SELECT item_id, doc_id, rnk, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rnk "
        f"FROM (SELECT item_id, doc_id, round(score, {digits}) + 0.0 AS score FROM ({scores}))) WHERE rnk <= {k}"
    )


def sql_normed(scores: str) -> str:
    return f"SELECT item_id, doc_id, coalesce(score / pow(ln(dl + 2.0), 3.0), -1.0) AS score FROM ({scores}) LEFT JOIN dl USING (doc_id)"


def based(body: str) -> str:
    """A statement over the base; a body that begins with a comma adds tables of its own."""
    return BASE.rstrip().rstrip(",") + "\n" + body


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (spark, folder), and its SQL if it has one."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def version(spark: SparkSession, path: str) -> tuple:
    """What tells one state of a file or folder of files from another."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return tuple(sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in found))


INDEXES: dict[tuple, index.Index] = {}


def stored(spark: SparkSession, folder: str) -> index.Index:
    """The stored index of a folder's documents: written once for each state of their files, read by every ranking."""
    key = (spark.sparkContext.applicationId, version(spark, f"{folder}/documents.parquet"))
    if key not in INDEXES:
        path = table_path(spark, "index")
        index.write_index(table(spark, folder, "documents"), path)
        INDEXES[key] = index.read_index(spark, path)
    return INDEXES[key]


def corpus(spark: SparkSession, folder: str, top: int | None = None) -> lexical.Lexical:
    return lexical.Lexical(stored(spark, folder), table(spark, folder, "benchmark"), top=top)


# -- index ------------------------------------------------------------------------------------------------------
@query(based("SELECT term, doc_id, tf FROM posts"))
def tf_postings(s, d):
    return index.postings(table(s, d, "documents"))


@query(based("SELECT term, doc_id, tf, df, round(idf, 9) AS idf, dl, n_docs, round((SELECT avg(dl) FROM dl), 9) AS avgdl FROM posts JOIN stats USING (term) JOIN dl USING (doc_id), n"))
def stored_index(s, d):
    """Writes the index of all documents anew and reads its tables back; postings meet the statistics in one shuffle."""
    path = table_path(s, "index")
    index.write_index(table(s, d, "documents"), path)
    i = index.read_index(s, path)
    rows = i.postings.filter("doc_id is not null").join(i.stats, "term").crossJoin(F.broadcast(i.corpus))  # one row
    return rows.select("term", "doc_id", "tf", "df", F.round("idf", 9).alias("idf"), "dl", "n_docs", F.round("avgdl", 9).alias("avgdl"))


@query(based("SELECT term, df, round(idf, 9) AS idf FROM stats"))
def term_stats(s, d):
    docs = table(s, d, "documents")
    return index.term_stats(index.postings(docs), docs).withColumn("idf", F.round("idf", 9))


@query(based("SELECT term, count(*) AS df, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS doc_ids FROM posts GROUP BY term"))
def posting_lists(s, d):
    return index.posting_lists(index.postings(table(s, d, "documents"))).withColumn("doc_ids", F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ","))


@query(based("SELECT doc_id, dl FROM dl"))
def doc_length(s, d):
    return index.lengths(table(s, d, "documents"))


@query(f"SELECT doc_id, len({sql_tokens('text', False)})::BIGINT AS n_all, len({sql_tokens('text')})::BIGINT AS n_kept, len(list_distinct({sql_tokens('text')}))::BIGINT AS n_distinct, len({sql_words('text')})::BIGINT AS n_words FROM documents")
def stopword_tokens(s, d):
    n = lambda c: F.size(c).cast("long")
    return table(s, d, "documents").select("doc_id", n(tokens("text", False)).alias("n_all"), n(tokens("text")).alias("n_kept"), n(F.array_distinct(tokens("text"))).alias("n_distinct"), n(words("text")).alias("n_words"))


# -- lexical ranking ----------------------------------------------------------------------------------------------
@query(based("SELECT item_id, doc_id FROM coord JOIN (SELECT item_id, count(*) AS need FROM qd GROUP BY ALL) USING (item_id) WHERE score = need"))
def boolean_and(s, d):
    return corpus(s, d).boolean(True)


@query(based("SELECT item_id, doc_id FROM coord"))
def boolean_or(s, d):
    return corpus(s, d).boolean(False)


def pair(name: str, scores: Callable[[lexical.Lexical, DataFrame, bool], DataFrame], sql: str) -> None:
    """A model and its length-normalised form."""
    query(based(sql_ranked(sql)), name)(lambda s, d: lexical.ranked(scores(corpus(s, d, lexical.TOP), table(s, d, "benchmark"), False)))
    query(based(sql_ranked(sql_normed(sql))), f"{name}_norm")(lambda s, d: lexical.ranked(scores(corpus(s, d, lexical.TOP), table(s, d, "benchmark"), True)))


def sql_decay(q: str) -> str:
    return (
        f"SELECT item_id, doc_id, sum(ln(tf + 1.0) * idf * (1 - 0.6 * pow(i / n::DOUBLE, 2))) AS score FROM (SELECT k.*, row_number() OVER (PARTITION BY item_id ORDER BY pos) - 1 AS i FROM {q} k JOIN stats USING (term)) "
        f"JOIN (SELECT item_id, count(*) AS n FROM {q} GROUP BY ALL) USING (item_id) JOIN stats USING (term) JOIN posts USING (term) GROUP BY ALL"
    )


pair("coord_count", lambda c, b, norm: c.coordination(norm), "SELECT * FROM coord")
pair("tfidf", lambda c, b, norm: c.tfidf(norm=norm), "SELECT * FROM tfidf")
pair("tfidf_reduced", lambda c, b, norm: c.tfidf(lexical.reduced(b), norm), "SELECT item_id, doc_id, sum(ln(tf + 1.0) * idf) AS score FROM red JOIN stats USING (term) JOIN posts USING (term) GROUP BY ALL")
pair("tfidf_decay", lambda c, b, norm: c.decayed(lexical.reduced(b), norm), sql_decay("red"))
pair(
    "phrase_weighted",
    lambda c, b, norm: c.phrases(lexical.phrase_queries(b), norm),
    "SELECT item_id, doc_id, sum(ln(tf + 1.0) * idf * weight) AS score FROM (SELECT item_id, phrase, doc_id, min(tf) AS tf, max(idf) AS idf, count(*) AS n, any_value(weight) AS weight FROM phr JOIN stats USING (term) JOIN posts USING (term) GROUP BY item_id, phrase, doc_id) "
    "JOIN (SELECT item_id, phrase, count(DISTINCT term) AS need FROM phr GROUP BY ALL) USING (item_id, phrase) WHERE n = need GROUP BY ALL",
)

BM25 = "SELECT item_id, doc_id, sum({part}) AS score FROM (SELECT item_id, term, count(*) AS qtf FROM q GROUP BY ALL) JOIN (SELECT term, {w} AS w FROM stats, n) USING (term) JOIN posts USING (term) JOIN dl USING (doc_id), (SELECT avg(dl) AS avgdl FROM dl) GROUP BY ALL"


def long(k1: float, b: float) -> str:
    return f"{k1} * (1 - {b} + {b} * dl / avgdl)"


@query(based(sql_ranked(BM25.format(w="ln(1 + (n_docs - df + 0.5) / (df + 0.5))", part=f"qtf * w * tf / (tf + {long(0.9, 0.4)})"))))
def bm25_lucene(s, d):
    return lexical.ranked(corpus(s, d, lexical.TOP).bm25("lucene"))


@query(based(sql_ranked(BM25.format(w="log2((n_docs - df + 0.5) / (df + 0.5))", part=f"w * tf * 2.2 / (tf + {long(1.2, 0.75)}) * 9.0 * qtf / (8.0 + qtf)"))))
def bm25_terrier(s, d):
    return lexical.ranked(corpus(s, d, lexical.TOP).bm25("terrier"))


PLAIN = "(ln(n_docs - df + 0.5) - ln(df + 0.5))"


@query(based(sql_ranked(BM25.format(w=f"CASE WHEN {PLAIN} < 0 THEN 0.25 * (SELECT avg({PLAIN}) FROM stats, n) ELSE {PLAIN} END", part=f"qtf * w * tf * 2.5 / (tf + {long(1.5, 0.75)})"))))
def bm25_okapi(s, d):
    return lexical.ranked(corpus(s, d, lexical.TOP).bm25("okapi"))


# -- dense --------------------------------------------------------------------------------------------------------
DENSE_SQL = sql_ranked(
    "SELECT q.vec_id AS item_id, v.vec_id AS doc_id, list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) / sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) AS score "
    "FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0", 100, 5)


def vectors(s, d) -> tuple[DataFrame, DataFrame]:
    e = table(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("q"))


@query(DENSE_SQL)
def dense_topk(s, d):
    return dense.dense_topk(*vectors(s, d))


@query(DENSE_SQL)
def dense_sharded_topk(s, d):
    """Shard by shard, the best so far merged with each."""
    v, q = vectors(s, d)
    return dense.merged_topk([dense.dense_topk(v.filter(F.col("doc_id") % 4 == shard), q) for shard in range(4)], 100)


@query("SELECT vec_id, unnest(range(len(embedding))) AS dim, round(unnest(embedding)::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) + 0.0 AS value FROM embeddings")
def l2_normalize(s, d):
    e = table(s, d, "embeddings").select("vec_id", norm(F.col("embedding")).alias("n"), F.posexplode("embedding").alias("dim", "x"))
    return e.select("vec_id", F.col("dim").cast("long").alias("dim"), (F.round(F.col("x").cast("double") / F.col("n"), 6) + 0.0).alias("value"))


@query(
    "WITH p AS (SELECT label, 1 + vec_id % 3 AS w, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), "
    "m AS (SELECT label, dim, sum(x * w) / greatest(sum(w), 1) AS x FROM p GROUP BY ALL), z AS (SELECT label, sqrt(sum(x * x)) AS size FROM m GROUP BY label) "
    "SELECT label, dim, round(x / size, 6) + 0.0 AS value FROM m JOIN z USING (label)"
)
def weighted_mean_vectors(s, d):
    e = table(s, d, "embeddings").select("label", (1 + F.col("vec_id") % 3).alias("w"), F.col("embedding").alias("v"))
    return dense.weighted_mean(e, "label").withColumn("value", F.col("value") + 0.0)


# -- passages and training pairs ----------------------------------------------------------------------------------
def sql_windows(size: int, step: int, source: str = "documents") -> str:
    return (
        f"SELECT doc_id, i AS chunk_index, len(w[i * {step} + 1 : i * {step} + {size}])::BIGINT AS n_words, array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' ') AS chunk "
        f"FROM (SELECT doc_id, w, unnest(range(greatest(0, ceil((len(w) - {size}) / {step}::DOUBLE))::BIGINT + 1)) AS i FROM (SELECT doc_id, {sql_words('text', False)} AS w FROM {source}) WHERE len(w) > 0)"
    )


@query(sql_windows(100, 50))
def chunk_sliding(s, d):
    return chunking.windows(table(s, d, "documents"), 100, 50)


@query(sql_windows(512, 448))
def overflow_windows(s, d):
    return chunking.overflow(table(s, d, "documents"))


# A document answers a query if it holds at least 70% of its distinct terms.
SQL_QRELS = "qrels AS (SELECT item_id, doc_id, CASE WHEN score >= 0.9 * need THEN 2 ELSE 1 END AS rel FROM coord JOIN (SELECT item_id, count(*) AS need FROM qd GROUP BY ALL) USING (item_id) WHERE score >= 0.7 * need)"


def qrels(s, d) -> DataFrame:
    """Judgements are given to an evaluation: made once for each state of the tables."""
    key = (s.sparkContext.applicationId, version(s, f"{d}/documents.parquet"), version(s, f"{d}/benchmark.parquet"))
    if key not in QRELS:
        rows = corpus(s, d).coordination(least=0.7)
        QRELS[key] = saved(rows.select("item_id", "doc_id", F.when(F.col("score") >= 0.9 * F.col("need"), 2).otherwise(1).alias("rel")), "qrels")
    return QRELS[key]


QRELS: dict[tuple, DataFrame] = {}


SQL_CHUNKS = f"""
chunks AS ({sql_windows(100, 50)}),
ctok AS (SELECT doc_id, chunk_index, unnest({sql_words('chunk')}) AS term FROM chunks JOIN (SELECT DISTINCT doc_id FROM qrels) USING (doc_id)),
clen AS (SELECT doc_id, chunk_index, count(*) AS len FROM ctok GROUP BY ALL),
cavg AS (SELECT doc_id, avg(len) AS avglen, count(*) AS n FROM clen GROUP BY ALL),
ctf AS (SELECT doc_id, chunk_index, term, count(*) AS tf FROM ctok GROUP BY ALL),
cdf AS (SELECT doc_id, term, count(*) AS df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS plain FROM ctf JOIN cavg USING (doc_id) GROUP BY doc_id, term, n),
cw AS (SELECT doc_id, term, CASE WHEN plain < 0 THEN 0.25 * avg(plain) OVER (PARTITION BY doc_id) ELSE plain END AS w FROM cdf),
qw AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({sql_words('text')}) AS term FROM benchmark) GROUP BY ALL),
cscore AS (SELECT item_id, doc_id, chunk_index, sum(qtf * w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avglen))) AS score
  FROM qrels JOIN qw USING (item_id) JOIN cw USING (doc_id, term) JOIN ctf USING (doc_id, term) JOIN clen USING (doc_id, chunk_index) JOIN cavg USING (doc_id) GROUP BY ALL),
best AS (SELECT item_id, doc_id, chunk_index, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY score DESC, chunk_index) AS r FROM (SELECT item_id, doc_id, chunk_index, round(score, 6) + 0.0 AS score FROM cscore)) WHERE r = 1)
"""


def passages(s, d, of: DataFrame) -> DataFrame:
    """Passages of the documents of(doc_id), the only ones that are cut."""
    return chunking.windows(table(s, d, "documents").join(small(saved(of.select("doc_id").distinct(), "asked")), "doc_id", "left_semi"), 100, 50)


def best_chunks(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Best passages of relevant documents; also all passages and the judgements."""
    rel, docs = qrels(s, d), table(s, d, "documents")
    return mining.best_chunks(rel, passages(s, d, rel), table(s, d, "benchmark")), chunking.windows(docs, 100, 50), rel


@query(based(f", {SQL_QRELS}, {SQL_CHUNKS} SELECT * FROM best"))
def best_positive_chunk(s, d):
    return best_chunks(s, d)[0]


def sql_pick(key: str) -> str:
    return f"sha256(concat_ws('#', {key}))"


SQL_HARD = f"""
okapi AS (SELECT * FROM ({sql_ranked(BM25.format(w=f"CASE WHEN {PLAIN} < 0 THEN 0.25 * (SELECT avg({PLAIN}) FROM stats, n) ELSE {PLAIN} END", part=f"qtf * w * tf * 2.5 / (tf + {long(1.5, 0.75)})"), 10)})),
hard AS (SELECT item_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rnk) AS r FROM (SELECT o.item_id, o.doc_id, o.rnk FROM okapi o ANTI JOIN qrels x ON o.item_id = x.item_id AND o.doc_id = x.doc_id)) WHERE r = 1),
neg AS (SELECT item_id, doc_id, chunk_index FROM (SELECT h.item_id, h.doc_id, c.chunk_index, row_number() OVER (PARTITION BY h.item_id ORDER BY {sql_pick("'neg', h.item_id::VARCHAR, h.doc_id::VARCHAR, c.chunk_index::VARCHAR")}) AS r FROM hard h JOIN chunks c USING (doc_id)) WHERE r = 1)
"""


def hard_negatives(s, d) -> DataFrame:
    first = saved(mining.hard_documents(corpus(s, d, 10).bm25("okapi"), qrels(s, d)), "hard")
    return mining.one_passage(first, passages(s, d, first))


@query(based(f", {SQL_QRELS}, {SQL_CHUNKS}, {SQL_HARD} SELECT * FROM neg"))
def hard_negative(s, d):
    return hard_negatives(s, d)


@query(based(f", {SQL_QRELS}, {SQL_CHUNKS}, {SQL_HARD} SELECT b.item_id, b.doc_id AS pos_doc, b.chunk_index AS pos_chunk, n.doc_id AS neg_doc, n.chunk_index AS neg_chunk FROM best b JOIN neg n USING (item_id)"))
def triplets_hard(s, d):
    best, neg = best_chunks(s, d)[0], hard_negatives(s, d).select("item_id", F.col("doc_id").alias("neg_doc"), F.col("chunk_index").alias("neg_chunk"))
    return best.select("item_id", F.col("doc_id").alias("pos_doc"), F.col("chunk_index").alias("pos_chunk")).join(neg, "item_id")


@query(based(
    f", {SQL_QRELS}, {SQL_CHUNKS}, "
    f"pool AS (SELECT doc_id, chunk_index FROM (SELECT doc_id, chunk_index FROM chunks c ANTI JOIN qrels x ON c.doc_id = x.doc_id) ORDER BY {sql_pick(chr(39) + 'pool' + chr(39) + ', doc_id::VARCHAR, chunk_index::VARCHAR')} LIMIT 64) "
    f"SELECT item_id, pos_doc, pos_chunk, neg_doc, neg_chunk FROM (SELECT b.item_id, b.doc_id AS pos_doc, b.chunk_index AS pos_chunk, p.doc_id AS neg_doc, p.chunk_index AS neg_chunk, row_number() OVER (PARTITION BY b.item_id, b.doc_id ORDER BY {sql_pick(chr(39) + 'rand' + chr(39) + ', b.item_id::VARCHAR, b.doc_id::VARCHAR, p.doc_id::VARCHAR, p.chunk_index::VARCHAR')}) AS r FROM best b, pool p) WHERE r <= 7"
))
def triplets_random(s, d):
    best, chunks, rel = best_chunks(s, d)
    return mining.random_negatives(best, chunks, rel)


@query(based(f", {SQL_QRELS}, chunks AS ({sql_windows(100, 50)}) SELECT item_id, doc_id, chunk_index, rel FROM qrels JOIN chunks USING (doc_id)"))
def chunk_qrels(s, d):
    rel = qrels(s, d)
    return rel.join(passages(s, d, rel).select("doc_id", "chunk_index"), "doc_id").select("item_id", "doc_id", "chunk_index", "rel")


# -- evaluation -----------------------------------------------------------------------------------------------------
SQL_JUDGED = """
runrank AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id::VARCHAR DESC) AS rank FROM run),
j AS (SELECT item_id, doc_id, rel, rank, row_number() OVER (PARTITION BY item_id ORDER BY rank NULLS LAST, doc_id) AS hit, row_number() OVER (PARTITION BY item_id ORDER BY rel DESC, doc_id) AS ideal FROM qrels LEFT JOIN runrank USING (item_id, doc_id))
"""


def sql_measure(family: str, k: int | None) -> str:
    inside = "rank IS NOT NULL" if k is None else f"coalesce(rank <= {k}, false)"
    hits = f"count(*) FILTER ({inside})::DOUBLE"
    return {
        "ndcg": f"coalesce(sum(rel / log2(rank + 1.0)) FILTER ({inside}), 0) / sum(rel / log2(ideal + 1.0)) FILTER (ideal <= {k})",
        "r": f"{hits} / count(*)",
        "p": f"{hits} / {k}",
        "f1": f"CASE WHEN {hits} > 0 THEN 2 * ({hits} / {k}) * ({hits} / count(*)) / ({hits} / {k} + {hits} / count(*)) ELSE 0 END",
        "success": f"CASE WHEN {hits} > 0 THEN 1.0 ELSE 0.0 END",
        "rr": "coalesce(1.0 / min(rank), 0)",
        "map": f"coalesce(sum(hit / rank::DOUBLE) FILTER ({inside}), 0) / count(*)",
    }[family]


def sql_evaluate(labels: list[str], run: str = "tfidf_run") -> str:
    per = ", ".join(f"{sql_measure(*evaluation.parse_metric(x))} AS m{i}" for i, x in enumerate(labels))
    rows = " UNION ALL ".join(f"SELECT '{x}' AS metric, round(avg(m{i}), 6) AS value FROM per" for i, x in enumerate(labels))
    return f"{SQL_JUDGED}, per AS (SELECT item_id, {per} FROM j GROUP BY item_id) {rows}"


SQL_RUN = f"run AS ({sql_ranked('SELECT * FROM tfidf')}), "


def tfidf_run(s, d) -> DataFrame:
    return lexical.ranked(corpus(s, d, lexical.TOP).tfidf())


MEASURES = {
    "eval_ndcg": ["NDCG@10", "NDCG@1000"], "eval_recall": ["R@10", "recall@1000"], "eval_precision": ["P@10", "precision@5"], "eval_rr": ["RR"],
    "eval_map": ["MAP"], "eval_map_cut": ["MAP@10", "MAP@1000"], "eval_f1": ["F1@10"], "eval_success": ["success@1", "success@10"],
}
for name_, labels_ in MEASURES.items():
    query(based(f", {SQL_QRELS}, {SQL_RUN} {sql_evaluate(labels_)}"), name_)(lambda s, d, x=labels_: evaluation.evaluate(qrels(s, d), tfidf_run(s, d), x))


@query(based(f", {SQL_QRELS}, {SQL_RUN} asked AS (SELECT DISTINCT item_id FROM qrels), ran AS (SELECT DISTINCT item_id FROM run WHERE item_id % 3 <> 0) SELECT item_id FROM asked WHERE item_id NOT IN (SELECT item_id FROM ran)"))
def eval_missing(s, d):
    return evaluation.missing(qrels(s, d), tfidf_run(s, d).filter("item_id % 3 <> 0"))


# -- subsets and checks -----------------------------------------------------------------------------------------------
SQL_SPLIT = """
sides AS (SELECT split, query_id, CASE WHEN r <= floor(0.8 * n + 1e-9) THEN 'train80' ELSE 'eval20' END AS side FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY sha256(concat_ws('#', 'seed-1', split, query_id::VARCHAR)), query_id) AS r, count(*) OVER (PARTITION BY split) AS n
  FROM (SELECT 'dev' || (item_id % 3)::VARCHAR AS split, item_id AS query_id FROM benchmark)))
"""
SQL_GOLD = "gold AS (SELECT DISTINCT doc_id FROM qrels JOIN sides ON query_id = item_id WHERE side = 'train80')"


def sides(s, d) -> DataFrame:
    return subsets.split_80_20(table(s, d, "benchmark").select(F.concat(F.lit("dev"), (F.col("item_id") % 3).cast("string")).alias("split"), F.col("item_id").alias("query_id")))


def gold(s, d) -> DataFrame:
    train = sides(s, d).filter("side = 'train80'").select(F.col("query_id").alias("item_id"))
    return qrels(s, d).join(train, "item_id", "left_semi").select("doc_id").distinct()


@query(f"WITH {SQL_SPLIT} SELECT * FROM sides")
def split_80_20(s, d):
    return sides(s, d)


@query(based(f", {SQL_QRELS}, {SQL_SPLIT} SELECT side, doc_id, min(item_id) AS first_item FROM qrels JOIN sides ON query_id = item_id GROUP BY ALL"))
def gold_docs(s, d):
    rows = qrels(s, d).join(sides(s, d).withColumnRenamed("query_id", "item_id"), "item_id")
    return rows.groupBy("side", "doc_id").agg(F.min("item_id").alias("first_item"))


SQL_ORDER = "placed AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ord FROM documents)"
SQL_NEAR2 = "near AS (SELECT DISTINCT o.doc_id FROM placed o JOIN (SELECT ord FROM placed SEMI JOIN gold USING (doc_id)) g ON o.ord BETWEEN g.ord - 2 AND g.ord + 2 AND o.ord <> g.ord)"


def order(s, d) -> DataFrame:
    """(ord, doc_id): places of all documents."""
    return ordered_lines.ordinals(table(s, d, "documents").select("doc_id"), "doc_id")


@query(f"WITH {SQL_ORDER} SELECT ord, doc_id FROM placed")
def corpus_order(s, d):
    return order(s, d).select("ord", "doc_id")


@query(f"WITH {SQL_ORDER} SELECT ord, doc_id, len(text)::BIGINT AS n FROM placed JOIN documents USING (doc_id) WHERE ord IN (0, 1, 99, 150)")
def line_at(s, d):
    """Point lookups by place."""
    docs = ordered_lines.ordinals(table(s, d, "documents").select("doc_id", F.length("text").cast("long").alias("n")), "doc_id")
    return ordered_lines.lines_at(docs, [0, 1, 99, 150]).select("ord", "doc_id", "n")


@query(based(f", {SQL_QRELS}, {SQL_SPLIT}, {SQL_GOLD}, {SQL_ORDER}, {SQL_NEAR2} SELECT doc_id FROM near"))
def neighbors(s, d):
    return subsets.neighbours(order(s, d), gold(s, d), 2, 2)


def runs(s, d) -> DataFrame:
    c = corpus(s, d, 100)
    out = [lexical.ranked(x, 100).select(F.lit(m).alias("model"), "item_id", "doc_id", "rnk") for m, x in (("coord", c.coordination()), ("tfidf", c.tfidf()))]
    return out[0].union(out[1])


# Step after step, what is taken so far in a list.
@query(based(
    f", {SQL_QRELS}, {SQL_SPLIT}, {SQL_GOLD}, pruns AS (SELECT 'coord' AS model, * FROM ({sql_ranked('SELECT * FROM coord', 100)}) UNION ALL SELECT 'tfidf' AS model, * FROM ({sql_ranked('SELECT * FROM tfidf', 100)})), "
    "asked AS (SELECT item_id, model, list(doc_id ORDER BY rnk) AS docs, row_number() OVER (ORDER BY item_id, model) AS step FROM pruns GROUP BY item_id, model), "
    "pool AS (SELECT 0::BIGINT AS step, (SELECT list(doc_id) FROM gold) AS taken, []::BIGINT[] AS got UNION ALL "
    "SELECT p.step + 1, list_concat(p.taken, list_filter(a.docs, lambda x: NOT list_contains(p.taken, x))[1:5]), list_filter(a.docs, lambda x: NOT list_contains(p.taken, x))[1:5] FROM pool p JOIN asked a ON a.step = p.step + 1) "
    "SELECT item_id, model, unnest(got) AS doc_id FROM pool JOIN asked USING (step)"
))
def pool_quota(s, d):
    return subsets.pool_quota(runs(s, d), gold(s, d), 5)


SQL_FILL = """
fill AS (SELECT d.doc_id FROM documents d LEFT JOIN gold g ON g.doc_id = d.doc_id LEFT JOIN near v ON v.doc_id = d.doc_id
  ORDER BY CASE WHEN g.doc_id IS NOT NULL THEN 0 WHEN v.doc_id IS NOT NULL THEN 1 ELSE 2 END,
  CASE WHEN g.doc_id IS NULL AND v.doc_id IS NULL THEN sha256(concat_ws('#', 'fill-1', d.doc_id::VARCHAR)) ELSE '' END, d.doc_id LIMIT 200)
"""
SQL_SUBSET = f", {SQL_QRELS}, {SQL_SPLIT}, {SQL_GOLD}, {SQL_ORDER}, {SQL_NEAR2}, {SQL_FILL}"


def subset(s, d, size: int = 200) -> DataFrame:
    docs, g = order(s, d), saved(gold(s, d), "gold")
    return subsets.filled(docs, subsets.neighbours(docs, g, 2, 2), g, size)


@query(based(f"{SQL_SUBSET} SELECT * FROM fill"))
def fill_to_size(s, d):
    return subset(s, d)


@query(based(f"{SQL_SUBSET} SELECT doc_id, sha256(text) AS hash, text FROM documents SEMI JOIN fill USING (doc_id)"))
def verbatim_subset(s, d):
    return table(s, d, "documents").join(small(saved(subset(s, d), "subset")), "doc_id", "left_semi").select("doc_id", F.sha2("text", 256).alias("hash"), "text")


@query(based(f"{SQL_SUBSET} SELECT DISTINCT split, query_id FROM sides JOIN qrels ON item_id = query_id SEMI JOIN fill USING (doc_id)"))
def surviving_queries(s, d):
    left = qrels(s, d).join(subset(s, d), "doc_id", "left_semi").select(F.col("item_id").alias("query_id")).distinct()
    return sides(s, d).join(left, "query_id").select("split", "query_id")


@query(based(f"{SQL_SUBSET} SELECT 'gold' AS part, count(*) AS n FROM gold UNION ALL SELECT 'near', count(*) FROM near UNION ALL SELECT 'subset', count(*) FROM fill UNION ALL SELECT side, count(*) FROM sides GROUP BY side"))
def build_stats(s, d):
    docs, g = order(s, d), gold(s, d)
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return n(g, "gold").union(n(subsets.neighbours(docs, g, 2, 2), "near")).union(n(subset(s, d), "subset")).union(sides(s, d).groupBy(F.col("side").alias("part")).agg(F.count("*").alias("n")))


# -- files: a subset is written, faults are planted in its files by rule, and every check is run on them ---------------------
SQL_FILES = f"""{SQL_QRELS}, {SQL_SPLIT}, {SQL_ORDER},
g1 AS (SELECT split, query_id, side, doc_id FROM (SELECT item_id, min(doc_id) AS doc_id FROM qrels GROUP BY item_id) JOIN sides ON query_id = item_id),
gd AS (SELECT DISTINCT side, doc_id, ord FROM g1 JOIN placed USING (doc_id)),
nd AS (SELECT DISTINCT g.side, o.doc_id FROM gd g JOIN placed o ON o.ord BETWEEN g.ord - 2 AND g.ord + 2 AND o.ord <> g.ord),
ch AS (SELECT side, doc_id FROM (SELECT s.side, p.doc_id, row_number() OVER (PARTITION BY s.side ORDER BY CASE WHEN g.doc_id IS NOT NULL THEN 0 WHEN n.doc_id IS NOT NULL THEN 1 ELSE 2 END,
  CASE WHEN g.doc_id IS NULL AND n.doc_id IS NULL THEN sha256(concat_ws('#', 'fill-1', p.doc_id::VARCHAR)) ELSE '' END, p.ord) AS r
  FROM placed p, (SELECT unnest(['train80', 'eval20']) AS side) s LEFT JOIN gd g ON g.side = s.side AND g.doc_id = p.doc_id LEFT JOIN nd n ON n.side = s.side AND n.doc_id = p.doc_id) WHERE r <= 200),
t AS (SELECT * FROM g1 WHERE side = 'train80'), wrong AS (SELECT DISTINCT CASE WHEN query_id % 17 = 4 THEN -1 ELSE doc_id END AS doc_id FROM t),
te AS (SELECT doc_id FROM ch WHERE side = 'eval20'), tt AS (SELECT doc_id FROM ch WHERE side = 'train80')"""
NONE = "SELECT 0 AS detail"
CHECKS = {
    ("coverage", "both"): "SELECT count(*) AS detail FROM t WHERE query_id % 9 = 2",
    ("overlap", "qrels"): NONE,
    ("overlap", "queries"): "SELECT count(*) AS detail FROM t WHERE query_id % 5 = 0",
    ("docids", "train80"): "SELECT count(*) AS detail FROM t WHERE query_id % 17 = 4", ("docids", "eval20"): NONE,
    ("gold_in_ids", "train80"): "SELECT count(*) AS detail FROM wrong WHERE doc_id = -1 OR doc_id % 11 = 5", ("gold_in_ids", "eval20"): NONE,
    ("gold_in_corpus", "train80"): "SELECT count(*) AS detail FROM wrong WHERE doc_id = -1", ("gold_in_corpus", "eval20"): NONE,
    ("qids", "train80"): NONE, ("qids", "eval20"): "SELECT count(*) AS detail FROM t WHERE query_id % 5 = 0",
    ("count", "train80"): NONE, ("count", "eval20"): "SELECT (count(*) > 0)::BIGINT AS detail FROM te WHERE doc_id % 13 = 1",
    ("duplicates", "train80"): NONE, ("duplicates", "eval20"): "SELECT count(*) AS detail FROM te WHERE doc_id % 13 = 1",
    ("ids_are_corpus", "train80"): "SELECT count(*) AS detail FROM tt WHERE doc_id % 11 = 5", ("ids_are_corpus", "eval20"): NONE,
    ("lines", "train80"): NONE, ("lines", "eval20"): "SELECT count(*) AS detail FROM te WHERE doc_id % 7 = 3",
}
FILES: dict[tuple, tuple] = {}
SUBSET_PLAN = validator.Plan({"train80": 200, "eval20": 200}, (2, 2), 0)


def source(s, d) -> validator.Source:
    """All documents as JSON lines, the items as queries in three splits, one gold document for each that has one."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("line_no"), F.to_json(F.struct(F.col("doc_id").alias("id"), "text")).alias("value"))
    asked = table(s, d, "benchmark").select(F.concat(F.lit("dev"), (F.col("item_id") % 3).cast("string")).alias("split"), F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    first = qrels(s, d).groupBy(F.col("item_id").cast("string").alias("query_id")).agg(F.min("doc_id").cast("string").alias("doc_id"))
    return validator.Source(docs, asked, asked.join(first, "query_id", "left").select("split", "query_id", F.coalesce("doc_id", F.lit("none")).alias("doc_id")))


def planted(s, d) -> tuple[str, validator.Source]:
    """The folder of a subset with faults in its files, written once for each state of the tables."""
    key = (s.sparkContext.applicationId, version(s, f"{d}/documents.parquet"), version(s, f"{d}/benchmark.parquet"))
    if key not in FILES:
        good, bad, src = table_path(s, "subset"), table_path(s, "planted"), source(s, d)
        validator.build(s, good, src, SUBSET_PLAN)

        def copy(name: str, change=lambda df: df, by: str | None = None) -> None:
            rows = change(trec.read_lines_by(s, f"{good}/{name}", by) if by else s.read.text(f"{good}/{name}"))
            (rows.write.partitionBy(by) if by else rows.write).mode("overwrite").text(f"{bad}/{name}")

        num = lambda c, n: F.coalesce(c.try_cast("long") % n, F.lit(-1))
        of = F.get_json_object("value", "$.id")
        qid = F.split("value", " ")[0]
        changes = {
            "train80/ids": lambda df: df.filter(num(F.col("value"), 11) != 5),
            "train80/qrels": lambda df: df.withColumn("value", F.when(num(qid, 17) == 4, F.concat(qid, F.lit(" 0 none 1"))).otherwise(F.col("value"))),
            "train80/qrels_by_split": lambda df: df.filter(num(qid, 9) != 2),
            "eval20/corpus": lambda df: df.withColumn("value", F.when(num(of, 7) == 3, F.concat("value", F.lit(" "))).otherwise(F.col("value"))).withColumn("n", F.explode(F.sequence(F.lit(0), F.when(num(of, 13) == 1, 1).otherwise(0)))).drop("n"),
            "eval20/queries": lambda df: df.union(s.read.text(f"{good}/train80/queries").filter(num(F.get_json_object("value", "$.query_id"), 5) == 0)),
        }
        for side in validator.SIDES:
            for k in validator.paths("", side):
                copy(f"{side}/{k}", changes.get(f"{side}/{k}", lambda df: df), "split" if k.endswith("by_split") else None)
        copy("missing")
        FILES[key] = good, bad, saved(validator.validate(s, bad, src, SUBSET_PLAN), "report")
    return FILES[key]


def check(name: str) -> None:
    rows = " UNION ALL ".join(f"SELECT '{side}' AS side, detail::BIGINT AS detail FROM ({sql})" for (c, side), sql in CHECKS.items() if c == name)
    query(based(f", {SQL_FILES} SELECT '{name}' AS \"check\", side, detail = 0 AS ok, detail FROM ({rows})"), f"check_{name}")(lambda s, d: planted(s, d)[2].filter(F.col("check") == name).select("check", "side", "ok", "detail"))


for name_ in dict.fromkeys(c for c, _ in CHECKS):
    check(name_)


@query("SELECT \"check\", side, true AS ok, 0::BIGINT AS detail FROM (VALUES " + ", ".join(f"('{c}', '{side}')" for c, side in CHECKS) + ") x(\"check\", side)")
def validator_report(s, d):
    """The files as they were written pass every check."""
    return validator.validate(s, planted(s, d)[0], source(s, d), SUBSET_PLAN).select("check", "side", "ok", "detail")


@query(based(f", {SQL_FILES} SELECT side, split, query_id::VARCHAR || ' 0 ' || doc_id::VARCHAR || ' 1' AS line FROM g1 SEMI JOIN ch USING (side, doc_id)"))
def qrel_files(s, d):
    """Judgement files by split, read back."""
    good, out = planted(s, d)[0], None
    for side in validator.SIDES:
        part = trec.read_lines_by(s, f"{good}/{side}/qrels_by_split", "split").select(F.lit(side).alias("side"), "split", F.col("value").alias("line"))
        out = part if out is None else out.union(part)
    return out


@query(based(f", {SQL_FILES} SELECT side, count(query_id)::BIGINT AS n, coalesce(string_agg(query_id::VARCHAR, ',' ORDER BY len(query_id::VARCHAR), query_id::VARCHAR), '') AS ids FROM (SELECT unnest(['train80', 'eval20']) AS side) LEFT JOIN (SELECT * FROM g1 SEMI JOIN ch USING (side, doc_id)) USING (side) GROUP BY side"))
def query_files(s, d):
    """Query files in their natural order, read back in the order of their lines."""
    good, out = planted(s, d)[0], None
    for side in validator.SIDES:
        rows = ordered_lines.numbered(s, f"{good}/{side}/queries").select(F.struct("line_no", F.get_json_object("value", "$.query_id").alias("id")).alias("x"))
        part = rows.agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["id"]), ",").alias("ids")).select(F.lit(side).alias("side"), "n", "ids")
        out = part if out is None else out.union(part)
    return out


@query(based(f", {SQL_FILES} SELECT split, query_id::VARCHAR AS query_id, 'none' AS doc_id FROM sides ANTI JOIN g1 USING (query_id)"))
def missing_gold(s, d):
    return jsonl.missing_log(s.read.text(f"{planted(s, d)[0]}/missing"))


@query(based(f", {SQL_FILES} SELECT side, doc_id::VARCHAR AS doc_id FROM ch"))
def id_files(s, d):
    good = planted(s, d)[0]
    one, two = (jsonl.id_list(s.read.text(f"{good}/{side}/ids")).select(F.lit(side).alias("side"), "doc_id") for side in validator.SIDES)
    return one.union(two)


@query(based(
    f", {SQL_FILES}, n1 AS (SELECT side || '_docs' AS part, count(*) AS n FROM ch GROUP BY side UNION ALL SELECT side || '_gold', count(*) FROM gd GROUP BY side "
    "UNION ALL SELECT side || '_queries', count(*) FROM g1 SEMI JOIN ch USING (side, doc_id) GROUP BY side UNION ALL SELECT 'missing', count(*) FROM sides ANTI JOIN g1 USING (query_id)) "
    "SELECT '{' || string_agg('\"' || part || '\":' || coalesce(n, 0)::VARCHAR, ',' ORDER BY part) || '}' AS value FROM "
    "(SELECT unnest(['eval20_docs', 'eval20_gold', 'eval20_queries', 'missing', 'train80_docs', 'train80_gold', 'train80_queries']) AS part) LEFT JOIN n1 USING (part)"
))
def stats_file(s, d):
    return s.read.text(f"{planted(s, d)[0]}/stats")


SWEEP = ["NDCG@10", "NDCG@1000", "R@1000", "MAP", "RR", "F1@10", "success@10"]
SQL_SWEEP = (
    f"{SQL_SUBSET}, runs AS (SELECT 'bm25' AS model, * FROM ({sql_ranked(BM25.format(w='ln(1 + (n_docs - df + 0.5) / (df + 0.5))', part='qtf * w * tf / (tf + ' + long(0.9, 0.4) + ')'))}) UNION ALL "
    f"SELECT 'coord' AS model, * FROM ({sql_ranked('SELECT * FROM coord')}) UNION ALL SELECT 'tfidf' AS model, * FROM ({sql_ranked('SELECT * FROM tfidf')})), "
    "kinds AS (SELECT 'all' AS subset, doc_id FROM documents UNION ALL SELECT 'subset', doc_id FROM fill), "
    "rr AS (SELECT model, item_id, doc_id, row_number() OVER (PARTITION BY model, item_id ORDER BY score DESC, doc_id::VARCHAR DESC) AS rank FROM runs), "
    "jj AS (SELECT model, split, subset, q.item_id, q.doc_id, q.rel, rank, row_number() OVER (PARTITION BY model, subset, q.item_id ORDER BY rank NULLS LAST, q.doc_id) AS hit, row_number() OVER (PARTITION BY model, subset, q.item_id ORDER BY rel DESC, q.doc_id) AS ideal "
    "FROM (SELECT * FROM qrels JOIN kinds USING (doc_id) JOIN sides ON query_id = item_id, (SELECT unnest(['bm25', 'coord', 'tfidf']) AS model)) q LEFT JOIN rr USING (model, item_id, doc_id)), "
    "per AS (SELECT model, split, subset, item_id, " + ", ".join(f"{sql_measure(*evaluation.parse_metric(x))} AS m{i}" for i, x in enumerate(SWEEP)) + " FROM jj GROUP BY ALL)"
)


def swept(s, d) -> DataFrame:
    c = corpus(s, d, lexical.TOP)
    models = (("bm25", c.bm25("lucene")), ("coord", c.coordination()), ("tfidf", c.tfidf()))
    rows = None
    for model, scores in models:
        part = lexical.ranked(scores).select(F.lit(model).alias("model"), "item_id", "doc_id", "score")
        rows = part if rows is None else rows.union(part)
    rel = qrels(s, d).join(sides(s, d).select("split", F.col("query_id").alias("item_id")), "item_id")
    kinds = table(s, d, "documents").select(F.lit("all").alias("subset"), "doc_id").union(subset(s, d).select(F.lit("subset").alias("subset"), "doc_id"))
    return evaluation.sweep(rel, saved(rows, "runs"), kinds, SWEEP)


@query(based(SQL_SWEEP + " " + " UNION ALL ".join(f"SELECT model, split, subset, '{x}' AS metric, round(avg(m{i}), 6) AS value FROM per GROUP BY ALL" for i, x in enumerate(SWEEP))))
def eval_sweep(s, d):
    return swept(s, d)


@query(based(SQL_SWEEP + " " + " UNION ALL ".join(f"SELECT {i}::BIGINT AS place, '{x}' || chr(9) || printf('%.3f', round(avg(m{i}), 6)) AS line FROM per WHERE model = 'tfidf' AND split = 'dev0' AND subset = 'all'" for i, x in enumerate(SWEEP))))
def metric_report(s, d):
    return evaluation.report_lines(swept(s, d).filter("model = 'tfidf' and split = 'dev0' and subset = 'all'").select("metric", "value"), SWEEP)


# -- lines ----------------------------------------------------------------------------------------------------------------
@query(based(f", {SQL_RUN.rstrip().rstrip(',')} SELECT item_id, rnk, concat_ws(' ', item_id::VARCHAR, 'Q0', doc_id::VARCHAR, rnk::VARCHAR, printf('%.6f', score), 'tfidf') AS line FROM run"))
def run_lines(s, d):
    return trec.run_lines(tfidf_run(s, d), "tfidf")


LINES = "concat_ws(' ', conv_id::VARCHAR, 'Q0', 'd' || (turn // 2)::VARCHAR, CASE WHEN turn % 5 = 4 THEN 'x' ELSE turn::VARCHAR END, CASE WHEN turn % 7 = 6 THEN 'bad' ELSE (100 - turn)::VARCHAR || '.5' END, 'r')"


def lines(s, d) -> DataFrame:
    c = table(s, d, "conversations")
    t = F.col("turn")
    value = F.concat_ws(
        " ", F.col("conv_id").cast("string"), F.lit("Q0"), F.concat(F.lit("d"), F.floor(t / 2).cast("string")), F.when(t % 5 == 4, "x").otherwise(t.cast("string")),
        F.when(t % 7 == 6, "bad").otherwise(F.concat((100 - t).cast("string"), F.lit(".5"))), F.lit("r"),
    )
    return c.select(value.alias("value"), (F.col("conv_id") * 1000 + t).alias("line_no"))


@query(
    "SELECT query_id, doc_id, rank, score, run_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank, line_no) AS r FROM ("
    f"SELECT f[1] AS query_id, f[3] AS doc_id, coalesce(try_cast(f[4] AS INTEGER), 1000000000) AS rank, coalesce(try_cast(f[5] AS DOUBLE), 0) AS score, f[6] AS run_id, line_no FROM (SELECT string_split({LINES}, ' ') AS f, conv_id * 1000 + turn AS line_no FROM conversations))) WHERE r = 1"
)
def parse_run(s, d):
    return trec.parse_run(lines(s, d))


@query(
    "SELECT query_id, doc_id, rel FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY line_no DESC) AS r FROM ("
    f"SELECT f[1] AS query_id, f[3] AS doc_id, coalesce(try_cast(f[4] AS INTEGER), 1) AS rel, line_no FROM (SELECT string_split({LINES}, ' ') AS f, conv_id * 1000 + turn AS line_no FROM conversations))) WHERE r = 1"
)
def parse_qrels(s, d):
    return trec.parse_qrels(lines(s, d))


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(s, d):
    from quillon.streaming.incremental import event_windows as run

    return run(table(s, d, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(based("SELECT term, doc_id, tf FROM posts"))
def incremental_index(s, d):
    """The same index as tf_postings, built by a stream of files of at most one a batch."""
    from quillon.streaming.incremental import index_files

    out = table_path(s, "stream-index")
    return index_files(s, f"{d}/documents.parquet", out, f"{out}-checkpoint", files=1).select("term", "doc_id", "tf")


SPLIT_LINES = f"SELECT string_split({LINES}, ' ') AS f, conv_id * 1000 + turn AS line_no FROM conversations"


@query(f"SELECT query_id, doc_id FROM (SELECT f[1] AS query_id, f[3] AS doc_id, row_number() OVER (PARTITION BY f[1] ORDER BY line_no DESC) AS r FROM ({SPLIT_LINES})) WHERE r = 1")
def parse_gold(s, d):
    return trec.parse_gold(lines(s, d))


@query(f"SELECT DISTINCT f[1] AS query_id, f[3] AS doc_id FROM ({SPLIT_LINES}) WHERE f[4] <> 'x'")
def parse_relevant(s, d):
    """Lines of exactly four fields; those with a bad rank have five here."""
    four = lines(s, d).withColumn("value", F.regexp_replace("value", r"^(\S+ \S+ \S+) (\S+) .*", "$1 $2"))
    return trec.parse_relevant(four.withColumn("value", F.when(F.col("value").endswith(" x"), F.concat("value", F.lit(" y"))).otherwise(F.col("value"))))


@query(f"SELECT f[1] AS query_id, string_agg(f[3], ',' ORDER BY line_no) AS doc_ids FROM ({SPLIT_LINES}) GROUP BY f[1]")
def grouped_run(s, d):
    return trec.grouped_run(lines(s, d)).select("query_id", F.array_join("doc_ids", ",").alias("doc_ids"))


@query(f"SELECT query_id, doc_id, rank, score FROM (SELECT f[1] AS query_id, f[3] AS doc_id, coalesce(try_cast(f[4] AS INTEGER), 1000000000) AS rank, coalesce(try_cast(f[5] AS DOUBLE), 0) AS score, row_number() OVER (PARTITION BY f[1], f[3] ORDER BY line_no DESC) AS r FROM ({SPLIT_LINES})) WHERE r = 1")
def parse_run_strict(s, d):
    return trec.parse_run(lines(s, d), strict=True).select("query_id", "doc_id", "rank", "score")


@query(based(f", {SQL_RUN.rstrip().rstrip(',')} SELECT item_id::VARCHAR AS query_id, doc_id::VARCHAR AS doc_id, rnk::INTEGER AS rank, score FROM run"))
def run_round_trip(s, d):
    """A run written as gzipped lines with whole scores and read back."""
    path = table_path(s, "run")
    trec.write_run(tfidf_run(s, d), path, "tfidf", gzip=True, digits=None)
    return trec.parse_run(ordered_lines.numbered(s, path)).select("query_id", "doc_id", "rank", "score")


def awkward(s, d) -> DataFrame:
    """All documents as JSON lines: every ninth is cut off, every seventh has no id, every fifth no title, every third an id under doc_id."""
    t, i = table(s, d, "documents"), F.col("doc_id")
    whole = F.to_json(F.struct(
        F.when((i % 7 != 3) & (i % 3 != 0), i.cast("string")).alias("id"), F.when((i % 7 != 3) & (i % 3 == 0), i.cast("string")).alias("doc_id"),
        F.when(i % 5 != 1, F.col("source")).alias("title"), F.when(i % 4 != 2, F.col("text")).alias("text"),
    ))
    return t.withColumn("value", whole).select(F.when(i % 9 == 4, F.expr("substring(value, 1, length(value) - 1)")).when(i % 31 == 6, "  ").otherwise(F.col("value")).alias("value"))


def sql_form(form: str, by: str, text: str, keep: str = "true") -> str:
    return f"SELECT '{form}' AS form, {by} AS doc_id, sha256({text}) AS hash, len({text})::BIGINT AS n FROM l WHERE {by} IS NOT NULL AND {keep}"


FORM_TEXT = "regexp_replace(coalesce(title, '') || {sep} || coalesce(text, ''), '^\\s+|\\s+$', '', 'g')"
TITLED = "concat_ws(chr(10), nullif(trim(coalesce(title, '')), ''), nullif(trim(coalesce(text, '')), ''))"


@query(
    "WITH l AS (SELECT CASE WHEN doc_id % 7 <> 3 AND doc_id % 3 <> 0 THEN doc_id::VARCHAR END AS id, CASE WHEN doc_id % 7 <> 3 THEN doc_id::VARCHAR END AS any_id, CASE WHEN doc_id % 5 <> 1 THEN source END AS title, CASE WHEN doc_id % 4 <> 2 THEN text END AS text FROM documents WHERE doc_id % 9 <> 4 AND doc_id % 31 <> 6) "
    + " UNION ALL ".join((
        sql_form("titled", "id", TITLED), sql_form("plain", "id", "coalesce(text, '')"), sql_form("spaced", "id", FORM_TEXT.format(sep="' '")),
        sql_form("strict", "any_id", FORM_TEXT.format(sep="chr(10)"), f"{FORM_TEXT.format(sep='chr(10)')} <> ''"),
    ))
)
def corpus_forms(s, d):
    """Documents read from JSON lines on disk in all four forms."""
    path, out = table_path(s, "corpus"), None
    awkward(s, d).write.option("compression", "gzip").text(path)
    for form in jsonl.FORMS:
        part = jsonl.documents(ordered_lines.numbered(s, path), form).select(F.lit(form).alias("form"), "doc_id", F.sha2("text", 256).alias("hash"), F.length("text").cast("long").alias("n"))
        out = part if out is None else out.union(part)
    return out


@query("SELECT conv_id::VARCHAR AS query_id, coalesce(nullif(arg_max(text, turn), ''), '') AS query FROM conversations WHERE turn % 4 <> 3 GROUP BY conv_id")
def read_queries(s, d):
    """Queries under changing field names, several lines an id, with lines that are cut off."""
    c, t = table(s, d, "conversations"), F.col("turn")
    key, text = F.col("conv_id").cast("string"), F.col("text")
    at = lambda k, v, n: F.when(t % 3 == k, v).alias(n)
    value = F.to_json(F.struct(at(0, key, "query_id"), at(1, key, "qid"), at(2, key, "id"), at(0, text, "query"), at(1, text, "text"), at(2, text, "title")))
    rows = c.select((F.col("conv_id") * 1000 + t).alias("line_no"), F.when(t % 4 == 3, F.substring(value, 1, 9)).otherwise(value).alias("value"))
    return jsonl.queries(rows)


@query(based("SELECT 'dev' || (item_id % 3)::VARCHAR AS split, item_id, pos::BIGINT AS pos, term, round(1 - 0.05 * pos, 6) AS weight FROM red"))
def improved_queries(s, d):
    """Keyword queries in a file for each split, read back with the split from the file's name."""
    b, base = table(s, d, "benchmark"), table_path(s, "improved")
    k = lexical.reduced(b).groupBy("item_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "term", "weight"))), lambda x: F.struct(x["term"].alias("term"), x["weight"].alias("weight"), F.array(F.lit("x")).alias("extra"))).alias("keywords"))
    for i in range(3):
        k.filter(F.col("item_id") % 3 == i).select(F.col("item_id").alias("id"), "keywords").write.json(f"{base}/eval20-queries-dev{i}_improved_queries.jsonl")
    return jsonl.improved_queries(s, f"{base}/*").select("split", "item_id", F.col("pos").cast("long").alias("pos"), "term", F.round("weight", 6).alias("weight"))


@query("SELECT doc_id, lang, source, n_chars, sha256(text) AS hash FROM documents")
def jsonl_round_trip(s, d):
    path = table_path(s, "jsonl")
    jsonl.write_jsonl(table(s, d, "documents"), path)
    return jsonl.read_jsonl(s, path, "doc_id long, text string, lang string, source string, n_chars long").select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("hash"))


@query("SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS place, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def embedding_shards(s, d):
    """Vectors written in shards of bounded files and read back; shards by number."""
    path = table_path(s, "shards")
    shards.write_shards(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), path, shards=12, per_file=100)
    rows = shards.read_shards(s, path).select("id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))
    return ordered_lines.ordinals(rows, "id", name="place").select("id", "place", "total")


@query("SELECT 'shard' || lpad(i::VARCHAR, 2, '0') AS dir, i AS number, row_number() OVER (ORDER BY i) AS place FROM (SELECT DISTINCT vec_id % 12 AS i FROM embeddings)")
def shard_order(s, d):
    """Shard folders by the number at their end, not as text."""
    names = table(s, d, "embeddings").select(F.concat(F.lit("/x/shard"), F.lpad((F.col("vec_id") % 12).cast("string"), 2, "0"), F.lit("/emb.npy")).alias("path")).distinct()
    rows = names.select(F.element_at(F.split("path", "/"), -2).alias("dir"), shards.shard_number("path").alias("number"))
    return ordered_lines.ordinals(rows, "number").select("dir", "number", (F.col("ord") + 1).alias("place"))


@query("WITH p AS (SELECT label, (vec_id % 4 <> 0)::INTEGER AS m, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, dim, round(sum(x * m) / greatest(sum(m), 1), 6) + 0.0 AS value FROM p GROUP BY ALL")
def masked_mean_vectors(s, d):
    e = table(s, d, "embeddings").select("label", (F.col("vec_id") % 4 != 0).cast("int").alias("mask"), F.col("embedding").alias("v"))
    return dense.masked_mean(e, "label").withColumn("value", F.col("value") + 0.0)


@query(based(sql_ranked("SELECT * FROM tfidf", 20)))
def without_padding(s, d):
    """A run padded to a fixed length with rows of no document and of no score."""
    run = lexical.ranked(corpus(s, d, lexical.TOP).tfidf(), 20)
    ids = run.select("item_id").distinct()
    pad = ids.select("item_id", F.lit(-1).cast("long"), F.lit(21).cast("long"), F.lit(0.0)).union(ids.select("item_id", F.lit(5).cast("long"), F.lit(22).cast("long"), F.lit(float("-inf"))))
    return dense.without_padding(run.union(pad))


@query(f"SELECT doc_id, len(w[1:256])::BIGINT AS n, md5(array_to_string(w[1:256], ' ')) AS hash FROM (SELECT doc_id, {sql_words('text')} AS w FROM documents)")
def truncated_words(s, d):
    return chunking.truncated(table(s, d, "documents")).select("doc_id", F.size("words").cast("long").alias("n"), F.md5(F.array_join("words", " ").cast("binary")).alias("hash"))


@query("SELECT doc_id + 1 AS doc_id FROM documents")
def guarded_ids(s, d):
    return index.guarded(table(s, d, "documents").select((F.col("doc_id") + 1).alias("doc_id")))


@query("SELECT item_id, row_number() OVER (ORDER BY len(item_id::VARCHAR), item_id::VARCHAR) - 1 AS place FROM benchmark")
def natural_order(s, d):
    t = table(s, d, "benchmark").select("item_id", F.length(F.col("item_id").cast("string")).alias("a"), F.col("item_id").cast("string").alias("b"))
    return ordered_lines.ordinals(t, "a", "b", name="place").select("item_id", "place")


@query("SELECT source, count(*) AS detail, array_to_string(list_sort(list(doc_id::VARCHAR))[1:20], ',') AS sample FROM documents GROUP BY source")
def sampled_ids(s, d):
    rows = table(s, d, "documents").select("source", F.col("doc_id").cast("string").alias("id"))
    return validator.sampled(rows, ["source"], "id").select("source", "detail", F.array_join("sample", ",").alias("sample"))


@query("SELECT page_id, regexp_extract(url, '([^/]*?)(\\.[^./]*)?$', 1) AS stem FROM pages")
def filename_stem(s, d):
    return table(s, d, "pages").select("page_id", F.regexp_extract("url", r"([^/]*?)(\.[^./]*)?$", 1).alias("stem"))


@query(based("SELECT term, doc_id, tf FROM posts"))
def zipped_postings(s, d):
    """Parallel arrays of documents and frequencies, put together by place."""
    p = index.postings(table(s, d, "documents")).groupBy("term").agg(F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("x"))
    p = p.select("term", F.col("x.doc_id").alias("doc_ids"), F.col("x.tf").alias("tfs"))
    return p.select("term", F.explode(F.arrays_zip("doc_ids", "tfs")).alias("z")).select("term", F.col("z.doc_ids").alias("doc_id"), F.col("z.tfs").alias("tf"))


def sql_treebank(text: str) -> str:
    found = text
    for i, (pattern, out) in enumerate(TREEBANK):
        found = f"(' ' || {found} || ' ')" if i == ENDINGS else found
        found = f"regexp_replace({found}, {chr(39)}{pattern.replace(chr(39), chr(39) * 2)}{chr(39)}, {chr(39)}{out.replace(chr(39), chr(39) * 2).replace('$', chr(92))}{chr(39)}, 'g')"
    return f"list_filter(regexp_split_to_array({found}, '\\s+'), lambda x: x <> '')"


@query(f"SELECT doc_id, len(w)::BIGINT AS n, md5(array_to_string(w, ' ')) AS hash FROM (SELECT doc_id, {sql_treebank('text')} AS w FROM documents)")
def treebank_tokens(s, d):
    return table(s, d, "documents").select("doc_id", treebank("text").alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("hash"))


SQL_STEM = (
    "CASE WHEN regexp_matches(term, '(ss|us|is)$') THEN term WHEN regexp_matches(term, 'ies$') AND len(term) > 4 THEN regexp_replace(term, 'ies$', 'y') WHEN regexp_matches(term, '(ch|sh|x|s|z)es$') THEN regexp_replace(term, 'es$', '') "
    "WHEN regexp_matches(term, '[a-z]{3,}ing$') THEN regexp_replace(term, 'ing$', '') WHEN regexp_matches(term, '[a-z]{3,}ed$') THEN regexp_replace(term, 'ed$', '') WHEN regexp_matches(term, '[^s]s$') AND len(term) > 3 THEN regexp_replace(term, 's$', '') ELSE term END"
)


@query(based(f"SELECT stem, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, {SQL_STEM} AS stem FROM toks) GROUP BY stem"))
def stemmed_terms(s, d):
    """Terms after the light stemmer; no table of lemmas is at hand."""
    p = index.postings(table(s, d, "documents"), "stem")
    return p.groupBy(F.col("term").alias("stem")).agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query()
def bm25_english(s, d):
    """Lucene's BM25 over its English analysis: no possessives, its stop words, Porter stems."""
    path = table_path(s, "index")
    index.write_index(table(s, d, "documents"), path, "english")
    return lexical.ranked(lexical.Lexical(index.read_index(s, path), table(s, d, "benchmark"), "english", lexical.TOP).bm25("lucene"))


@query("SELECT (r - 1) // 25 AS part, count(*) AS n, 'Queries:' || chr(10) || string_agg(item_id::VARCHAR || chr(9) || text, chr(10) ORDER BY r) AS prompt FROM (SELECT *, row_number() OVER (ORDER BY item_id) AS r FROM benchmark) GROUP BY ALL")
def prompt_groups(s, d):
    return jsonl.prompts(ordered_lines.ordinals(table(s, d, "benchmark"), "item_id"), "Queries:")


@query("SELECT source || doc_id::VARCHAR AS key, CASE WHEN doc_id % 6 = 5 THEN 'none' WHEN doc_id % 4 = 1 THEN 'new ' || lang ELSE lang END AS value FROM documents")
def key_value(s, d):
    """Two writes, the second over part of the first, and a lookup of all keys with a default."""
    kv, i = jsonl.KeyValue(s, table_path(s, "kv")), F.col("doc_id")
    t = table(s, d, "documents").select(F.concat("source", i.cast("string")).alias("key"), F.col("lang").alias("value"), F.lit(0).alias("order"), "doc_id")
    kv.put(t.filter(i % 6 != 5).select("key", "value", "order"))
    again = t.filter((i % 4 == 1) & (i % 6 != 5))
    kv.put(again.select("key", F.lit("older").alias("value"), "order").union(again.select("key", F.concat(F.lit("new "), "value"), F.lit(1))))
    return kv.get(t.select("key"), "none")


SQL_BOW = (
    f"WITH c AS ({sql_windows(100, 50)}), w AS (SELECT doc_id, chunk_index, n_words, unnest({sql_words('chunk')}) AS t FROM c), "
    "v AS (SELECT doc_id, chunk_index, any_value(n_words) AS n, ('0x' || substr(md5(t), 1, 4))::BIGINT % 64 AS dim, count(*)::DOUBLE AS x FROM w GROUP BY doc_id, chunk_index, dim), "
    "z AS (SELECT doc_id, sum(n) AS n FROM (SELECT doc_id, chunk_index, any_value(n_words) AS n FROM c GROUP BY ALL) GROUP BY doc_id), "
    "m AS (SELECT v.doc_id, dim, sum(x * v.n) / greatest(any_value(z.n), 1) AS x FROM v JOIN z USING (doc_id) GROUP BY ALL) "
    "SELECT doc_id, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS value FROM m"
)


@query(SQL_BOW)
def encoded_documents(s, d):
    """Passages through the encoder hook, their vectors weighted by words to one a document; zero components are left out."""
    v = dense.encoded(chunking.windows(table(s, d, "documents"), 100, 50), dense.hashed)
    return dense.weighted_mean(v, "doc_id", "n_words").filter("value <> 0")


@query(
    "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, vec_id // 16 AS batch FROM embeddings), "
    "p AS (SELECT q.batch, q.vec_id AS a, r.vec_id AS b, list_inner_product(q.e, r.e) / sqrt(list_inner_product(q.e, q.e)) / sqrt(list_inner_product(r.e, r.e)) AS s "
    "FROM v q JOIN (SELECT x.vec_id, x.batch, y.e FROM v x JOIN v y ON y.vec_id = x.vec_id + CASE WHEN x.vec_id % 2 = 0 THEN 1 ELSE -1 END) r USING (batch)), "
    "l AS (SELECT batch, a, ln(sum(exp(s))) - sum(CASE WHEN a = b THEN s ELSE 0 END) AS loss FROM p GROUP BY ALL) SELECT batch, count(*) AS n, round(avg(loss), 6) AS loss FROM l GROUP BY batch"
)
def contrastive_loss(s, d):
    """Each vector as a query, its neighbour in the pair as its passage, batches of 16."""
    e = table(s, d, "embeddings")
    pair = e.select((F.col("vec_id") + F.when(F.col("vec_id") % 2 == 0, 1).otherwise(-1)).alias("ord"), F.col("embedding").alias("p"))
    return dense.contrastive_loss(e.select(F.col("vec_id").alias("ord"), F.col("embedding").alias("q")).join(pair, "ord"), 16)
