"""From raw documents to a weighted training mixture: five stages, each on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each to the shared folder and reads
it again. All stages but the last return the columns of documents. Rows with a null doc_id go in the first stage, as no
id names them in the decisions that follow. Rows that repeat a doc_id are copies of one document: the second stage
keeps one of them, that with the least MD5 of its text, so that ids are unique from there on. Null texts have no
language and go; so do empty ones. An empty table gives an empty result.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from quillon.llm.blocks import remainder
from quillon.llm.decontam import contaminated
from quillon.llm.jaccard import jaccard_links
from quillon.llm.langid import UNKNOWN, languages
from quillon.llm.mixing import mixture
from quillon.llm.pii import masked, with_spans
from quillon.session import saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: without a letter, or with too few 3-grams of the learned languages."""
    found = languages(docs, remainder("doc_id", 4) != 2, carry=tuple(COLUMNS))
    return found.filter((F.col("lang_pred") != UNKNOWN) & F.col("fits") & F.col("doc_id").isNotNull()).select(COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group, and one row of an id that repeats."""
    kept = saved(jaccard_links(docs).filter("doc_id = component_id").select("doc_id"), "kept")
    again = saved(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "again")
    if not again.isEmpty():
        many = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"), *(c for c in COLUMNS[1:]))).alias("r"))
        docs = docs.join(again, "doc_id", "left_anti").select(COLUMNS).union(many.select("doc_id", *(f"r.{c}" for c in COLUMNS[1:])))
    return docs.join(kept, "doc_id", "left_semi").select(COLUMNS)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=tuple(COLUMNS))
    return found.filter("not contaminated").select(COLUMNS)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the kind of personal data in its place; n_chars follows the new text."""
    return masked(with_spans(docs)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the mixture: the documents that are in it, how often, their source's weight and their place."""
    drawn = mixture(docs).filter("copies > 0").select("doc_id", "weight", "block", "ahead", "copies")
    return docs.select(COLUMNS).join(drawn, "doc_id")


STAGES = [
    ("language_id", identified),
    ("near_duplicates", one_of_each),
    ("decontamination", clean_of_benchmark),
    ("personal_data", without_pii),
    ("mixing", mixed_sources),
]

# Language identification and latent retrieval have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
