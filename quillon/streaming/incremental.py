"""Incremental indexing and running top-k with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from quillon.operators.index import postings
from quillon.operators.lexical import ranked


def index_stream(docs: DataFrame, out: str, checkpoint: str) -> None:
    """Adds the postings of every new file of a streaming docs(doc_id, text) to out/batch=<id>, then returns.

    A batch is written over its own folder, so that one that is repeated after a failure counts once. A later call
    with the same checkpoint goes on where the last one ended.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        postings(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def index_files(spark: SparkSession, path: str, out: str, checkpoint: str, schema: str = "doc_id long, text string", files: int | None = None) -> DataFrame:
    """Streams a parquet table, one file or a folder of them, `files` of them in a batch at most; the postings of all batches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    where, glob = (path, "*.parquet") if folder else path.rsplit("/", 1)
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    index_stream((reader.option("maxFilesPerTrigger", files) if files else reader).parquet(where), out, checkpoint)
    return spark.read.parquet(out)


def running_topk(scores: DataFrame, state: str, checkpoint: str, k: int) -> None:
    """Keeps the best k of every query over a stream of (item_id, doc_id, score): state/batch=<id> merges the one before.

    The state of a batch and the one before it are kept, which is what a repeated batch needs.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("item_id", "doc_id", "score")
        if batch_id:
            rows = rows.union(spark.read.parquet(f"{state}/batch={batch_id - 1}").select("item_id", "doc_id", "score"))
        best = rows.groupBy("item_id", "doc_id").agg(F.max("score").alias("score"))
        ranked(best, k).write.mode("overwrite").parquet(f"{state}/batch={batch_id}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/batch={batch_id - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    scores.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums of events(ts, event_type, value) by tumbling window; for batch and streaming frames."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )
