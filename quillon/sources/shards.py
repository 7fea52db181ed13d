"""Embedding shards: parquet written by the engine, and .npy matrices with .txt ids read from elsewhere."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shard_number(path: str | Column) -> Column:
    """The number at the end of the folder shard<digits> in a path; null elsewhere."""
    return F.nullif(F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"/shard0*(\d+)/[^/]*$", 1), F.lit("")).cast("long")


def write_shards(vectors: DataFrame, path: str, shards: int, per_file: int = 50_000) -> None:
    """vectors(id, v) as parquet in folders shard<n>, n by a hash of the id, files of at most `per_file` rows."""
    rows = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    for_each = rows.withColumn("dir", F.format_string("shard%02d", "shard")).repartition("shard")
    for_each.drop("shard").write.mode("overwrite").option("maxRecordsPerFile", per_file).partitionBy("dir").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, id, v) of write_shards()."""
    return spark.read.parquet(path).select(F.regexp_extract("dir", r"(\d+)$", 1).cast("long").alias("shard"), "id", "v")


def read_npy(spark: SparkSession, path: str, grouped: bool = True) -> DataFrame:
    """(shard, id, v) of pairs <name>.npy and <name>.txt: a row of the matrix and a line of the text each.

    grouped: only pairs in folders shard<digits>, with their number; otherwise all pairs, without one. Files without
    a partner are left out; a pair of unequal length fails. The matrix of a pair is read by one task.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    name = lambda ext: files.filter(F.col("path").endswith(ext)).select(F.expr(f"substring(path, 1, length(path) - {len(ext)})").alias("name"), F.col("content").alias(ext[1:]))
    pairs = name(".npy").join(name(".txt"), "name").select(shard_number(F.concat("name", F.lit(".npy"))).alias("shard"), "name", "npy", "txt")
    pairs = pairs.filter("shard is not null") if grouped else pairs.withColumn("shard", F.lit(None).cast("long"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, where, npy, txt in zip(*(batch.column(c).to_pylist() for c in ("shard", "name", "npy", "txt"))):
                v, ids = np.load(io.BytesIO(npy), allow_pickle=False).astype(np.float32), [int(x) for x in txt.split()]
                if v.ndim != 2 or len(v) != len(ids):
                    raise ValueError(f"{where}: {v.shape} vectors for {len(ids)} ids")
                for i in range(0, len(ids), 10_000):
                    part = v[i : i + 10_000]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * v.shape[1]), pa.array(part.ravel()))
                    yield pa.record_batch([pa.array([shard] * len(part), pa.int64()), pa.array(ids[i : i + 10_000], pa.int64()), lists], ["shard", "id", "v"])

    return pairs.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(parse, "shard long, id long, v array<float>")
