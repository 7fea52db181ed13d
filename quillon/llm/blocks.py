"""Helpers shared by the operators that work on Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from quillon.session import discard, saved

MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_join(rows: DataFrame, held: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Each of rows with the one row that held has for its keys (left join), where one key may have any share of rows.

    Rows are split by a hash of column `by`; held's row goes once to every part that a key has. rows is read
    twice, so it should be a written table.
    """
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(partitions(rows.sparkSession))))
    spread = rows.select(*keys, "_part").distinct().join(held, keys)
    return rows.join(spread, [*keys, "_part"], "left").drop("_part")


def remainder(key: str, n: int):
    """crc32 of the key's text form, modulo n."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX[0]
    x ^= x >> np.uint64(27)
    x *= MIX[1]
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Whole texts as bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], text: str, key: str, most: int = 4 << 20) -> Iterator[tuple[list, list[bytes]]]:
    """Keys and whole texts in runs of about `most` bytes, so that memory follows a run and its longest text only."""
    keys, texts, held = [], [], 0
    for batch in batches:
        for k, t in zip(batch.column(key).to_pylist(), utf8(batch.column(text))):
            keys.append(k)
            texts.append(t)
            held += len(t)
            if held >= most:
                yield keys, texts
                keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


def trimmed(run: Callable) -> Callable:
    """run for mapInArrow, after which the worker, which waits for its next task, gives free memory back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return wrapped


def narrow(x: np.ndarray) -> bytes:
    """Integers from their least value on, in as few bytes as the widest needs."""
    if not len(x):
        return b""
    low = int(x.min())
    top = int(x.max()) - low
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max)
    return np.array([low, np.dtype(kind).itemsize], np.int64).tobytes() + (x - low).astype(kind).tobytes()


def wide(blob: bytes | memoryview) -> np.ndarray:
    if not len(blob):
        return np.zeros(0, np.int64)
    low, size = np.frombuffer(blob, np.int64, 2)
    return np.frombuffer(blob, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[int(size)], -1, 16).astype(np.int64) + low


def bundle(*columns: np.ndarray) -> bytes:
    """Arrays of integers as one value."""
    parts = [narrow(c) for c in columns]
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def unbundle(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    ends = 8 * (n + 1) + np.cumsum(np.r_[0, np.frombuffer(blob, np.int64, n, 8)])
    view = memoryview(blob)
    return [wide(view[a:b]) for a, b in zip(ends, ends[1:])]


def judged(judge: Callable[[list[bytes]], list[tuple]], carry: list[str], types: list[pa.DataType], names: list[str], most: int = 1 << 20) -> Callable:
    """For mapInArrow: the columns `carry` of every row, then what judge() says of its text; it gets texts of about `most` bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column("text").cast(pa.large_binary()), []
            sizes = np.zeros(len(texts), np.int64) if not len(texts) else pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            total, a = np.cumsum(sizes), 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
                found += judge([b"" if x is None else x for x in texts.slice(a, b - a).to_pylist()])
                a = b
            columns = [pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * len(types), types)]
            yield pa.record_batch([*(batch.column(c) for c in carry), *columns], [*carry, *names])

    return run


def carried(docs: DataFrame, carry: list[str], more: str) -> StructType:
    """Columns of docs and more of them as a schema; a name that is in both is an error."""
    fields = [f"{f.name}" for f in StructType.fromDDL(more)]
    if clash := set(fields) & set(carry):
        raise ValueError(f"columns {sorted(clash)} are made here and cannot be carried")
    return StructType([docs.schema[c] for c in carry] + StructType.fromDDL(more).fields)


def deltas(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted 64-bit numbers, at least one, in a form that packs well."""
    step = np.diff(values)
    return values[:1].view(np.int64), (step & np.uint64(0xFFFFFFFF)).view(np.int64), (step >> np.uint64(32)).view(np.int64)


def summed(packed: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The numbers of deltas()."""
    first, low, high = (x.view(np.uint64) for x in packed)
    return np.cumsum(np.r_[first, low | (high << np.uint64(32))], dtype=np.uint64)


def sliced(order_by: np.ndarray) -> Iterator[tuple[int, slice]]:
    """From sorted numbers: each one that occurs, and where."""
    first = np.flatnonzero(np.r_[True, order_by[1:] != order_by[:-1]]) if len(order_by) else np.zeros(0, np.int64)
    for a, b in zip(first, np.r_[first[1:], len(order_by)]):
        yield int(order_by[a]), slice(int(a), int(b))


def bucket_of(ids: np.ndarray, parts: int) -> np.ndarray:
    """The task of `parts` that holds a document."""
    return (mixed(ids.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Merge (values, counts) pairs: sorted distinct values, summed counts."""
    if len(parts) == 1:
        return parts[0]
    v, c = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(v, kind="stable")
    v, c = v[order], c[order]
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, np.int64)
    return v[first], np.add.reduceat(c, first) if len(v) else c


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) long pairs: (id, component), component the smallest id.

    Alternates taking each vertex's least neighbour with jumping to that neighbour's own label.
    Every round is a written table; nothing but one changed-row count reaches the driver.
    """
    turned = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")
    both = saved(edges.filter("a <> b").select(turned).select("p.a", "p.b").distinct(), "edges")
    if both.isEmpty():
        return both.select(F.col("a").alias("id"), F.col("b").alias("component"))
    label = saved(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(label, both.b == label.id).groupBy(F.col("a").alias("v")).agg(F.min("component").alias("m"))
        step = label.join(near, label.id == near.v, "left").select("id", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        up = label.select(F.col("id").alias("u"), F.col("component").alias("up"))
        fresh = saved(step.join(up, step.c == up.u, "left").select("id", F.least("c", "up").alias("component"), (F.least("c", "up") < F.col("old")).alias("moved")), "labels")
        moved = fresh.filter("moved").limit(1).count()
        discard(label)
        label = fresh.select("id", "component")
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    discard(both)
    return label
