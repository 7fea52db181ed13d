"""WARC records and a Merkle audit of their replicas, with built-in functions only.

Records lie in files of up to `per_file` slots, in the order of their key; a leaf is the SHA-256 of a record's
bytes with its file and offset range, and a node that of its children's ranges and hashes, 16 children at most. Each level
is a stored table made from the one below. Two replicas are compared from the root down: a node's children are
looked at only where the node differs, so that equal branches cost one comparison, and a differing leaf is a
record's byte range in its file.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from quillon.session import saved

FILE_BITS, FAN_BITS = 9, 4
# The faults that the query plants in its replica, by page_id.
CHANGED, ZEROED, LOST = (97, 13), (193, 7), (389, 11)


def warc_records(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) as WARC resource records: slot, record (text), start, end in its file, file.

    Null url or html is empty. Rows with a null page_id have no slot and are left out; rows that repeat a
    page_id keep the least (url, html) one. Other columns are ignored.
    """
    p = pages.filter("page_id is not null").groupBy("page_id").agg(F.min(F.struct(F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))).alias("r"))
    m = F.md5(F.col("page_id").cast("string"))
    uuid = F.concat_ws("-", *(F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(">\r\nWARC-Target-URI: "), F.col("r.url"),
        F.lit("\r\nContent-Type: text/html\r\nWARC-Block-Digest: sha256:"), F.sha2("r.html", 256), F.lit("\r\nContent-Length: "), F.octet_length("r.html").cast("string"),
        F.lit("\r\n\r\n"), F.col("r.html"), F.lit("\r\n\r\n"),
    )
    return placed(p.select(F.col("page_id").cast("long").alias("slot"), F.shiftright(F.col("page_id").cast("long"), FILE_BITS).alias("file"), record.alias("record")))


def placed(records: DataFrame) -> DataFrame:
    """records(slot, file, record, ...) with start and end, one behind the other in each file."""
    size = F.octet_length("record").cast("long")
    end = F.sum(size).over(Window.partitionBy("file").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    return records.withColumn("end", end).withColumn("start", F.col("end") - size).select("slot", "file", "start", "end", "record")


def write_warc(records: DataFrame, path: str) -> None:
    """One WARC file for each value of file: the text sink ends a record with its own last newline."""
    ordered = records.repartition("file").sortWithinPartitions("file", "slot")
    ordered.select("file", F.expr("substring(record, 1, length(record) - 1)").alias("value")).write.partitionBy("file").text(path)


def members(data: bytes) -> tuple[bytes, int]:
    """The bytes of a file, of all members if it is compressed, and 1 if the last member is broken."""
    if data[:2] != b"\x1f\x8b":
        return data, 0
    out = []
    while data:
        one = zlib.decompressobj(wbits=31)
        try:
            out.append(one.decompress(data) + one.flush())
        except zlib.error:
            return b"".join(out), 1
        if not one.eof:
            return b"".join(out), 1
        data = one.unused_data.lstrip(b"\0")
    return b"".join(out), 0


def records_in(data: bytes) -> Iterator[tuple[int, int, str, bytes] | None]:
    """(start, end, uri, block) of each record of a file; None for each stretch that is no record.

    A record starts with WARC/, has headers up to an empty line and a Content-Length that is a number and inside the
    file. Reading goes on at the next WARC/ that begins a line.
    """
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        stop = -1
        if data.startswith(b"WARC/", at) and head >= 0:
            fields = {k.strip().lower(): v.strip() for k, v in (line.split(b":", 1) for line in data[at:head].split(b"\r\n")[1:] if b":" in line)}
            size = fields.get(b"content-length", b"")
            stop = head + 4 + int(size) if size.isdigit() and len(size) < 16 else -1
        if 0 <= stop <= len(data):
            end = stop
            while data.startswith(b"\r\n", end):
                end += 2
            yield at, end, fields.get(b"warc-target-uri", b"").decode(errors="replace"), data[head + 4 : stop]
            at = end
        else:
            yield None
            at = data.find(b"\nWARC/", at + 1) + 1 or len(data)


def read_warc(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Records of WARC files below path, plain or gzip: file, start, end, uri, block (bytes), malformed.

    Each stretch of a file that is no record is one row with a null block and malformed 1; offsets are those of the
    plain bytes. A task holds one file at a time.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data, broken = members(content.as_py())
                out = [(name, None, None, None, None, 1)] * broken
                for r in records_in(data):
                    out.append((name, *r, 0) if r else (name, None, None, None, None, 1))
                    if len(out) == 1000:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], COLUMNS)
                        out = []
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], COLUMNS)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInArrow(parse, "file string, start long, end long, uri string, block binary, malformed int")


COLUMNS = ["file", "start", "end", "uri", "block", "malformed"]
TYPES = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int32())


def compressed(records: list[bytes]) -> bytes:
    """Records as members of a gzip file, one each."""
    return b"".join(gzip.compress(r, mtime=0) for r in records)


def leaves(records: DataFrame) -> DataFrame:
    return records.select(F.col("slot").alias("node"), "file", "start", "end", F.sha2("record", 256).alias("hash"))


def height(*trees: DataFrame) -> int:
    """Levels between the leaves and the root, from the widest slot on any side, of any sign."""
    ends = [x for t in trees for x in t.agg(F.min("node"), F.max("node")).first() if x is not None]
    levels = 1
    while ends and not {x >> FAN_BITS * levels for x in ends} <= {-1, 0} and len({x >> FAN_BITS * levels for x in ends}) > 1:
        levels += 1
    return levels


def tree(leaf: DataFrame, levels: int) -> list[DataFrame]:
    """Stored tables of nodes (node, file, start, end, hash) from the stored leaves to the root, node 0 of the last one."""
    every = [leaf]
    for level in range(1, levels + 2):
        up = F.shiftright("node", FAN_BITS) if level <= levels else F.lit(0).cast("long")
        parts = F.array_sort(F.collect_list(F.struct("node", "file", "start", "end", "hash")))
        text = F.array_join(F.transform(parts, lambda x: F.concat_ws(":", x["node"], x["file"], x["start"], x["end"], x["hash"])), ",")
        at = every[-1].groupBy(up.alias("node")).agg(F.min("file").alias("file"), F.min("start").alias("start"), F.max("end").alias("end"), F.sha2(text, 256).alias("hash"))
        every.append(saved(at, "tree"))
    return every


def audit(ours: list[DataFrame], theirs: list[DataFrame]) -> tuple[DataFrame, list[int]]:
    """Leaves that differ between two trees of one height: node, state (changed: other bytes, moved: the same bytes
    elsewhere, lost: only ours, extra: only theirs); and how many nodes differed on each level, from the root down."""
    values = ("file", "start", "end", "hash")
    bad, met = None, []
    for level in range(len(ours) - 1, -1, -1):
        a, b = (t[level].select("node", F.struct(*values).alias(c)) for t, c in ((ours, "a"), (theirs, "b")))
        if bad is not None:
            up = bad.select(F.col("node").alias("up"))
            here = (lambda x: F.shiftright(x.node, FAN_BITS)) if level < len(ours) - 2 else (lambda x: F.lit(0).cast("long"))
            a, b = (x.join(up, here(x) == up.up, "left_semi") for x in (a, b))
        bad = saved(a.join(b, "node", "full_outer").filter("not (a <=> b)"), "differ")
        met.append(bad.count())
        if not met[-1]:
            break
    state = F.when(F.col("b").isNull(), "lost").when(F.col("a").isNull(), "extra").when(F.col("a.hash") != F.col("b.hash"), "changed").otherwise("moved")
    return bad.select("node", state.alias("state")), met


def op8_fixity(spark, sf_dir: str) -> DataFrame:
    """Audits all pages against a replica with planted faults and its own offsets: page_id, file, start, end, hash, state.

    One row a page that has an id; a page whose record follows a lost one in its file is moved there. Null and
    repeated rows as in warc_records; an empty table gives none.
    """
    records = warc_records(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    hit = lambda rule: F.pmod("slot", F.lit(rule[0])) == rule[1]
    broken = F.when(hit(CHANGED), F.concat(F.lit("WARC/1.0"), F.expr("substring(record, 9)"))).when(hit(ZEROED), F.expr("repeat('\\0', octet_length(record))")).otherwise(F.col("record"))
    kept = records.withColumn("kept", ~hit(LOST)).withColumn("record_", F.when(F.col("kept"), broken))
    size = F.when(F.col("kept"), F.octet_length("record_").cast("long")).otherwise(0)
    end = F.sum(size).over(Window.partitionBy("file").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    both = saved(kept.select("slot", "file", "start", "end", F.sha2("record", 256).alias("hash"), F.sha2("record_", 256).alias("copy"), end.alias("copy_end"), (end - size).alias("copy_start")), "leaves")
    ours = saved(both.select(F.col("slot").alias("node"), "file", "start", "end", "hash"), "ours")
    theirs = saved(both.filter("copy is not null").select(F.col("slot").alias("node"), "file", F.col("copy_start").alias("start"), F.col("copy_end").alias("end"), F.col("copy").alias("hash")), "theirs")
    levels = height(ours, theirs)
    bad, _ = audit(tree(ours, levels), tree(theirs, levels))
    return both.join(bad, both.slot == bad.node, "left").select(F.col("slot").alias("page_id"), "file", "start", "end", "hash", F.coalesce("state", F.lit("ok")).alias("state"))


FIXITY_SQL = f"""
WITH p AS (SELECT page_id, min(coalesce(url, '')) AS url, arg_min(coalesce(html, ''), coalesce(url, '')) AS html FROM pages WHERE page_id IS NOT NULL GROUP BY page_id),
r AS (
  SELECT page_id, page_id >> {FILE_BITS} AS file,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:'
    || concat_ws('-', substr(md5(page_id::VARCHAR), 1, 8), substr(md5(page_id::VARCHAR), 9, 4), substr(md5(page_id::VARCHAR), 13, 4), substr(md5(page_id::VARCHAR), 17, 4), substr(md5(page_id::VARCHAR), 21, 12))
    || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'WARC-Block-Digest: sha256:' || sha256(html) || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)::VARCHAR
    || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM p),
s AS (
  SELECT *, (sum(strlen(record)) OVER (PARTITION BY file ORDER BY page_id ROWS UNBOUNDED PRECEDING))::BIGINT AS "end",
    sum((page_id % {LOST[0]} = {LOST[1]})::INTEGER) OVER (PARTITION BY file ORDER BY page_id ROWS UNBOUNDED PRECEDING) AS gone FROM r)
SELECT page_id, file, "end" - strlen(record) AS start, "end", sha256(record) AS hash,
  CASE WHEN page_id % {LOST[0]} = {LOST[1]} THEN 'lost' WHEN page_id % {CHANGED[0]} = {CHANGED[1]} OR page_id % {ZEROED[0]} = {ZEROED[1]} THEN 'changed' WHEN gone > 0 THEN 'moved' ELSE 'ok' END AS state
FROM s
"""
