"""Interleaved documents: ordered text and media references from HTML, payloads resolved by digest.

A page becomes a sequence of parts, each text or a media reference with its caption, at the position it has on
the page. Payloads lie in a store with one row for each digest; references are joined to it by digest and the
sequence is put together again by position, so that captions stay with their media and a missing payload
leaves a gap and no shift.

The store's form of a payload is an 8-bit mono WAV file, whose samples are the payload's bytes.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from quillon.llm.blocks import pieces, salted_join, trimmed
from quillon.session import saved

RATE, UNIT = 8000, 64
HIDDEN = {"script", "style", "template", "noscript"}
BREAKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "table", "tr", "td", "blockquote", "pre", "nav", "header", "footer", "title", "figure", "figcaption", "body", "head", "html"}
MEDIA = {"img": "image", "audio": "audio", "video": "video", "source": "audio", "embed": "other"}
PART = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])


class Parts(HTMLParser):
    """Collects (kind, text, ref, caption) in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[list] = []
        self.text: list[str] = []
        self.hidden = 0
        self.figure = self.caption = None

    def close_text(self) -> None:
        words = " ".join("".join(self.text).split())
        self.text.clear()
        if words:
            self.parts.append(["text", words, None, None])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in MEDIA and not self.hidden:
            given = dict(attrs)
            if given.get("src"):
                self.close_text()
                self.parts.append([MEDIA[tag], None, given["src"], given.get("alt") or None])
        elif tag in BREAKS and self.caption is None:
            self.close_text()
        if tag == "figure":
            self.figure = len(self.parts)
        elif tag == "figcaption" and self.figure is not None:
            self.caption = []

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            words = " ".join("".join(self.caption).split())
            for part in self.parts[self.figure :]:
                if part[2] is not None and words:
                    part[3] = words
            self.caption = None
        elif tag in BREAKS and self.caption is None:
            self.close_text()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def parts_of(html: str) -> list[dict]:
    parser = Parts()
    parser.feed(html)
    parser.close()
    parser.close_text()
    return [{"pos": i, "kind": k, "text": t, "ref": r, "caption": c} for i, (k, t, r, c) in enumerate(parser.parts)]


PARTS = "parts array<struct<pos: int, kind: string, text: string, ref: string, caption: string>>"


def sequences(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, parts: array of (pos, kind, text, ref, caption). Null or empty html has no parts; broken HTML is read as far as it goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [parts_of(h) if h else [] for h in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("key"), pa.array(parts, pa.list_(PART))], ["key", "parts"])

    kind = dict(pages.dtypes)[key]
    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(trimmed(run), f"key {kind}, {PARTS}").withColumnRenamed("key", key)


def resolved(found: DataFrame, store: DataFrame, key: str = "page_id") -> DataFrame:
    """key and parts with `media`, the store's row for a reference `sha256:<digest>`; null where there is none.

    The store has one row for each digest. Rows of found stay as they come, whatever keys they repeat or lack.
    """
    rows = saved(found.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), "parts"), "sequences")
    parts = rows.select("_row", F.explode("parts").alias("part")).withColumn("digest", F.when(F.col("part.ref").startswith("sha256:"), F.substring("part.ref", 8, 64)))
    held = store.select("digest", F.struct(*(c for c in store.columns if c != "digest")).alias("media"))
    asked = saved(parts.filter("digest is not null").select("_row", "part.pos", "digest"), "references")
    # only references are moved to the store's rows; texts and captions wait at their place
    met = salted_join(asked, held, ["digest"], "_row").filter("media is not null").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("pos", "media"))).alias("at"))
    part = lambda x: F.struct(*(x[c].alias(c) for c in ("pos", "kind", "text", "ref", "caption")), F.col("at")[x["pos"]].alias("media"))
    return rows.join(met, "_row", "left").select(F.col("_key").alias(key), F.transform("parts", part).alias("parts"))


def payload(text: bytes) -> bytes:
    """The text's bytes and zeros up to a positive multiple of 64."""
    return text + bytes(-len(text) % UNIT or (UNIT if not text else 0))


def stored(data: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data)
    return out.getvalue()


def loaded(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        return w.readframes(w.getnframes())


def feature(data: bytes) -> str:
    """Mean, deviation, mean step and share of each quarter of the sample range."""
    x = np.frombuffer(data, np.uint8).astype(np.float64)
    quarters = np.bincount((x // 64).astype(np.int64), minlength=4) / len(x)
    step = np.abs(np.diff(x)).mean()
    return f"mean={x.mean():.4f};std={x.std():.4f};step={step:.4f};quarters=" + "/".join(f"{q:.4f}" for q in quarters)


FIELDS = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def text_media(docs: DataFrame) -> DataFrame:
    """The store of the texts of docs: one row for each distinct payload, read back from its stored form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches, "text", "doc_id"):
            rows = {}
            for t in texts:
                data = payload(t)
                digest = hashlib.sha256(data).hexdigest()
                if digest not in rows:
                    media = stored(data)
                    back = loaded(media)
                    rows[digest] = (digest, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(back))
            yield pa.record_batch([pa.array(c) for c in zip(*rows.values())], NAMES)

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), FIELDS).groupBy("digest").agg(*(F.first(c).alias(c) for c in NAMES[1:]))


def text_pages(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, html: each text as a page, a heading, a figure that refers to its payload with the size as its caption, and a line below."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n = F.octet_length(text)
    zeros = F.when(n == 0, UNIT).otherwise(F.pmod(-n, F.lit(UNIT)))
    data = F.concat(text, F.repeat(F.lit("\0"), zeros).cast("binary"))
    size = n.cast("string")
    html = F.concat(F.lit("<h1>text</h1><figure><audio src='sha256:"), F.sha2(data, 256), F.lit("'></audio><figcaption>"), size, F.lit(" bytes</figcaption></figure><p>end of "), size, F.lit(" bytes</p>"))
    return docs.select("doc_id", html.alias("html"))


def text_sequences(docs: DataFrame) -> DataFrame:
    """doc_id, parts of the pages of all texts, with the store's row at each figure."""
    return resolved(sequences(text_pages(docs), "doc_id"), text_media(docs), "doc_id")


def op9_media(spark, sf_dir: str) -> DataFrame:
    """All texts as media: doc_id, n_bytes and what the store says of the payload that the document's sequence refers to.

    A row for each row of documents, also where doc_id is null or repeats; null text is empty.
    """
    parts = text_sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    figure = parts.select("doc_id", F.element_at(F.filter("parts", lambda p: p["ref"].isNotNull()), 1).alias("p"))
    return figure.select("doc_id", F.regexp_extract("p.caption", r"^(\d+)", 1).cast("long").alias("n_bytes"), *(f"p.media.{c}" for c in NAMES[1:]))
