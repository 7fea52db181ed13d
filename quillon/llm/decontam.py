"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of 64 words, a new one every 32; benchmark items into queries of at most 64 words.
Both are TF-IDF vectors over hashed words; document frequencies cover all documents. A distributed randomised SVD
(a random matrix, taken through A'A once, as a sum of matrices made where the passages are) gives the latent space. Every passage of every document is projected and compared by cosine
with every query; pairs above the threshold are candidates. A candidate counts if the longest common subsequence of
words of the item and the words around the passage, as many on either side as the item has, covers enough of the
item, or covers less but holds the item's answer: the words of its last sentence.

The space is fitted on all passages of all documents, in one pass whatever the number of blocks, and on all queries,
which weigh more than the passages. Its rank is above the number of queries of a block, so that it holds all of them, and
the cosine of a copy does not fall as the benchmark grows; a larger benchmark takes more blocks, each with its own space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from quillon.llm.blocks import carried, judged, mixed, pieces, trimmed
from quillon.session import saved

TERM_BITS, RANK, SPARE, HALF = 14, 256, 56, 32
FIT_PARTS, FIT_WEIGHT, SEED = 4, 8.0, 7
COSINE, COVER, ANSWER_COVER, ANSWER_SHARE = 0.25, 0.7, 0.55, 0.8
QUERY_BLOCK, RUN, FIT_RUN, CELLS = 960, 16, 8, 1 << 20
SLICE, SLICES = 512, "slice long, n long, sum binary"
# ASCII punctuation and controls part words; letters of other scripts are bytes of their own.
PARTING = bytes(c if c >= 128 or chr(c).isalnum() or c == 95 else 32 for c in range(256))
HALF_BITS = 32 - TERM_BITS  # a block has fewer halves than this many bits can number
ODD = 0x9E3779B97F4A7C15 | 1
LETTERS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
STRETCH = 1 << 16
# Lower-cased and parted, for texts in ASCII.
LOWER_PARTING = bytes(PARTING[c + 32 if 65 <= c <= 90 else c] for c in range(256))


def powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, kept for the next call."""
    if len(POWERS[0]) < n:
        for i, base in enumerate((ODD, pow(ODD, -1, 1 << 64))):
            grown = np.full(n + n // 4, base, np.uint64)
            grown[0] = 1
            POWERS[i] = np.cumprod(grown)
    return POWERS


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, a stretch of bytes at a time."""
    out = np.empty(len(start), np.uint64)
    a, room = 0, np.zeros((2, 0), np.uint64)
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(start, start[a] + STRETCH)))
        low, high = int(start[a]), int(end[b - 1])
        up, down = powers(high - low + 1)
        if high - low >= room.shape[1]:
            room = np.zeros((2, high - low + 1), np.uint64)
        letters, sums = room[0, : high - low], room[1, : high - low + 1]  # sums begins with a 0
        np.take(LETTERS, data[low:high], out=letters, mode="clip")
        letters *= up[: high - low]
        np.cumsum(letters, out=sums[1:])
        s, e = start[a:b] - low, end[a:b] - low
        out[a:b] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        a = b
    return mixed(out)


def worded(texts: list[bytes]) -> list[np.ndarray]:
    """The hashes of each text's words, in order: lower-cased, parted at white space and ASCII punctuation."""
    low = [t.translate(LOWER_PARTING) if t.isascii() else t.decode(errors="replace").lower().encode().translate(PARTING) for t in texts]
    data = np.frombuffer(b" " + b" ".join(low) + b" ", np.uint8)
    turns = np.flatnonzero(np.diff(data == 32)) + 1
    start, end = turns[::2], turns[1::2]
    sizes = np.fromiter(map(len, low), np.int64, len(low)) + 1
    cuts = np.searchsorted(start, 1 + np.cumsum(sizes) - sizes)
    hashes = word_hashes(data, start, end)
    return [hashes[a:b] for a, b in zip(cuts, np.r_[cuts[1:], len(hashes)])]


def terms_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents, and documents with each term, in a partition."""
    total, df = 0, np.zeros(1 << TERM_BITS, np.int64)
    for _, texts in pieces(batches, "text", "doc_id", 1 << 20):
        words = worded(texts)
        keys = terms_of(np.concatenate(words)) | np.repeat(np.arange(len(texts)), list(map(len, words))) << TERM_BITS
        keys.sort()
        own = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
        df += np.bincount(own & (1 << TERM_BITS) - 1, minlength=len(df))
        total += len(texts)
    yield pa.record_batch([pa.array([total]), pa.array([df.tobytes()], pa.binary())], ["n", "df"])


def passages(texts: list[np.ndarray], idf: np.ndarray, run: int = RUN) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """TF-IDF rows of unit length, up to `run` passages of a text at a time: (number of the text, that of the first passage, terms at hand, passages by terms).

    Texts are given by their terms; one without any has no passages. Terms are sorted and counted for as many blocks at
    once as take CELLS numbers, or one, since most texts are short and a count for each would take most of the time.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    last = np.where(sizes > 0, np.maximum(1, -(-sizes // HALF) - 1), 0)
    blocks = -(-last // run)
    text = np.repeat(np.arange(len(texts)), blocks)
    first = run * (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    start = first * HALF
    end = np.minimum(sizes[text], (np.minimum(last[text], first + run) + 1) * HALF)
    halves = -(-(end - start) // HALF)
    room = np.cumsum(halves * np.minimum(end - start, 1 << TERM_BITS))
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(room, (room[a - 1] if a else 0) + CELLS, "right")))
        counts = end[a:b] - start[a:b]
        block = np.repeat(np.arange(b - a), counts)
        half = (np.arange(len(block)) - np.repeat(np.cumsum(counts) - counts, counts)) // HALF
        term = np.concatenate([texts[i][s:e] for i, s, e in zip(text[a:b].tolist(), start[a:b].tolist(), end[a:b].tolist())])
        # block, term and half in one number, so that one sort brings equal terms of a block together
        keys = (block << TERM_BITS | term) << HALF_BITS | half
        keys.sort()
        half = keys & (1 << HALF_BITS) - 1
        keys >>= HALF_BITS
        new = np.r_[True, keys[1:] != keys[:-1]]
        own = keys[new]
        ends = np.searchsorted(own, np.arange(b - a + 1) << TERM_BITS)
        own &= (1 << TERM_BITS) - 1
        width = np.diff(ends)
        cells = np.r_[0, np.cumsum(width * halves[a:b])]
        block = np.repeat(np.arange(b - a), counts)
        place = np.cumsum(new) - 1
        weights = idf[own][place]
        place += half * width[block] + (cells[:-1] - ends[:-1])[block]
        flat = np.bincount(place, weights, minlength=int(cells[-1])).astype(np.float32)
        for k, (i, p, h) in enumerate(zip(text[a:b].tolist(), first[a:b].tolist(), halves[a:b].tolist())):
            rows = flat[cells[k] : cells[k + 1]].reshape(h, -1)
            if h > 1:
                rows = rows[:-1] + rows[1:]
            rows /= np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
            yield i, p, own[ends[k] : ends[k + 1]], rows
        a = b


def times(rows: Iterator[tuple[np.ndarray, np.ndarray]], matrix: np.ndarray, out: np.ndarray) -> int:
    """Adds A'(A M) over blocks of A to out; their number of rows."""
    n = 0
    # rows are copied into memory that is kept: most blocks are small, and their time is that of moving rows
    room = np.empty((2, 64, matrix.shape[1]), np.float32)
    for own, block in rows:
        if len(own) > room.shape[1]:
            room = np.empty((2, 2 * len(own), matrix.shape[1]), np.float32)
        part, held = room[:, : len(own)]
        np.take(matrix, own, axis=0, out=part, mode="clip")
        np.matmul(block.T, block @ part, out=part)
        np.take(out, own, axis=0, out=held, mode="clip")
        part += held
        out[own] = part
        n += len(block)
    return n


def scattered(rank: int) -> np.ndarray:
    """A random terms-by-rank matrix; that of a lower rank is its first columns."""
    return np.ascontiguousarray(np.random.default_rng(SEED).standard_normal((rank, 1 << TERM_BITS), np.float32).T)


def gathered(docs: DataFrame, idf: np.ndarray, rank: int) -> tuple[np.ndarray, int]:
    """A'A M of the passages of all documents for the random matrix M of a rank; the number of passages."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((scattered(rank), idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, weights = shared.value
        total, n = np.zeros_like(m), 0
        for _, texts in pieces(batches, "text", "doc_id", 1 << 20):
            n += times(((own, rows) for _, _, own, rows in passages(list(map(terms_of, worded(texts))), weights, FIT_RUN)), m, total)
        for i in range(0, len(total) if n else 0, SLICE):
            yield pa.record_batch([pa.array([i // SLICE]), pa.array([n if i == 0 else 0]), pa.array([total[i : i + SLICE].tobytes()], pa.binary())], ["slice", "n", "sum"])

    total, n = np.zeros((1 << TERM_BITS, rank), np.float32), 0
    # a task makes one matrix of all its partitions, so that what is sent does not grow with the documents; slices are
    # summed where they meet, so that the driver gets the matrix once and in small parts
    dealt = docs.select("doc_id", "text").coalesce(max(FIT_PARTS, 2 * sc.defaultParallelism))
    parts = dealt.mapInArrow(trimmed(run), SLICES).repartition(-(-len(total) // SLICE), "slice").mapInArrow(slices_added, SLICES)
    for r in parts.toLocalIterator():
        total[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["sum"], np.float32).reshape(-1, rank)
        n += r["n"]
    shared.destroy()
    return total, n


def fit(total: np.ndarray, n: int, queries: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Orthonormal terms-by-rank basis of the leading directions of n passages, of which gathered() made total, and the queries.

    Queries weigh FIT_WEIGHT times as much as all passages together, so that the space holds what is searched for.
    """
    asked = [(own, rows) for _, _, own, rows in passages(queries, idf)]
    own = np.zeros(total.shape, np.float32)
    times(iter(asked), scattered(total.shape[1]), own)
    own *= np.float32(FIT_WEIGHT * max(1.0, n / max(1, len(asked))))
    own += total
    y, small = np.linalg.qr(own)
    vector, value, _ = np.linalg.svd(small)
    return (y @ vector[:, value > 1e-7 * max(value.max(), 1e-12)]).astype(np.float32)


def slices_added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the slices of a task by their number."""
    sums: dict[int, list] = {}
    for batch in batches:
        for k, n, b in zip(*(batch.column(c).to_pylist() for c in ("slice", "n", "sum"))):
            part = np.frombuffer(b, np.float32)
            sums[k] = [n + sums[k][0], part + sums[k][1]] if k in sums else [n, part]
    for k, (n, part) in sums.items():
        yield pa.record_batch([pa.array([k]), pa.array([n]), pa.array([part.tobytes()], pa.binary())], ["slice", "n", "sum"])


class Item:
    """What a benchmark item is compared by."""

    def __init__(self, number: int, text: bytes):
        self.number = number
        words = worded([text])[0].tolist()
        self.size, self.mask = len(words), {}
        for i, w in enumerate(words):
            self.mask[w] = self.mask.get(w, 0) | 1 << i
        self.known = set(words)
        parts = [w for w in worded(re.split(rb"[.!?\n]+", text)) if len(w)]
        self.answer = set(parts[-1].tolist()) if parts else set()
        self.reach = max(1, -(-self.size // HALF))

    def common(self, words: list[int]) -> int:
        """Length of the longest common subsequence, one bit for each word of the item."""
        full = row = (1 << self.size) - 1
        get = self.mask.get
        for w in words:
            if hit := get(w):
                u = row & hit
                row = ((row + u) | (row - u)) & full
        return self.size - row.bit_count()

    def share(self, words: np.ndarray, limits: tuple[float, float, float]) -> float:
        """How much of the item the words cover in order, if it is enough; else 0."""
        cover, answer_cover, answer_share = limits
        here = words.tolist()
        held = self.known.intersection(here)
        # no common subsequence is longer than the words in common
        if sum(self.mask[w].bit_count() for w in held) < min(cover, answer_cover) * self.size:
            return 0.0
        share = self.common(here) / self.size
        return share if share >= cover or (share >= answer_cover and len(self.answer & held) >= answer_share * len(self.answer)) else 0.0


def stretches(at: np.ndarray, gap: int) -> Iterator[tuple[int, int]]:
    """First and last of passages that lie within `gap` of the first."""
    i = 0
    while i < len(at):
        j = int(np.searchsorted(at, at[i] + gap, "right"))
        yield int(at[i]), int(at[j - 1])
        i = j


FOUND = "contaminated boolean, item_id long, n_items long, lcs_share double, cosine double"
NAMES = [f.split()[0] for f in FOUND.split(", ")]
TYPES = [pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]


def searched(model, limits: tuple[float, float, float, float], carry: list[str]):
    """What the items of a model say of each text."""
    cosine, *checks = limits
    items: dict[int, Item] = {}

    def nearby(words: list[np.ndarray]) -> dict[int, dict[int, tuple[list, float]]]:
        """By the number of a text that has any: items with the passages near them, and their greatest cosine."""
        matrix, idf, numbers, _, owner = model.value
        found: dict[int, dict[int, tuple[list, float]]] = {}
        room = np.empty((64, matrix.shape[1]), np.float32)
        for i, p, own, rows in passages(list(map(terms_of, words)), idf) if numbers else ():
            if len(own) > len(room):
                room = np.empty((2 * len(own), matrix.shape[1]), np.float32)
            score = rows @ np.take(matrix, own, axis=0, out=room[: len(own)], mode="clip")
            for k in np.flatnonzero(score.max(0) >= cosine):
                near = found.setdefault(i, {})
                at = np.flatnonzero(score[:, k] >= cosine) + p
                places, top = near.get(owner[k], ([], 0.0))
                near[owner[k]] = [*places, at], max(top, float(score[:, k].max()))
        return found

    def one(words: np.ndarray, near: dict[int, tuple[list, float]]) -> tuple:
        _, _, numbers, texts, _ = model.value
        best, hits = (0.0, 0.0, None), 0
        for i, (places, close) in near.items():
            item = items.get(i) or items.setdefault(i, Item(numbers[i], texts[i]))
            top = 0.0
            for a, b in stretches(np.unique(np.concatenate(places)), item.reach // 2):
                top = max(top, item.share(words[max(0, a - item.reach) * HALF : (b + 2 + item.reach) * HALF], tuple(checks)))
                if top == 1:
                    break
            if top:
                hits += 1
                best = max(best, (top, close, -item.number), key=lambda b: (b[0], b[2] if b[2] is not None else -(1 << 62)))
        return hits > 0, None if best[2] is None else -best[2], hits, round(best[0], 6), round(best[1], 4)

    def all_of(texts: list[bytes]) -> list[tuple]:
        words = worded(texts)
        found = nearby(words)
        return [one(w, found.get(i, {})) for i, w in enumerate(words)]

    return judged(all_of, carry, TYPES, NAMES)


def unit(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    term, count = np.unique(terms_of(words), return_counts=True)
    w = (count * idf[term]).astype(np.float32)
    return term, w / np.sqrt(w @ w)


def contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, limits: tuple[float, float, float, float] = (COSINE, COVER, ANSWER_COVER, ANSWER_SHARE), block: int = QUERY_BLOCK, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Searches every text of docs(doc_id, text, ...) for the items of benchmark(item_id, text, ...).

    Returns the columns `carry` of docs, contaminated, item_id (of the item covered most, the least id among equals; null if none),
    n_items, lcs_share, cosine. Null and wordless texts are clean, and so are null or wordless items. Of items that
    repeat an id the least text counts; without items all is clean. Rows of docs stay as they come, whatever ids they
    repeat or lack; other columns are ignored. Items make one query for each 64 words; `block` queries are taken
    at a time, each time against all rows; with more than one block the texts are numbered and written once.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    df, n = np.zeros(1 << TERM_BITS, np.int64), 0
    # the partial counts are summed in a few tasks, so that the driver gets no more than those
    partial = docs.select("doc_id", "text").mapInArrow(trimmed(frequencies), "n long, df binary").repartition(FIT_PARTS).mapInArrow(added, "n long, df binary")
    for r in partial.toLocalIterator():
        df += np.frombuffer(r["df"], np.int64)
        n += r["n"]
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(0.01)
    made: list[tuple[np.ndarray, int]] = []  # what the passages give for the highest rank so far

    def search(rows: DataFrame, keep: list[str], items: list[tuple[int, bytes]], queries: list[tuple[int, np.ndarray]]) -> DataFrame:
        matrix = np.zeros((1 << TERM_BITS, len(queries)), np.float32)
        if queries:
            wanted = max(rank, len(queries) + SPARE)
            if not made or made[0][0].shape[1] < wanted:
                made[:] = [gathered(docs, idf, wanted if second is None else max(wanted, block + SPARE))]
            total, passed = made[0]
            basis = fit(total[:, :wanted], passed, [terms_of(q) for _, q in queries], idf)
        for k, (_, q) in enumerate(queries):
            term, w = unit(q, idf)
            matrix[:, k] = basis @ (w @ basis[term])
        model = sc.broadcast((matrix, idf, [i for i, _ in items], [t for _, t in items], [k for k, _ in queries]))
        given = rows.select(*dict.fromkeys([*keep, "text"]))
        return given.mapInArrow(trimmed(searched(model, limits, keep)), carried(given, keep, FOUND))

    def blocks() -> Iterator[tuple[list, list]]:
        items: list[tuple[int, bytes]] = []
        queries: list[tuple[int, np.ndarray]] = []
        asked = benchmark.filter("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text")).filter("text is not null").orderBy("item_id")
        for r in asked.toLocalIterator():
            raw = r["text"].encode()
            words = worded([raw])[0]
            mine = [words[a : a + 2 * HALF] for a in range(0, len(words), 2 * HALF)]
            if len(mine) > 1 and len(mine[-1]) < HALF:  # a short rest says little by itself
                mine[-2:] = [np.concatenate(mine[-2:])]
            if mine and queries and len(queries) + len(mine) > block:
                yield items, queries
                items, queries = [], []
            if mine:
                queries += [(len(items), q) for q in mine]
                items.append((r["item_id"], raw))
        if queries:
            yield items, queries

    every = blocks()
    first = next(every, ([], []))
    second = next(every, None)
    if second is None:
        return search(docs, list(carry), *first)
    rows = saved(docs.select(F.monotonically_increasing_id().alias("_row"), *dict.fromkeys([*carry, "text"])), "texts")
    found = search(rows, ["_row"], *first).union(search(rows, ["_row"], *second))
    for items, queries in every:
        found = found.union(search(rows, ["_row"], items, queries))
    top = F.max(F.struct("lcs_share", (-F.col("item_id")).alias("item"), "cosine")).alias("top")
    best = found.groupBy("_row").agg(F.max("contaminated").alias("contaminated"), F.sum("n_items").alias("n_items"), top)
    return rows.select("_row", *carry).join(best, "_row").select(*carry, "contaminated", (-F.col("top.item")).alias("item_id"), "n_items", "top.lcs_share", "top.cosine")


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, df = 0, np.zeros(1 << TERM_BITS, np.int64)
    for batch in batches:
        for k, d in zip(batch.column("n").to_pylist(), batch.column("df").to_pylist()):
            n += k
            df += np.frombuffer(d, np.int64)
    yield pa.record_batch([pa.array([n]), pa.array([df.tobytes()], pa.binary())], ["n", "df"])


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: doc_id, contaminated, item_id, n_items, lcs_share, cosine. Edge cases as in contaminated."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
