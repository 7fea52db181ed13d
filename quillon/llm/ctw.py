"""LM scoring by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions. Each decision has a tree of byte contexts of depth 0 to `depth`; every tree node
holds a Krichevsky-Trofimov estimate of all training bytes, and the weighted probability of a node mixes its own
estimate with its children's by halves. No context is left out: the tree grows with the corpus. It is never in one
place.

1. Tasks take documents in units of some megabytes and send each distinct string of a context and its byte, with its
   count in training texts (0 if only other texts hold it), to the task that its last three context bytes are dealt to.
   Words go the same way for the word baseline. The texts of a unit are stored beside.
2. A task that owns contexts has all their counts, so it weighs its subtrees by itself. Of the contexts above, up to two
   bytes, the driver gets counts and sums of the subtrees: 2**24 numbers at most, at any corpus size.
3. With the weights above, which are broadcast, an owner mixes the estimates along every path and answers each unit
   with the cost of the strings that it has asked for. A unit's texts and answers meet, and costs are added up.

Text is taken with A-Z lowered and each run of white space as one space, then one end symbol, so that the model and
the word baseline give probability to the same events.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from quillon.llm.blocks import bundle, counted, mixed, partitions, remainder, sliced, trimmed, unbundle, utf8
from quillon.llm.decontam import word_hashes
from quillon.session import saved

DEPTH, TOP, UNIT, PIECE = 6, 3, 16 << 20, 1 << 20
TEXT, GRAM, WORD = 0, 1, 2
LOG10_2, LN2, FIXED = math.log10(2), math.log(2), 1 << 18
ROWS, NAMES = "kind byte, bucket int, unit long, blob binary, data binary", ["kind", "bucket", "unit", "blob", "data"]
TYPES = (pa.int8(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
SMALL, MOST_WAITING = 1 << 16, 4_000_000
#: ln of the gamma function at x + 1/2 and at x + 1, for small x.
HALVES = np.r_[0.0, np.cumsum(np.log(np.arange(SMALL - 1) + 0.5))] + 0.5 * math.log(math.pi)
WHOLES = np.r_[0.0, np.cumsum(np.log(np.arange(1, SMALL, dtype=np.float64)))]


# -- packing
def squeezed(x: np.ndarray) -> bytes:
    """Integers by planes of their bytes, compressed: high planes of small numbers cost nothing."""
    return zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes())


def unsqueezed(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel()


def packed(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted keys and a number for each."""
    a, b = squeezed(np.diff(keys, prepend=0)), squeezed(values)
    return len(a).to_bytes(8, "little") + a + b


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = 8 + int.from_bytes(blob[:8], "little")
    return np.cumsum(unsqueezed(blob[8:n])), unsqueezed(blob[n:])


def rows_of(rows: Iterator[tuple], most: int = 64) -> Iterator[pa.RecordBatch]:
    out = []
    for r in rows:
        out.append(r)
        if len(out) == most or r[4] is not None:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], NAMES)
            out = []
    if out:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], NAMES)


# -- texts
def grams(texts: list[bytes], depth: int, most: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Strings of context (last byte first) and byte at every place of texts, pieces of about `most` places at a time: (strings, first
    place of each text in the piece, index of that text). Before a text are zero bytes."""
    pad = bytes(depth)
    held: list[tuple[int, bytes, bytes]] = []
    size = 0

    def piece() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(x for _, before, body in held for x in (before, body)), np.uint8).astype(np.int64)
        code = data[depth:].copy()
        for j in range(1, depth + 1):
            code |= data[depth - j : len(data) - j] << (8 * (depth + 1 - j))
        sizes = np.fromiter((len(body) for _, _, body in held), np.int64, len(held))
        real = np.ones(len(data), bool)
        real[((np.cumsum(sizes + depth) - sizes - depth)[:, None] + np.arange(depth)).ravel()] = False
        return code[real[depth:]], np.cumsum(sizes) - sizes, np.array([i for i, _, _ in held])

    for i, text in enumerate(texts):
        for a in range(0, len(text), most):
            held.append((i, (pad + text[max(0, a - depth) : a])[-depth:], text[a : a + most]))
            size += len(held[-1][2])
            if size >= most:
                yield piece()
                held, size = [], 0
    if held:
        yield piece()


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of normalised texts, and the number of words of each."""
    data = np.frombuffer(b" " + b" ".join(t[:-1] for t in texts) + b" ", np.uint8)
    turns = np.flatnonzero(np.diff(data == 32)) + 1
    start, end = turns[::2], turns[1::2]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    cuts = np.searchsorted(start, 1 + np.cumsum(sizes) - sizes)
    return (word_hashes(data, start, end) >> np.uint64(1)).view(np.int64), np.diff(np.r_[cuts, len(start)])


def owners(kind: int, keys: np.ndarray, parts: int, depth: int) -> np.ndarray:
    """The task that owns each string (by the first bytes of its context) or word."""
    own = keys >> (8 * (depth - min(TOP, depth)) + 8) if kind == GRAM else keys
    return (mixed(own.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def tallied(parts: int, depth: int, most: int = UNIT):
    """A unit's distinct strings and words for their owners, and its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        flags: list[bool] = []
        held = 0

        def flush() -> Iterator[tuple]:
            unit = int.from_bytes(os.urandom(8), "little") >> 1
            found: dict[int, list] = {GRAM: [], WORD: []}
            for learn in (True, False):
                some = [t for t, f in zip(texts, flags) if f == learn]
                for code, _, _ in grams(some, depth):
                    u, n = np.unique(code, return_counts=True)
                    found[GRAM].append((u, n if learn else np.zeros(len(u), np.int64)))
                    if len(found[GRAM]) == 4:
                        found[GRAM] = [counted(found[GRAM])]
                if some:
                    u, n = np.unique(words(some)[0], return_counts=True)
                    found[WORD].append((u, n if learn else np.zeros(len(u), np.int64)))
            for kind in (GRAM, WORD):
                keys, n = counted(found[kind])
                bucket = owners(kind, keys, parts, depth)
                order = np.argsort(bucket, kind="stable")
                for b, s in sliced(bucket[order]):
                    yield kind, b, unit, packed(keys[order[s]], n[order[s]]), None
            null = np.fromiter((i is None for i in ids), np.int64, len(ids))
            blob = bundle(np.array([0 if i is None else i for i in ids], np.int64), null, np.fromiter(map(len, texts), np.int64, len(texts)))
            yield TEXT, 0, unit, blob, zstandard.ZstdCompressor(3).compress(b"".join(texts))

        for batch in batches:
            for key, learn, text in zip(batch.column("doc_id").to_pylist(), batch.column("learn").to_pylist(), utf8(batch.column("text"))):
                ids.append(key)
                flags.append(bool(learn))
                texts.append(b" ".join(text.lower().split()) + b"\n")
                held += len(texts[-1])
                if held >= most:
                    yield from rows_of(flush())
                    ids, texts, flags, held = [], [], [], 0
        if ids:
            yield from rows_of(flush())

    return run


# -- the tree
def kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return gamma(a, 0.5, HALVES) + gamma(b, 0.5, HALVES) - gamma(a + b, 1.0, WHOLES) - math.log(math.pi)


def gamma(x: np.ndarray, add: float, table: np.ndarray) -> np.ndarray:
    out = table[np.minimum(x, SMALL - 1)]
    if len(big := np.flatnonzero(x >= SMALL)):
        y = x[big] + add
        out[big] = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3)
    return out


class Layer:
    """Strings of one depth (context, then byte) in order, their counts, and the eight decisions of each."""

    def __init__(self, g: np.ndarray, n: np.ndarray):
        self.g, self.n = g, n
        self.first, self.run, self.a, self.b = [], [], [], []
        for level in range(8):
            x = g >> (8 - level)
            new = np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            ones = np.add.reduceat(n * ((g >> (7 - level)) & 1), first) if len(x) else n
            self.first.append(first)
            self.run.append((np.cumsum(new) - 1).astype(np.int32))
            self.b.append(ones)
            self.a.append((np.add.reduceat(n, first) if len(x) else n) - ones)

    def keys(self, level: int, up: int = 0) -> np.ndarray:
        """Context, without its last `up` bytes, and node of each decision, as one number."""
        g = self.g[self.first[level]]
        return (g >> (8 + 8 * up)) << 8 | (1 << level) | ((g & 255) >> (8 - level))


class Part:
    """Layers of depths `low` to `high`, made of the strings of the deepest; `sums` are ln probabilities of what is below it."""

    def __init__(self, g: np.ndarray, n: np.ndarray, high: int, low: int, sums: tuple[np.ndarray, np.ndarray] | None = None):
        self.high, self.low, self.leaf = high, low, sums is None
        self.layer, self.up = {high: Layer(g, n)}, {}
        for d in range(high - 1, low - 1, -1):
            below = self.layer[d + 1]
            g, up = np.unique((below.g >> 16) << 8 | (below.g & 255), return_inverse=True)
            self.up[d + 1] = up.ravel()
            self.layer[d] = Layer(g, np.bincount(self.up[d + 1], below.n, len(g)).astype(np.int64))
        self.weight: dict[int, list] = {}
        self.total: dict[int, list] = {}
        for d in range(high, low - 1, -1):
            x = self.layer[d]
            self.weight[d], self.total[d] = [], []
            for level in range(8):
                own = kt(x.a[level], x.b[level])
                if d == high and self.leaf:
                    self.weight[d].append(np.ones(len(own)))
                    self.total[d].append(own)
                    continue
                if d == high:
                    down = sums[1][np.searchsorted(sums[0], x.keys(level))]
                else:
                    down = np.bincount(self.parent(d + 1, level), self.total[d + 1][level], len(own))
                both = np.logaddexp(own, down) - LN2
                self.weight[d].append(np.exp(own - LN2 - both))
                self.total[d].append(both)

    def parent(self, d: int, level: int) -> np.ndarray:
        """For each decision of depth d the same decision in the context that is a byte shorter."""
        return self.layer[d - 1].run[level][self.up[d][self.layer[d].first[level]]]

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """What the context above the lowest layer needs of it: keys of its decisions, and sums of ln probabilities."""
        keys = np.concatenate([self.layer[self.low].keys(level, 1) for level in range(8)])
        return summed(keys, np.concatenate(self.total[self.low]))

    def mixed(self, above: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each level, what every decision of the deepest layer has of P(1), and the share that is left for what is below."""
        out = []
        for level in range(8):
            for d in range(self.low, self.high + 1):
                x = self.layer[d]
                if d > self.low:
                    at = self.parent(d, level)
                    have, left = have[at], left[at]  # noqa: F821
                elif above is None:
                    have, left = np.zeros(len(x.a[level])), np.ones(len(x.a[level]))
                else:
                    at = np.searchsorted(above[0], x.keys(level, 1))
                    have, left = above[1][at], above[2][at]
                w = self.weight[d][level]
                p = (x.b[level] + 0.5) / (x.a[level] + x.b[level] + 1.0)
                have, left = have + left * w * p, left * (1.0 - w)
            out.append((have, left))
        return out

    def costs(self, above: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> np.ndarray:
        """Bits of the byte of each string after its context."""
        x = self.layer[self.high]
        bits = np.zeros(len(x.g))
        for level, (have, _) in enumerate(self.mixed(above)):
            p = have[x.run[level]]
            bits -= np.log2(np.where((x.g >> (7 - level)) & 1, p, 1.0 - p))
        return bits


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their values."""
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at.ravel(), values, len(keys)) if len(keys) else np.zeros(0)


def gathered(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple[tuple[int, int], np.ndarray, np.ndarray]]]:
    """Of each kind ((unit, bucket), keys, counts)."""
    found: dict[int, list] = {GRAM: [], WORD: []}
    for batch in batches:
        for kind, bucket, unit, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "unit", "blob"))):
            found[kind].append(((unit, bucket), *unpacked(blob)))
    return found


def merged(rows: list[tuple[tuple[int, int], np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return counted([(k, n) for _, k, n in rows]) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


ABOVE = "keys binary, sums binary, grams binary, counts binary, tokens long, distinct long"


def below(depth: int):
    """What the contexts above need of the subtrees that a task owns, and its number of words."""
    top = min(TOP, depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = gathered(batches)
        _, n = merged(found[WORD])
        tokens, distinct = int(n.sum()), int((n > 0).sum())
        g, n = merged(found.pop(GRAM))
        part = Part(g, n, depth, top)
        keys, sums = part.sums()
        short, counts = summed((part.layer[top].g >> 16) << 8 | (part.layer[top].g & 255), part.layer[top].n)
        yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in (keys, sums, short, counts.astype(np.int64))] + [pa.array([tokens]), pa.array([distinct])], [f.split()[0] for f in ABOVE.split(", ")])

    return run


def above_of(rows: Iterator, depth: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int, int]:
    """The share of every decision of the contexts above, for their subtrees; training words, and distinct ones."""
    top, tokens, distinct, waits = min(TOP, depth), 0, 0, 0
    held: dict[str, list] = {"sums": [], "counts": []}

    def settle() -> None:
        for name, pairs in held.items():
            held[name] = [summed(*(np.concatenate(x) for x in zip(*pairs)))] if pairs else [(np.zeros(0, np.int64), np.zeros(0))]

    for r in rows:
        held["sums"].append((np.frombuffer(r["keys"], np.int64), np.frombuffer(r["sums"], np.float64)))
        held["counts"].append((np.frombuffer(r["grams"], np.int64), np.frombuffer(r["counts"], np.int64).astype(np.float64)))
        tokens, distinct, waits = tokens + r["tokens"], distinct + r["distinct"], waits + len(r["keys"]) // 8
        if waits > MOST_WAITING:
            settle()
            waits = 0
    settle()
    (keys, sums), (short, counts) = held["sums"][0], held["counts"][0]
    part = Part(short, counts.astype(np.int64), top - 1, 0, (keys, sums))
    at = np.concatenate([part.layer[top - 1].keys(level) for level in range(8)])
    have, left = (np.concatenate(x) for x in zip(*part.mixed(None)))
    order = np.argsort(at)
    return (at[order], have[order], left[order]), tokens, distinct


def answers(above, depth: int):
    """For each unit the costs of its strings and the counts of its words that a task owns, in the order of what was asked."""
    top = min(TOP, depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = gathered(batches)

        def rows() -> Iterator[tuple]:
            g, n = merged(found[WORD])
            for (unit, bucket), keys, _ in found.pop(WORD):
                yield WORD, bucket, unit, squeezed(n[np.searchsorted(g, keys)]), None
            g, n = merged(found[GRAM])
            if len(g):
                cost = np.round(Part(g, n, depth, top).costs(above.value) * FIXED).astype(np.int64)
                for (unit, bucket), keys, _ in found.pop(GRAM):
                    yield GRAM, bucket, unit, squeezed(cost[np.searchsorted(g, keys)]), None

        yield from rows_of(rows())

    return run


# -- scores
def units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, bytes, dict[int, dict[int, bytes]]]]:
    """Of rows ordered by unit: ids, null marks and sizes, texts, and the answers of each kind by the task that they come from."""
    unit, text, given = None, [], {GRAM: {}, WORD: {}}

    def whole() -> tuple[list, bytes, dict[int, dict[int, bytes]]]:
        if len(text) != 1:
            raise RuntimeError(f"unit {unit} has {len(text)} texts")
        return unbundle(text[0][0]), zstandard.ZstdDecompressor().decompress(text[0][1]), given

    for batch in batches:
        for k, b, u, blob, data in zip(*(batch.column(c).to_pylist() for c in NAMES)):
            if u != unit and (text or given[GRAM] or given[WORD]):
                yield whole()
                text, given = [], {GRAM: {}, WORD: {}}
            unit = u
            if k == TEXT:
                text.append((blob, data))
            else:
                given[k][b] = blob
    if unit is not None:
        yield whole()


def answered(kind: int, keys: np.ndarray, given: dict[int, bytes], parts: int, depth: int) -> np.ndarray:
    """The answer to each of a unit's sorted distinct keys; every task has answered in their order."""
    out = np.empty(len(keys), np.int64)
    bucket = owners(kind, keys, parts, depth)
    order = np.argsort(bucket, kind="stable")
    for b, s in sliced(bucket[order]):
        values = unsqueezed(given.pop(b)) if b in given else ()
        if len(values) != s.stop - s.start:
            raise RuntimeError("a unit lacks answers")
        out[order[s]] = values
    return out


SCORED = "doc_id long, n_tokens long, n_known long, logs double, bits double, n_bytes long"


def scored(parts: int, depth: int, ends: int):
    """Scores of each unit's texts; `ends` is the count of the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, null, sizes), whole, given in units(batches):
            cuts = np.r_[0, np.cumsum(sizes)]
            texts = [whole[a:b] for a, b in zip(cuts, cuts[1:])]
            del whole
            held = []
            for code, first, which in grams(texts, depth):
                u, at = np.unique(code, return_inverse=True)
                held.append((u, at.ravel().astype(np.int32), first, which))
            every = np.sort(np.concatenate([np.zeros(0, np.int64), *(u for u, _, _, _ in held)]))
            every = every[np.r_[True, every[1:] != every[:-1]]] if len(every) else every
            cost, bits = answered(GRAM, every, given[GRAM], parts, depth) / FIXED, np.zeros(len(texts))
            for u, at, first, which in held:
                np.add.at(bits, which, np.add.reduceat(cost[np.searchsorted(every, u)][at], first))
            del held, every, cost
            flat, n = words(texts)
            u, at = np.unique(flat, return_inverse=True)
            c = answered(WORD, u, given[WORD], parts, depth)[at.ravel()]
            doc = np.repeat(np.arange(len(texts)), n)
            logs = np.bincount(doc, np.log10(c + 1.0), len(texts)) + math.log10(ends + 1.0)
            known = np.bincount(doc, c > 0, len(texts)).astype(np.int64) + (ends > 0)
            columns = [pa.array(ids, mask=null.astype(bool)), pa.array(n + 1), pa.array(known), pa.array(logs), pa.array(bits), pa.array(sizes)]
            yield pa.record_batch(columns, [f.split()[0] for f in SCORED.split(", ")])

    return run


def lm_scores(docs: DataFrame, train: F.Column, depth: int = DEPTH, unit: int = UNIT) -> DataFrame:
    """Score every text of docs(doc_id, text, ...) under a tree trained on the rows where `train` holds.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability),
    bits_per_byte. Null text is empty (its end symbol alone is scored). Rows stay as they come, whatever ids
    they repeat or lack, and a repeated row is learned from and scored as often as it is there; a null `train` is false;
    other columns of docs are ignored. Without training rows every estimate is the uniform one, and so is the baseline.
    Costs are exact to 2**-19 bits a byte; words are told apart by 63 bits of a hash.
    """
    spark = docs.sparkSession
    sc, parts = spark.sparkContext, min(partitions(spark), 32768)
    given = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("learn"))
    ends = given.filter("learn").count()
    asked = saved(given.mapInArrow(trimmed(tallied(parts, depth, unit)), ROWS), "units")
    owned = asked.filter(F.col("kind") != TEXT).select("kind", "bucket", "unit", "blob").repartitionById(parts, "bucket")
    above, tokens, distinct = above_of(owned.mapInArrow(trimmed(below(depth)), ABOVE).toLocalIterator(), depth)
    tokens, distinct = tokens + ends, distinct + (ends > 0)
    back = owned.mapInArrow(trimmed(answers(sc.broadcast(above), depth)), ROWS)
    met = asked.filter(F.col("kind") == TEXT).union(back).repartition(parts, "unit").sortWithinPartitions("unit", "kind")
    rows = met.mapInArrow(trimmed(scored(parts, depth, ends)), SCORED)
    return rows.select(
        "doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * math.log10(tokens + distinct + 1)).alias("base_score"),
        (F.col("bits") * -LOG10_2).alias("score"), (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte. Edge cases as in lm_scores."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = remainder("doc_id", 7) == 2
    return lm_scores(docs, ~held).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
