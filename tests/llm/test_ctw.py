"""Context-tree weighting against a direct recursion in plain Python, the word baseline, and growth with the corpus."""

import collections
import math
import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quillon.llm import ctw
from quillon.llm.blocks import remainder

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, learn boolean, kind string, unit int, data string, bucket int"


def normal(t):
    return b" ".join((t or "").encode().lower().split()) + b"\n"


def tokens(t):
    return (t or "").encode().lower().split() + [b"\n"]


def brute(learned, asked, depth):
    """log10 probability of each asked text under a tree of all contexts of the learned ones."""
    counts = collections.defaultdict(lambda: [0, 0])
    children = collections.defaultdict(set)
    for t in learned:
        data = bytes(depth) + normal(t)
        for i in range(depth, len(data)):
            context = data[i - depth : i][::-1]
            for d in range(depth + 1):
                if d:
                    children[context[: d - 1]].add(context[:d])
                node = 1
                for k in range(7, -1, -1):
                    bit = data[i] >> k & 1
                    counts[context[:d], node][bit] += 1
                    node = 2 * node + bit

    def own(context, node):
        a, b = counts.get((context, node), (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @lru_cache(None)
    def weighted(context, node):
        e = own(context, node)
        if len(context) == depth:
            return e
        return float(np.logaddexp(e, sum(weighted(c, node) for c in children.get(context, ())))) - math.log(2)

    @lru_cache(None)
    def one(context, node, d):
        a, b = counts.get((context[:d], node), (0, 0))
        p = (b + 0.5) / (a + b + 1)
        if d == depth:
            return p
        w = math.exp(own(context[:d], node) - math.log(2) - weighted(context[:d], node))
        return w * p + (1 - w) * one(context, node, d + 1)

    out = []
    for t in asked:
        data, total = bytes(depth) + normal(t), 0.0
        for i in range(depth, len(data)):
            context, node = data[i - depth : i][::-1], 1
            for k in range(7, -1, -1):
                bit = data[i] >> k & 1
                p = one(context, node, 0)
                total += math.log10(p if bit else 1 - p)
                node = 2 * node + bit
        out.append(total)
    return out


def texts_of(seed, n=30):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7))) for _ in range(25)] + ["é\U0001f600", "A", "\0"]
    return [None, "", "  \t"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


@pytest.mark.parametrize(("depth", "unit", "piece"), [(1, 8 << 20, 2 << 20), (2, 300, 64), (4, 200, 17), (6, 8 << 20, 2 << 20), (6, 500, 40)])
def test_scores_of_a_tree_built_by_recursion(spark, monkeypatch, depth, unit, piece):
    """End to end, units and pieces that cut texts included: exact to the packing."""
    monkeypatch.setattr(ctw.grams, "__defaults__", (piece,))
    texts = texts_of(depth)
    df = spark.createDataFrame([(i, t, i % 3 != 2) for i, t in enumerate(texts)], "doc_id long, text string, learn boolean").repartition(3)
    got = {r.doc_id: r for r in ctw.lm_scores(df, F.col("learn"), depth, unit).collect()}
    want = brute([t for i, t in enumerate(texts) if i % 3 != 2], texts, depth)
    for i, (t, w) in enumerate(zip(texts, want)):
        assert got[i].score == pytest.approx(w, abs=1e-4), (i, t)
        assert got[i].bits_per_byte == pytest.approx(-w / math.log10(2) / len(normal(t)), abs=1e-4)


def test_probabilities_add_up():
    """After each context the 256 bytes share exactly one."""
    rng = np.random.default_rng(1)
    context = rng.integers(0, 4, 60)
    g = np.unique(np.concatenate([(c << 8) | np.arange(256) for c in np.unique(context)]))
    n = np.where(rng.random(len(g)) < 0.05, rng.integers(1, 100_000, len(g)), 0)
    part = ctw.Part(g, n, 1, 1)
    keys, sums = part.sums()
    short, counts = ctw.summed((g >> 16) << 8 | (g & 255), n)
    top = ctw.Part(short, counts.astype(np.int64), 0, 0, (keys, sums))
    at = np.concatenate([top.layer[0].keys(level) for level in range(8)])
    have, left = (np.concatenate(x) for x in zip(*top.mixed(None)))
    order = np.argsort(at)
    cost = part.costs((at[order], have[order], left[order]))
    assert np.bincount(g >> 8, 2.0**-cost) == pytest.approx(1.0, abs=1e-9)


def test_gamma_beyond_the_table():
    for x in (0, 1, 7, ctw.SMALL - 1, ctw.SMALL, 10**7):
        a = np.array([x])
        assert ctw.gamma(a, 0.5, ctw.HALVES)[0] == pytest.approx(math.lgamma(x + 0.5), rel=1e-12, abs=1e-9)
        assert ctw.gamma(a, 1.0, ctw.WHOLES)[0] == pytest.approx(math.lgamma(x + 1), rel=1e-12, abs=1e-9)


def test_base_scores(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r.doc_id: r for r in ctw.lm_scores(docs, remainder("doc_id", 7) != 2).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    count = collections.Counter(x for i, t in text.items() if zlib.crc32(str(i).encode()) % 7 != 2 for x in tokens(t))
    n, v = sum(count.values()), len(count)
    for i, t in text.items():
        assert got[i].base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in tokens(t)), abs=1e-6)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens(t)), sum(count[x] > 0 for x in tokens(t)), n)
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def test_edges(spark):
    """Repeated rows, null ids, null flags, clashing columns, a text of 1 MB, no training rows, no rows."""
    long = " ".join(f"w{i % 997} alpha{i % 13}" for i in range(80_000))
    rows = [(1, "one two", True), (1, "one two", True), (None, "one", True), (None, None, None), (2, None, False), (3, "ONE two", False), (4, long, False), (5, "x" * 300, None)]
    df = spark.createDataFrame([(*r, "k", 1, "d", 2) for r in rows], SCHEMA)
    got = ctw.lm_scores(df, F.col("learn")).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 2
    learned = ["one two", "one two", "one"]
    for r, w in zip(sorted((r for r in got if r.doc_id in (1, 2, 3)), key=lambda r: r.doc_id), brute(learned, ["one two", "one two", None, "ONE two"], 6)):
        assert r.score == pytest.approx(w, abs=1e-4) and r.train_tokens == 8
    uniform = ctw.lm_scores(df, F.lit(False)).collect()
    assert all(r.bits_per_byte == pytest.approx(8, abs=1e-5) and r.n_known == 0 and r.base_score == 0 for r in uniform)
    assert ctw.lm_scores(df.limit(0), F.col("learn")).count() == 0


def test_nodes_grow_with_the_corpus():
    """Owners hold every string: twice the text, more nodes."""
    texts = [t for seed in range(40) for t in texts_of(seed) if t]
    size = []
    for some in (texts[: len(texts) // 2], texts):
        batch = pa.record_batch([pa.array(range(len(some))), pa.array([True] * len(some)), pa.array(some)], ["doc_id", "learn", "text"])
        rows = [b for b in ctw.tallied(1, 6)(iter([batch]))]
        g, n = ctw.merged(ctw.gathered(iter([pa.Table.from_batches(rows).filter(pa.compute.equal(pa.Table.from_batches(rows)["kind"], ctw.GRAM)).combine_chunks().to_batches()[0]]))[ctw.GRAM])
        assert n.sum() == sum(len(normal(t)) for t in some)
        size.append(len(g))
    assert size[1] > 1.3 * size[0]


def test_packing():
    rng = np.random.default_rng(2)
    for keys in (np.zeros(0, np.int64), np.array([5]), np.sort(rng.integers(0, 1 << 62, 1000))):
        values = rng.integers(-5, 1 << 40, len(keys))
        a, b = ctw.unpacked(ctw.packed(keys, values))
        assert (a == keys).all() and (b == values).all()
