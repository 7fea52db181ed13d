"""The n-gram Jaccard join against brute force: small, awkward, borderline and unevenly dealt tables."""

import hashlib
import random

import numpy as np
import pytest
from quillon.llm import jaccard
from quillon.llm.blocks import bundle, unbundle

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, tokens string, block int, label string, bucket string"
LONG = " ".join(f"w{i % 997} alpha{i % 13}" for i in range(6000))


def sets_of(text):
    out = {}
    for i, t in text.items():
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute(text):
    """(n_shingles, component_id) by id, and all linked pairs."""
    sets = sets_of(text)
    parent = {i: i for i in sets}
    pairs = set()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                pairs.add((a, b))
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}, pairs


def classes(df):
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def mixture(seed, groups=6, size=14):
    """Near copies with so many edits that similarities lie on both sides of 0.75, over passages that all share."""
    rng = random.Random(seed)
    license_ = [f"lic{i}" for i in range(25)]
    rows = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(rng.randrange(12, 90))]
        for k in range(size):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            if k % 3 == 0:
                words += license_
            rows.append(" ".join(words))
    rows += [" ".join(license_ + [f"own{k}x{i}" for i in range(6)]) for k in range(20)]
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize(("block", "few"), [(256, 16), (3, 2)])
def test_given_documents(docs, block, few):
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert classes(jaccard.jaccard_links(docs, block=block, few=few)) == brute(text)[0]


@pytest.mark.parametrize(("seed", "block", "few"), [(1, 256, 16), (2, 5, 2), (3, 4, 1)])
def test_borderline_groups(spark, seed, block, few):
    rows = mixture(seed)
    want, _ = brute(dict(rows))
    assert classes(jaccard.jaccard_links(frame(spark, rows).repartition(5), block=block, few=few)) == want


def test_all_pairs(spark):
    rows = mixture(4, groups=4)
    df = frame(spark, rows).repartition(5)
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    _, pairs = brute({i: t for t, i in first.items()})
    for block, few in ((256, 16), (4, 2)):
        got = [(r.a, r.b) for r in jaccard.jaccard_pairs(df, block=block, few=few).collect()]
        assert len(got) == len(set(got)) and set(got) == pairs


def test_chain_that_its_ends_do_not_share(spark):
    """Each text links with the next one only, so the class is held together by every single link."""
    words = [f"c{i}" for i in range(200)]
    rows = [(50 - k, " ".join(words[4 * k : 4 * k + 60])) for k in range(30)]
    want, pairs = brute(dict(rows))
    assert len(pairs) >= 29 and len({c for _, c in want.values()}) == 1
    for block, few in ((256, 16), (4, 1)):
        assert classes(jaccard.jaccard_links(frame(spark, rows), block=block, few=few)) == want


def test_near_group(spark):
    base = [f"word{i}" for i in range(80)]
    rows = [(i, " ".join(base[:70] + [f"x{i}", f"y{i}"])) for i in range(40)] + [(100 + i, f"lone{i} a b c d e f g {i}") for i in range(5)]
    for block in (7, 256):
        assert classes(jaccard.jaccard_links(frame(spark, rows), block=block, few=2)) == brute(dict(rows))[0]


def test_copies_apart_and_repeated_rows(spark):
    """Copies that different tasks read, rows that repeat, and an id with two texts of which the least digest counts."""
    base = [" ".join(f"t{g}w{i}" for i in range(60)) for g in range(4)]
    rows = [(7 * i + 3, base[i % 4] + (" end" if i % 5 == 0 else "")) for i in range(120)] + [(5000 + i, f"alone {i} " * 9) for i in range(20)]
    two = sorted([base[0], "another text of its own with words enough"], key=lambda t: hashlib.md5(t.encode()).hexdigest())
    df = frame(spark, [*rows, *rows[:30], (9000, two[0]), (9000, two[1]), (9001, "")]).repartition(7)
    assert classes(jaccard.jaccard_links(df)) == brute(dict([*rows, (9000, two[0]), (9001, "")]))[0]


def test_edges(spark):
    """Null and empty texts, a null id, a text of 1.2 MB beside a near copy of it, and clashing columns."""
    huge = " ".join(f"h{i % 90001}" for i in range(200_000))
    texts = ["", None, "   \n\t ", "one two three", "One TWO three", LONG, LONG + " more", "a" * 350, "7 8 9 !!", "été à la plage", LONG[:900], huge, huge + " end"]
    rows = [(i, t, "en", None, None, i, "x", 1, "l", "b") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (None, "no id at all but six words", None, None, None, 0, "", 0, "", ""), (None, None, None, None, None, 0, "", 0, "", "")], SCHEMA)
    got = jaccard.jaccard_links(df).collect()
    assert sorted((r.n_shingles, r.component_id) for r in got if r.doc_id is None) == [(0, None), (3, None)]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute(dict(enumerate(texts)))[0]
    none = spark.createDataFrame([], SCHEMA)
    assert jaccard.jaccard_links(none).count() == 0 and jaccard.jaccard_pairs(none).count() == 0


def test_rows_do_not_follow_partitions(spark):
    """What goes from shingles to documents is a row for each task and group of documents, at any number of tasks."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hot = spark.sparkContext.broadcast(jaccard.frequent(docs, docs.count(), 5))
    made = {}
    for parts in (4, 51, 200):
        blocks = docs.mapInArrow(jaccard.dealt(parts, 5, hot), jaccard.BLOBS).repartitionById(parts, "bucket")
        made[parts] = blocks.mapInArrow(jaccard.shared(1), jaccard.BLOBS).count()
    assert all(n <= parts for parts, n in made.items())


def test_frequent_shingles_change_nothing(spark, monkeypatch):
    rows = mixture(6)
    want, _ = brute(dict(rows))
    plain = jaccard.frequent
    assert len(plain(frame(spark, rows), len(rows), 5)[0]) > 0
    monkeypatch.setattr(jaccard, "frequent", lambda docs, total, width: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    assert classes(jaccard.jaccard_links(frame(spark, rows))) == want


def test_bundles():
    rng = np.random.default_rng(1)
    for columns in (
        [np.arange(5), np.array([3, 1 << 50, -7])],
        [np.zeros(0, np.int64), np.array([-(1 << 63), (1 << 63) - 1])],
        [rng.integers(-(1 << 62), 1 << 62, 1000), np.full(3, -9)],
    ):
        back = unbundle(bundle(*columns))
        assert len(back) == len(columns) and all((a == b).all() and len(a) == len(b) for a, b in zip(back, columns))
