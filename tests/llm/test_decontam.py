"""Benchmark decontamination against exhaustive comparison, planted copies and planted paraphrases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quillon.llm import decontam

FOLDER = "/root/testdata/sf0.001"
CHECKS = (decontam.COVER, decontam.ANSWER_COVER, decontam.ANSWER_SHARE)
ITEMS, DOCS = "item_id long, text string", "doc_id long, text string"


def exhaustive(text, items, cover=CHECKS):
    """All (document, item) whose comparison at any passage succeeds, without candidates."""
    asked = [decontam.Item(i, t.encode()) for i, t in items if t and decontam.worded([t.encode()])[0].size]
    out = set()
    for d, t in text.items():
        words = decontam.worded([(t or "").encode()])[0]
        for item in asked:
            for p in range(max(1, -(-len(words) // 32) - 1)):
                if len(words) and item.share(words[max(0, p - item.reach) * 32 : (p + 2 + item.reach) * 32], cover):
                    out.add((d, item.number))
    return out


def hits(df):
    return {r.doc_id: r.item_id for r in df.filter("contaminated").collect()}


def plain_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ([f"w{rng.randrange(6)}" for _ in range(rng.randrange(1, 40))] for _ in range(2))
        item, words = decontam.Item(1, " ".join(a).encode()), decontam.worded([" ".join(b).encode()])[0]
        assert item.common(words.tolist()) == plain_subsequence(a, b)


def test_words_and_their_hashes(monkeypatch):
    texts = [b"", b"One, two;two  THREE_4\n", "Été à l'École — naïve".encode(), b"!!", b"x" * 50, b"two one"]
    split = [["one", "two", "two", "three_4"], ["été", "à", "l", "école", "—", "naïve"], ["x" * 50], ["two", "one"]]
    alone = {w: decontam.worded([w.encode()])[0][0] for ws in split for w in ws}
    assert len(set(alone.values())) == len(alone)
    for stretch in (1 << 20, 7):
        monkeypatch.setattr(decontam, "STRETCH", stretch)
        got = decontam.worded(texts)
        assert [g.size for g in got] == [0, 4, 6, 0, 1, 2]
        assert [g.tolist() for g in got if g.size] == [[alone[w] for w in ws] for ws in split]


def test_given_documents(spark):
    docs, items = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "benchmark"))
    norm = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    asked = {r.item_id: norm(r.text) for r in items.collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    want = {d for d, t in text.items() if any(q in norm(t) for q in asked.values())}
    got = hits(decontam.contaminated(docs, items))
    assert want <= set(got) and len(set(got) - want) <= 1
    assert {(d, i) for d, i in got.items()} <= exhaustive(text, [(r.item_id, r.text) for r in items.collect()])


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(6000)]
    return rng, lambda n: [vocabulary[int(6000 * rng.random() ** 2)] for _ in range(n)]


def test_many_items_take_several_spaces(spark, prose):
    """More items than one space holds: all copies are found."""
    rng, words = prose
    items = [(i, " ".join(words(rng.randint(15, 45)))) for i in range(700)]
    text = {}
    for d in range(120):
        host, own = words(200), items[rng.randrange(700)][1].split()
        text[d] = " ".join(host[: d + 20] + own + host[d + 20 :]) if d < 60 else " ".join(host)
    frames = spark.createDataFrame(list(text.items()), DOCS), spark.createDataFrame(items, ITEMS)
    assert set(hits(decontam.contaminated(*frames, block=200))) == set(range(60))


@pytest.mark.parametrize("n", [99, 101])
def test_rows_are_the_same_on_both_sides_of_a_block(spark, n):
    """Repeated rows, null ids and null texts stay as they come, with one block of queries or two."""
    items = [(i, " ".join(f"q{i}x{j}" for j in range(20))) for i in range(n)]
    copy = "before it " + items[n - 1][1] + " after it"
    rows = [(1, copy), (1, copy), (None, copy), (None, None), (2, None), (3, ""), (3, "clean words here"), (4, items[0][1])]
    found = decontam.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS), rank=64, block=100)
    got = sorted(((r.doc_id, r.contaminated, r.item_id, r.n_items) for r in found.collect()), key=str)
    assert got == sorted([(1, True, n - 1, 1)] * 2 + [(None, True, n - 1, 1), (None, False, None, 0), (2, False, None, 0), (3, False, None, 0), (3, False, None, 0), (4, True, 0, 1)], key=str)


def test_long_items(spark):
    """Items of 30 to 2000 words, whole and three quarters of them, and a third, which is too little."""
    sizes = (30, 64, 65, 100, 180, 190, 240, 300, 700, 2000)
    item = lambda k, n: [f"item{k}x{i}" for i in range(n)]
    items = [(k, " ".join(item(k, n))) for k, n in enumerate(sizes)]
    text = {}
    for k, n in enumerate(sizes):
        for j, part in enumerate((item(k, n), item(k, n)[: n * 3 // 4], item(k, n)[: n // 3])):
            text[10 * k + j] = " ".join([f"a{i}" for i in range(77 + 13 * k)] + part + [f"z{i}" for i in range(91)])
    got = hits(decontam.contaminated(spark.createDataFrame(list(text.items()), DOCS), spark.createDataFrame(items, ITEMS)))
    assert got == {10 * k + j: k for k in range(len(sizes)) for j in range(2)}


def test_recall_on_paraphrases(spark, prose):
    """Items with words dropped, added and changed in common prose: at least 0.9 of what the exhaustive comparison finds."""
    rng, words = prose
    items = [(i, " ".join(words(rng.randint(20, 120)))) for i in range(150)]
    text = {}
    for d in range(140):
        own = []
        for w in items[d][1].split():
            r = rng.random()
            own += [] if r < 0.08 else [words(1)[0]] if r < 0.16 else [w, words(1)[0]] if r < 0.2 else [w]
        host, at = words(rng.randint(60, 500)), rng.randrange(50)
        text[d] = " ".join(host[:at] + own + host[at:])
    text |= {1000 + d: " ".join(words(300)) for d in range(60)}
    want = exhaustive(text, items)
    got = hits(decontam.contaminated(spark.createDataFrame(list(text.items()), DOCS), spark.createDataFrame(items, ITEMS)))
    assert len(want) > 110 and set(got.items()) <= want
    assert len(set(got.items()) & want) >= 0.9 * len(want)
    assert not {d for d in got if d >= 1000}


def test_ties_go_to_the_least_id_and_clashing_names(spark):
    same = " ".join(f"tie{i}" for i in range(25))
    docs = spark.createDataFrame([(7, same, 1, "x", 2.0, 5)], "doc_id long, text string, row int, item_id string, cosine double, n int")
    items = spark.createDataFrame([(9, same), (3, same), (3, "zz later text of the same id"), (None, same), (5, None), (6, "  ")], ITEMS)
    r = decontam.contaminated(docs, items, rank=16).first()
    assert (r.item_id, r.n_items, r.lcs_share) == (3, 2, 1.0)
    assert decontam.contaminated(docs, items, rank=16, carry=("n", "doc_id", "text")).first().asDict().items() >= {"doc_id": 7, "text": same, "n": 5, "n_items": 2}.items()
    with pytest.raises(ValueError, match="cosine"):
        decontam.contaminated(docs, items, carry=("doc_id", "cosine"))
    assert decontam.contaminated(docs, items.limit(0), rank=16).first().contaminated is False
    assert decontam.contaminated(docs.limit(0), items, rank=16).count() == 0 and decontam.contaminated(docs.limit(0), items.limit(0)).count() == 0


def test_memory_of_a_long_text():
    """A text of 400,000 different words is taken in runs of passages."""
    import tracemalloc

    words = [f"w{i}x{i * 7 % 1009}" for i in range(400_000)]
    text = " ".join([*words[:200_000], *(f"needle{i}" for i in range(30)), *words[200_000:]])
    item = decontam.Item(4, " ".join(f"needle{i}" for i in range(30)).encode())
    idf = np.ones(1 << decontam.TERM_BITS, np.float32)
    matrix = np.zeros((1 << decontam.TERM_BITS, 1), np.float32)
    term, w = decontam.unit(np.array([k for k in item.mask], np.uint64), idf)
    matrix[term, 0] = w
    model = type("B", (), {"value": (matrix, idf, [4], [" ".join(f"needle{i}" for i in range(30)).encode()], [0])})
    batch = pa.record_batch([pa.array([1]), pa.array([text])], ["doc_id", "text"])
    tracemalloc.start()
    out = list(decontam.searched(model, (decontam.COSINE, *CHECKS), ["doc_id"])(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out[0]["contaminated"].to_pylist() == [True] and peak < 40 * len(text)


def test_space_is_fitted_on_all_documents(spark, monkeypatch):
    """Passages that differ from all others lie in the space, in whichever of 2100 documents they are, with one block of queries or two."""
    own = [" ".join(f"own{d}x{i}" for i in range(5)) for d in range(100)]
    rows = [(d, own[d] if d < 100 else "words that all the others hold") for d in range(2100)]
    items = [(i, " ".join(f"q{i}x{j}" for j in range(20))) for i in range(4)]
    spaces, fit = [], decontam.fit
    monkeypatch.setattr(decontam, "fit", lambda *a, **k: spaces.append(fit(*a, **k)) or spaces[-1])
    for block in (4, 3):
        decontam.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS), block=block)
    assert len(spaces) == 3
    for basis in spaces:
        for text in own:
            term, w = decontam.unit(decontam.worded([text.encode()])[0], np.ones(1 << decontam.TERM_BITS, np.float32))
            assert np.linalg.norm(w @ basis[term]) > 0.99


def test_passages_of_many_texts(monkeypatch):
    """They are those of a plain count, whatever is taken at once."""
    rng = np.random.default_rng(3)
    idf = rng.random(1 << decontam.TERM_BITS).astype(np.float32) + np.float32(0.1)
    texts = [np.minimum(rng.zipf(1.3, n), (1 << decontam.TERM_BITS) - 1) for n in (0, 1, 31, 32, 33, 64, 65, 0, 700, 96, 97, 0)]
    want = {}
    for i, t in enumerate(texts):
        for p in range(max(1, -(-len(t) // 32) - 1) if len(t) else 0):
            term, count = np.unique(t[32 * p : 32 * p + 64], return_counts=True)
            want[i, p] = dict(zip(term.tolist(), count * idf[term] / np.linalg.norm(count * idf[term])))
    for run, cells in ((1, 1), (4, 1), (4, 3000), (16, 1 << 20)):
        monkeypatch.setattr(decontam, "CELLS", cells)
        got = [(i, p + j, {k: v for k, v in zip(own.tolist(), row) if v}) for i, p, own, rows in decontam.passages(texts, idf, run) for j, row in enumerate(rows)]
        assert [(i, p) for i, p, _ in got] == list(want)
        assert all(row == pytest.approx(want[i, p], rel=1e-5) for i, p, row in got)


def test_short_texts_do_not_take_a_count_each(monkeypatch):
    """400 short texts are sorted and counted together, for the document frequencies and in the search."""
    item = b"one two three four"
    idf, matrix = np.ones(1 << decontam.TERM_BITS, np.float32), np.zeros((1 << decontam.TERM_BITS, 1), np.float32)
    term, w = decontam.unit(decontam.worded([item])[0], idf)
    matrix[term, 0] = w
    model = type("B", (), {"value": (matrix, idf, [4], [item], [0])})
    texts = [f"a{i} b c d e" if i % 40 else f"a{i} {item.decode()}" for i in range(400)]
    batch = pa.record_batch([pa.array(range(400)), pa.array(texts)], ["doc_id", "text"])
    calls = []
    for name in ("bincount", "unique"):
        monkeypatch.setattr(np, name, lambda *a, own=getattr(np, name), **k: calls.append(1) or own(*a, **k))
    (found,) = decontam.frequencies(iter([batch]))
    assert np.frombuffer(found.column("df")[0].as_py(), np.int64).sum() == 2000
    (out,) = decontam.searched(model, (decontam.COSINE, *CHECKS), ["doc_id"])(iter([batch]))
    assert [d for d, hit in zip(out["doc_id"].to_pylist(), out["contaminated"].to_pylist()) if hit] == list(range(0, 400, 40))
    assert len(calls) < 40


def test_query_holds_its_columns(spark):
    got = decontam.op10_decontamination(spark, FOLDER)
    assert got.columns == ["doc_id", "contaminated", "item_id", "n_items", "lcs_share", "cosine"]
    assert got.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count() and got.filter(F.col("contaminated") & F.col("item_id").isNull()).isEmpty()
