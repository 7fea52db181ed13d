"""Removal of repeated byte strings against brute force."""

import hashlib
import random
import resource

import numpy as np
import pyarrow as pa
import pytest
from quillon.llm import repeats

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 997} alpha{i % 13}" for i in range(6000))
TEXTS = ["", None, "   \n\t ", "one two three", "One TWO three", LONG, LONG + " more", "a" * 350, "7 8 9 !!", "été à la plage " * 20, LONG[:900], LONG[:900] + " tail " + LONG[:300]]


def brute(text, window):
    seen, out = set(), {}
    for i in sorted(text):
        b = (text[i] or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            w = b[s : s + window]
            if w in seen:
                gone[s : s + window] = b"\1" * window
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for j in range(len(gone)) if gone[j] and not (j and gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def removed(df):
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows if r.doc_id is not None}


def frame(spark, text, n=4):
    return spark.createDataFrame(list(text.items()), "doc_id long, text string").repartition(n)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert removed(repeats.repeated_spans(docs)) == brute({r.doc_id: r.text for r in docs.collect()}, 100)


def test_edges(spark):
    """Nulls, empty and short texts, a null id, clashing columns, repeated rows, no rows."""
    schema = "doc_id long, text string, starts int, ends string, bucket int, kind string, blob string"
    rows = [(i, t, 1, "x", 2, None, "b") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([*rows, (None, LONG, 0, "", 0, "", "")], schema)
    assert removed(repeats.repeated_spans(df)) == brute(dict(enumerate(TEXTS)), 100)
    loose = [r for r in repeats.repeated_spans(df).collect() if r.doc_id is None]
    assert [(r.n_bytes, r.n_removed) for r in loose] == [(len(LONG), 0)]
    assert repeats.repeated_spans(spark.createDataFrame([], schema)).count() == 0
    twice = [r for r in repeats.repeated_spans(df.union(df.filter("doc_id = 6"))).collect() if r.doc_id == 6]
    assert len(twice) == 2 and len({(r.n_removed, r.kept_sha256) for r in twice}) == 1


def test_periodic(spark):
    text = {1: "ab" * 90 + "c", 2: "x" + "ab" * 60, 3: "line of text shared by all " * 6, 4: "zz" + "line of text shared by all " * 5, 5: "q" * 99, 6: "q" * 100, 7: "q" * 101, 8: "\0" * 230, 9: "q" + "\0" * 130}
    assert removed(repeats.repeated_spans(frame(spark, text))) == brute(text, 100)


@pytest.mark.parametrize(("seed", "piece", "crowd"), [(1, 1 << 20, 4096), (2, 150, 4096), (3, 1 << 20, 3), (4, 130, 3)])
def test_passages_in_pieces_and_crowds(spark, monkeypatch, seed, piece, crowd):
    """Shared passages at random places; small pieces cut runs, and a low bound deals digits by their windows."""
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randrange(15, 120))) for _ in range(6)]
    text = {}
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 40))) for _ in range(4)]
        for p in rng.choices(passages, k=2):
            a = rng.randrange(len(p))
            parts.insert(rng.randrange(5), p[a : a + rng.randrange(len(p))] if rng.random() < 0.5 else p)
        text[i * 7 - 100] = "".join(parts)
    text[999] = text[5]
    assert removed(repeats.repeated_spans(frame(spark, text, 6), piece=piece)) == brute(text, 100)


def test_radix_order_against_sets():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 2, 4000).astype(np.uint8)
    size = rng.integers(1, 40, 3000)
    start = rng.integers(0, len(data) - 40, 3000)
    digit = (rng.integers(0, 3, 3000)).astype(np.uint64)
    got = repeats.ordered(data, start, size, digit)
    want: dict = {}
    named = [want.setdefault((int(d), data[s : s + n].tobytes()), len(want)) for s, n, d in zip(start, size, digit)]
    assert len(set(zip(got.tolist(), named))) == len(set(got.tolist())) == len(want)


def test_fingerprints_never_decide(spark, monkeypatch):
    """With a fingerprint of two values everything meets, and bytes still tell it apart."""
    plain = repeats.Prints.each
    monkeypatch.setattr(repeats.Prints, "each", lambda self, width: plain(self, width) & np.uint64(1 << 63))
    rng = random.Random(5)
    data = "".join(rng.choice("ab") for _ in range(700))
    text = {i: data[a : a + rng.randrange(90, 260)] for i, a in enumerate(rng.randrange(500) for _ in range(25))}
    batch = pa.record_batch([pa.array(list(text)), pa.array(list(text.values()))], ["doc_id", "text"])
    rows = list(repeats.sort_runs(2, 100, 32, 1 << 20)(iter([batch])))
    met = list(repeats.meet(1, 100)(iter(rows)))
    kinds = lambda batches, k: [b.filter(pa.array([x == k for x in b["kind"].to_pylist()])) for b in batches]
    left = pa.Table.from_batches(list(repeats.left_over(iter(kinds(met, repeats.KNOWN)))))
    by = {d: (s, e) for d, s, e in zip(*(left[c].to_pylist() for c in ("doc_id", "starts", "ends")))}
    again = pa.record_batch([pa.array(list(by)), pa.array([text[d] for d in by]), pa.array([by[d][0] for d in by]), pa.array([by[d][1] for d in by])], ["doc_id", "text", "starts", "ends"])
    none = type("B", (), {"value": np.zeros(0, np.uint64)})
    sent = list(repeats.send_bytes(1, 100, 32, none)(iter([again])))
    spans = list(repeats.sort_bytes(1, 100)(iter(sent)))
    found = pa.Table.from_batches(list(repeats.spans_of(iter([*kinds(met, repeats.SPAN), *spans]))))
    got = {d: sum(e - s for s, e in zip(*x)) for d, *x in zip(*(found[c].to_pylist() for c in ("doc_id", "starts", "ends")))}
    assert {d: got.get(d, 0) for d in text} == {d: r[1] for d, r in brute(text, 100).items()}


def test_one_long_text_needs_no_memory_of_its_size_times():
    """40 MB as one text: a task's peak grows by a small multiple of what a flush holds, not of the text."""
    rng = np.random.default_rng(4)
    text = rng.integers(97, 123, 40 << 20).astype(np.uint8).tobytes().decode()
    batch = pa.record_batch([pa.array([1]), pa.array([text])], ["doc_id", "text"])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    n = sum(b.num_rows for b in repeats.sort_runs(16, 100, 32, 1 << 20)(iter([batch])))
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
    assert n and grown < 500, grown
