"""Scores summed where a document lies, and the cut before the shuffle."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from quillon.operators import index, lexical


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def words(spark, tmp_path):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices("abcdefghij", k=rng.randrange(1, 60)))) for i in range(50)] + [(7, "b b z"), (None, "b c"), (None, "z"), (90, None)]
    index.write_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), str(tmp_path), "plain")
    asked = [(i, " ".join(rng.choices("abcdefghijz", k=rng.randrange(1, 9)))) for i in range(12)]
    tf = {}
    for d, text in docs:
        tf.setdefault(d, Counter()).update((text or "").split())
    return index.read_index(spark, str(tmp_path)), spark.createDataFrame(asked, "item_id long, text string"), tf, dict(asked)


def test_rows_that_repeat_an_id_are_one_document(words):
    i, _, tf, _ = words
    assert {r.doc_id: {t.term: t.tf for t in r.terms} for r in i.documents.collect()} == {d: dict(c) for d, c in tf.items()}
    assert {r.doc_id: r.dl for r in i.lengths.collect()} == {d: sum(c.values()) for d, c in tf.items()}
    assert i.corpus.first().n_docs == len(tf) == 52


@pytest.mark.parametrize("batch", [3, 10_000])
def test_scores_are_summed_without_a_shuffle(spark, words, monkeypatch, batch):
    """Documents over several batches and queries over several passes; before, all pairs of a query's term and a document were shuffled."""
    i, asked, tf, texts = words
    monkeypatch.setattr("quillon.operators.index.BLOCK", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = Counter(t for c in tf.values() for t in c)
        want = {(q, d): sum(math.log(c[t] + 1) * math.log(len(tf) / df[t]) for t in text.split() if c[t]) for q, text in texts.items() for d, c in tf.items() if any(c[t] for t in text.split())}
        c = lexical.Lexical(i, asked, "plain")
        scores = c.tfidf()
        assert {(r.item_id, r.doc_id): pytest.approx(r.score) for r in scores.collect()} == want and "hashpartitioning" not in plan(scores)
        assert {(r.item_id, r.doc_id): r.score for r in c.coordination().collect()} == {(q, d): sum(tf[d][t] > 0 for t in set(texts[q].split())) for q, d in want}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_the_cut_keeps_the_first_of_a_ranking(words):
    i, asked, _, _ = words
    for k in (1, 4, 30):
        for norm in (False, True):
            every, cut = (lexical.ranked(lexical.Lexical(i, asked, "plain", top).coordination(norm), k).collect() for top in (None, k))
            assert sorted(map(tuple, every)) == sorted(map(tuple, cut))


def test_ties_in_the_cut():
    rng = np.random.default_rng(1)
    item, doc = rng.integers(0, 5, 4000), rng.permutation(4000)
    score = rng.integers(0, 9, 4000) * 1e-6 + rng.integers(-4, 5, 4000) * 1e-7
    kept = set(lexical.first_ones(item, doc, score, 20).tolist())
    for i in range(5):
        rows = sorted(np.flatnonzero(item == i), key=lambda r: (-round(score[r], 6), doc[r]))[:20]
        assert kept >= set(rows)
    assert len(lexical.first_ones(np.zeros(1000, int), np.arange(1000), np.ones(1000), 20)) == 20
