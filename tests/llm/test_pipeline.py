"""The pipeline: each stage against plain Python on its own input, on given and on awkward tables."""

import random
import re

import corpus_pipeline as p
import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingled(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def least_of_group(text):
    """For each id the least id reachable by links."""
    sets = {i: shingled(t) for i, t in text.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_pipeline_rejects_what_is_in_no_learned_language(spark):
    import random

    import corpus_pipeline as p

    rng = random.Random(2)
    folder = "/root/testdata/sf0.01"
    known = spark.read.parquet(f"{folder}/documents.parquet").select(p.COLUMNS)
    soup = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)) for n in (60, 400, 3000)]
    other = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", "Все люди рождаются свободными и равными в своем достоинстве и правах"]
    rows = spark.createDataFrame([(10**9 + i, t, None, "s", len(t)) for i, t in enumerate(soup + other)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in p.identified(spark, known.union(rows), folder).select("doc_id").collect()}
    assert not {i for i in kept if i >= 10**9} and len(kept) > 0.98 * known.count()
    some = known.filter("lang <> 'fr'").union(known.filter("lang = 'fr'").withColumn("lang", F.lit(None).cast("string")))
    kept = p.identified(spark, some, folder).join(known.select("doc_id", F.col("lang").alias("true")), "doc_id").groupBy("true").count().collect()
    kept = {r.true: r["count"] for r in kept}
    whole = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    assert kept.get("fr", 0) < 0.1 * whole["fr"] and all(kept[k] > 0.97 * n for k, n in whole.items() if k != "fr")


def test_whole(spark):
    assert [n for n, _ in p.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "mixing"]
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r.doc_id: r for r in p.run(spark, FOLDER).collect()}
    groups = least_of_group(text)
    items = [" ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    norm = {i: " ".join(re.findall(r"\w+", t.lower())) for i, t in text.items()}
    left = {i for i in text if groups[i] == i and not any(q in norm[i] for q in items)}
    assert set(got) <= left and len(got) > 0.9 * len(left)
    assert all("@" not in r.text or not re.search(r"[a-z]+@[a-z]+\.[a-z]+", r.text) for r in got.values())


@pytest.fixture(scope="module")
def awkward(spark):
    """The given documents with null, empty, repeated, very long and clashing rows among them."""
    known = spark.read.parquet(f"{FOLDER}/documents.parquet").select(p.COLUMNS)
    some = [r for r in known.orderBy("doc_id").collect() if r.text and len(r.text) > 200]
    huge = " ".join(r.text for r in some) * 3
    rows = [(None, some[0].text, "en", "s", 1), (None, None, None, None, None), (9001, None, "en", "s", 0), (9002, "", "en", None, 0), (9003, huge, some[0].lang, "s", len(huge)),
            (9004, some[1].text, some[1].lang, "s", 1), (9004, some[1].text, some[1].lang, "s", 1), (9005, "to a@b.cd " + some[2].text, None, None, None)]
    return known.union(spark.createDataFrame(rows, SCHEMA)).repartition(5)


def test_every_stage_on_awkward_rows(spark, awkward, tmp_path):
    docs, left = awkward, {}
    for name, stage in p.STAGES[:-1]:
        docs = p.saved(stage(spark, docs, FOLDER), name)
        assert docs.columns == p.COLUMNS
        left[name] = docs.collect()
    ids = {name: [r.doc_id for r in rows] for name, rows in left.items()}
    assert None not in ids["language_id"] and not {9001, 9002} & set(ids["language_id"]) and {9003, 9005} <= set(ids["language_id"]) and ids["language_id"].count(9004) == 2
    groups = least_of_group({r.doc_id: r.text for r in left["language_id"]})
    assert sorted(ids["near_duplicates"]) == sorted({i for i in groups if groups[i] == i})
    items = [" ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    norm = {r.doc_id: " ".join(re.findall(r"\w+", r.text.lower())) for r in left["near_duplicates"]}
    clean = {i for i, t in norm.items() if not any(q in t for q in items)}
    assert set(ids["decontamination"]) <= clean and len(clean - set(ids["decontamination"])) <= 1
    assert sorted(ids["personal_data"]) == sorted(ids["decontamination"])
    was = {r.doc_id: r for r in left["decontamination"]}
    for r in left["personal_data"]:
        assert r.n_chars == len(r.text) and (r.lang, r.source) == (was[r.doc_id].lang, was[r.doc_id].source)
        assert not re.search(r"[a-z]+@[a-z]+\.[a-z]+", r.text)
    mixed = p.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert len({r.doc_id for r in mixed}) == len(mixed) and {r.doc_id for r in mixed} <= set(ids["personal_data"]) and all(r.copies > 0 for r in mixed)
    drawn = {r.doc_id: r.copies for r in p.mixture(docs).collect()}
    assert {r.doc_id: r.copies for r in mixed} == {i: c for i, c in drawn.items() if c > 0}


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in p.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
    assert p.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert p.clean_of_benchmark(spark, docs, str(tmp_path)).count() == docs.count()
    assert docs.filter(F.col("doc_id") < 0).count() == 0
