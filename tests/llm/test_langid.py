"""Language identification: held-out accuracy, scores against a plain kernel ridge regression, bounds and edges."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quillon.llm import langid
from quillon.llm.blocks import remainder

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, lang_pred string, fits string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_held_out(docs):
    got = langid.languages(docs, remainder("doc_id", 4) != 2).join(docs.select("doc_id", "lang"), "doc_id").filter(remainder("doc_id", 4) == 2).collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95


def grams(text):
    """Distinct 1- to 3-grams in plain Python."""
    t = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} if any(c.isalpha() for c in t) else set()


def test_scores_are_those_of_a_plain_kernel_ridge(docs):
    rows = [(r.text, r.lang) for r in docs.filter("lang is not null and length(text) < 3000").orderBy("doc_id").limit(60).collect() if grams(r.text)]
    asked = [r.text for r in docs.orderBy(F.desc("doc_id")).limit(40).collect()] + ["é", "zz qq"]
    landmarks, names = 5, sorted({lang for _, lang in rows})
    sets, seen, marks = [grams(t) for t, _ in rows], {}, []
    for i, (_, lang) in enumerate(rows):
        seen[lang] = seen.get(lang, 0) + 1
        marks += [i] if seen[lang] <= landmarks else []
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    k = np.array([[kernel(a, sets[m]) for m in marks] for a in sets])
    value, vector = np.linalg.eigh(k[marks])
    good = value > 1e-6 * value.max()
    mapped = k @ vector[:, good] / np.sqrt(value[good])
    target = np.array([[lang == n for n in names] for _, lang in rows], float)
    share = np.array([1 / seen[lang] for _, lang in rows])  # every language weighs the same
    base = (target * share[:, None]).sum(0) / share.sum()
    solved = np.linalg.solve(mapped.T @ (mapped * share[:, None]) + langid.RIDGE * np.eye(good.sum()), mapped.T @ ((target - base) * share[:, None]))
    model = type("B", (), {"value": langid.fitted([t for t, _ in rows], [lang for _, lang in rows], landmarks)})
    batch = pa.record_batch([pa.array(range(len(asked))), pa.array(asked)], ["doc_id", "text"])
    got = list(langid.predicted(model, ["doc_id"])(iter([batch])))[0].to_pylist()
    for text, r in zip(asked, got):
        own = grams(text or "")
        if not own:
            assert r["lang_pred"] == "und" and r["score"] == 0
            continue
        want = np.array([kernel(own, sets[m]) for m in marks]) @ vector[:, good] / np.sqrt(value[good]) @ solved + base
        assert r["score"] == pytest.approx(min(1, max(0, want.max())), abs=2e-3) and r["lang_pred"] in [n for n, w in zip(names, want) if w > want.max() - 4e-3]


def test_edges(spark):
    long = " ".join(f"mot{i % 97} alpha" for i in range(3000))
    texts = ["", None, "   \n\t ", "7 8 9 !!", "one two three", "One TWO three", long, "a" * 350, "été à la plage avec l'ami", "un deux trois", long * 30]
    rows = [(i, t, ["en", None, "fr"][i % 3], None, "x", "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[4], rows[4], (None, "no id", None, None, None, None), (None, None, "en", None, None, None)], SCHEMA)
    got = langid.languages(df, remainder("doc_id", 4) != 2).collect()
    assert len(got) == len(texts) + 4 and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (0, 1, 2, 3)} == {"und"} and all(r.lang_pred in ("en", "fr") for r in got if r.doc_id in (6, 7, 10))
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 4}) == 1
    assert langid.languages(df.limit(0), remainder("doc_id", 4) != 2).count() == 0
    none = langid.languages(df, F.lit(False)).collect()
    assert {(r.lang_pred, r.score, r.fits) for r in none} == {("und", 0.0, False)}
    with pytest.raises(ValueError, match="fits"):
        langid.languages(df, F.lit(True), carry=("doc_id", "fits"))


def test_ties_go_to_the_first_name(spark):
    rows = [(i, "same words in all of them", lang) for i, lang in enumerate(["b", "a", "c"] * 4)]
    got = langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True)).collect()
    assert {r.lang_pred for r in got} == {"a"}


def test_a_language_of_long_texts_only_is_learned(spark):
    rows = [(i, "kurz und gut ist besser", "de") for i in range(20)] + [(100 + i, "plus long que tous les autres " * 400, "fr") for i in range(3)]
    got = langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), longest=200).collect()
    assert all(r.lang_pred == ("fr" if r.doc_id >= 100 else "de") for r in got)


def test_bounds(spark):
    """Repeated ids do not go past the number of rows, landmarks give way to the bound of cells, and too many languages are an error."""
    rows = [(1, f"word{i % 7} text", "en") for i in range(300)] + [(i, f"mot{i % 5} texte", "fr") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.sample(df, 20, 1000, 100)) <= 40
    with pytest.raises(ValueError, match="languages"):
        langid.sample(df, 20, 1, 100)
    texts = ["".join(chr(97 + (i * j) % 26) for j in range(400)) for i in range(1, 60)]
    big = langid.fitted(texts, ["en", "fr", "de"] * 19 + ["en", "fr"], 20)
    cut = langid.fitted(texts, ["en", "fr", "de"] * 19 + ["en", "fr"], 20, cells=len(big["vocabulary"]) * 2)
    assert len(cut["vocabulary"]) * 4 <= len(big["vocabulary"]) * 2
    with pytest.raises(ValueError, match="cells"):
        langid.fitted(texts, ["en", "fr", "de"] * 19 + ["en", "fr"], 20, cells=10)
