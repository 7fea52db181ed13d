"""Temperature mixing against its SQL, the plain formula and its limits."""

import collections
import math

import duckdb
import pytest
from quillon.llm import mixing

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, tokens string, block int, key string"
TEXTS = ["", None, "   \n\t ", "one two three", "One TWO three", "w " * 6000, "a" * 350, "7 8 9 !!", "été à la plage avec l'ami", "x y"]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty, long and equal texts, and columns whose names clash with those inside."""
    rows = [(i, t, ["en", None, "fr"][i % 3], ["s", None, ""][i % 3], None, i, "x", 1, None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, "no id", None, None, None, 0, "", 0, "")], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_mixing_matches_sql(spark, awkward, docs):
    for name, df in (("awkward", awkward.filter("doc_id is not null")), ("docs", docs)):
        c = duckdb.connect()
        c.register("documents", df.select("doc_id", "text", "source").toPandas())
        want = c.execute(mixing.MIXING_SQL.replace("@docs", "documents")).fetchdf()
        got = mixing.mixture(df).toPandas()
        key = lambda d: sorted(map(tuple, d[sorted(d.columns)].round(9).astype(str).values))
        assert key(got) == key(want), name


def test_mixing_of_very_many_sources(spark):
    """A source for each host: none gathers them, and weights are those of the plain formula."""
    rows = spark.range(4000).selectExpr("id doc_id", "repeat('w ', cast(1 + id % 37 as int)) text", "concat('h', id % 3000) source")
    got = mixing.mixture(rows, target=0.999, repeats=1.5).select("source", "weight").distinct().collect()
    size = collections.Counter()
    for i in range(4000):
        size[f"h{i % 3000}"] += 1 + i % 37
    total = sum(size.values())
    p = {k: v / total for k, v in size.items()}

    def weights(x):
        z = sum(v**x for v in p.values())
        return {k: v**x / z for k, v in p.items()}

    entropy = lambda w: -sum(v * math.log(v) for v in w.values())
    lo, hi = 0.0, 1.0
    for _ in range(40):
        m = (lo + hi) / 2
        lo, hi = (m, hi) if entropy(weights(m)) >= 0.999 * math.log(len(p)) else (lo, m)
    by_entropy, (lo, hi) = lo, (0.0, 1.0)
    for _ in range(40):
        m, least = (lo + hi) / 2, min(p, key=p.get)
        lo, hi = (m, hi) if weights(m)[least] / p[least] > 1.5 else (lo, m)
    want = weights(max(by_entropy, hi))
    assert len(got) == 3000 and all(r.weight == pytest.approx(want[r.source], abs=2e-9) for r in got)


def test_mixing_repeated_rows(spark):
    rows = [(1, "a b c", "s")] * 2 + [(1, "a b", "s"), (None, "x y", None), (None, None, "t"), (2, "w " * 5, "t")]
    got = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 0), (0, 2), (1, 2), (1, 3), (1, 3), (2, 5)]


def test_mixing_limits(spark, empty):
    rows = [(i, "w " * 10, "big" if i < 900 else "small") for i in range(910)]
    got = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"), target=0.9, repeats=4.0).toPandas()
    assert got[got.source == "small"].copies.max() <= 4 and (got[got.source == "small"].copies >= 3).all()
    assert abs((got.copies * got.n_tokens).sum() - 9100) <= 40
    assert mixing.mixture(empty).count() == 0
