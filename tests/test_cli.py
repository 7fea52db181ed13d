"""Commands on files: subsets built and checked, an index searched, a run evaluated, vectors searched."""

import json

import pytest
from pyspark.sql import functions as F
from quillon.cli import main
from quillon.operators import dense


@pytest.fixture
def files(tmp_path):
    docs = [{"id": str(i), "title": f"t{i}", "text": f"common word{i} word{i % 7} number{i % 3}"} for i in range(1, 41)]
    (tmp_path / "corpus.jsonl").write_text("\n".join(map(json.dumps, docs)) + "\nbroken {\n")
    for split in ("a", "b"):
        asked = range(5) if split == "a" else range(5, 10)
        (tmp_path / f"{split}.jsonl").write_text("".join(json.dumps({"query_id": str(q), "query": f"word{q + 1} common"}) + "\n" for q in asked))
        (tmp_path / f"{split}.qrels").write_text("".join(f"{q} 0 {q + 1 if q != 7 else 999} 1\n" for q in asked))
    (tmp_path / "m.run").write_text("".join(f"{q} Q0 {(q * 3 + r) % 40 + 1} {r} {9 - r}.5 m\n" for q in range(10) for r in range(1, 6)))
    return tmp_path


def test_build_and_validate(spark, files, capsys):
    given = ["--corpus", f"{files}/corpus.jsonl", "--out", f"{files}/out", "--queries", f"a={files}/a.jsonl", f"b={files}/b.jsonl", "--qrels", f"a={files}/a.qrels", f"b={files}/b.qrels",
             "--runs", f"m={files}/m.run", "--neighbours", "1-2", "--quota", "2", "--train-size", "30", "--eval-size", "12"]
    assert main(["validate", *given], spark) == 2 and "FATAL" in capsys.readouterr().err
    assert main(["build", *given], spark) == 0 and main(["validate", *given], spark) == 0
    assert "FAIL" not in capsys.readouterr().out
    text = "".join(p.read_text() for p in (files / "out/train80/corpus").glob("part-*"))
    assert len(text.splitlines()) == 30 and set(text.splitlines()) < set((files / "corpus.jsonl").read_text().splitlines())
    assert "7\t999" in "".join(p.read_text() for p in (files / "out/missing").glob("part-*"))
    assert main(["validate", *given[:-1], "13"], spark) == 1 and "FAIL count eval20" in capsys.readouterr().out


@pytest.mark.parametrize("model", ["bm25-lucene", "tfidf", "coordination-norm"])
def test_index_retrieve_evaluate(spark, files, capsys, model):
    assert main(["index", "--corpus", f"{files}/corpus.jsonl", "--out", f"{files}/index"], spark) == 0
    assert main(["retrieve", "--index", f"{files}/index", "--queries", f"{files}/a.jsonl", "--out", f"{files}/run", "--model", model, "--top", "5", "--gzip"], spark) == 0
    assert main(["evaluate", "--qrels", f"{files}/a.qrels", "--run", f"{files}/run", "--metrics", "RR", "success@5"], spark) == 0
    out = capsys.readouterr().out.splitlines()
    assert [x.split("\t")[0] for x in out] == ["RR", "success@5"] and float(out[1].split("\t")[1]) == 1.0
    (files / "ids").write_text("1\n2\n")
    assert main(["evaluate", "--qrels", f"{files}/b.qrels", "--run", f"{files}/run", "--metrics", "RR"], spark) == 0
    got = capsys.readouterr()
    assert got.out == "RR\t0.000\n" and "5 judged queries" in got.err


def test_embed_and_dense(spark, files):
    assert main(["embed", "--corpus", f"{files}/corpus.jsonl", "--out", f"{files}/vectors", "--words", "4", "--stride", "2", "--shards", "3"], spark) == 0
    assert main(["dense", "--vectors", f"{files}/vectors", "--queries", f"{files}/vectors", "--out", f"{files}/dense", "--top", "3"], spark) == 0
    rows = [r.value.split() for r in spark.read.text(f"{files}/dense").collect()]
    assert len(rows) == 120 and all(any(r[0] == r[2] and float(r[4]) > 0.9999 for r in rows if r[0] == str(i)) for i in range(1, 41))


def test_an_encoder_out_of_memory_gets_smaller_batches(spark):
    def make():
        def encode(texts):
            if len(texts) > 3:
                raise MemoryError
            return [[float(len(t))] for t in texts]

        return encode

    chunks = spark.range(20).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("n_words"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("chunk"))
    assert {r.doc_id: list(r.v) for r in dense.encoded(chunks, make, 16).collect()} == {i: [float(i)] for i in range(20)}
