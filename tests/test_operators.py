"""Hand-made cases: measures, lines, windows, pooling, filling, streams."""

import gzip
import math
import random
import shutil

import pytest
from pyspark.sql import functions as F
from quillon.functions.porter import porter
from quillon.functions.text import ANALYZERS, falsy, stem, titled, treebank
from quillon.operators import chunking, dense, evaluation, index, lexical, subsets, validator
from quillon.sources import jsonl, lines, shards, trec
from quillon.streaming import incremental


def test_measures_by_hand(spark):
    qrels = spark.createDataFrame([(1, 10, 1), (1, 11, 1), (2, 20, 1), (3, 30, 1)], "item_id long, doc_id long, rel int")
    run = spark.createDataFrame([(1, 10, 3.0), (1, 99, 2.0), (1, 11, 1.0), (2, 21, 5.0), (2, 20, 4.0)], "item_id long, doc_id long, score double")
    got = {r.metric: r.value for r in evaluation.evaluate(qrels, run, ["RR", "MAP", "P@2", "R@2", "success@1", "NDCG@3", "F1@2"]).collect()}
    assert got["RR"] == pytest.approx((1 + 0.5 + 0) / 3, abs=1e-6)
    assert got["MAP"] == pytest.approx(((1 + 2 / 3) / 2 + 0.5) / 3, abs=1e-6)
    assert got["P@2"] == pytest.approx((0.5 + 0.5) / 3, abs=1e-6)
    assert got["R@2"] == pytest.approx((0.5 + 1) / 3, abs=1e-6)
    assert got["success@1"] == pytest.approx(1 / 3, abs=1e-6)
    ideal = 1 + 1 / math.log2(3)
    assert got["NDCG@3"] == pytest.approx(((1 + 0.5) / ideal + 1 / math.log2(3)) / 3, abs=1e-6)
    assert [r.item_id for r in evaluation.missing(qrels, run).collect()] == [3]


def test_ties_go_to_the_greater_id_as_text(spark):
    qrels = spark.createDataFrame([(1, 9, 1)], "item_id long, doc_id long, rel int")
    run = spark.createDataFrame([(1, 9, 1.0), (1, 10, 1.0)], "item_id long, doc_id long, score double")
    assert evaluation.evaluate(qrels, run, ["RR"]).first().value == 1.0


def test_metric_names():
    assert evaluation.parse_metric("Recall@5") == ("r", 5)
    assert evaluation.parse_metric("mrr") == ("rr", None)
    for bad in ("ndcg", "nope@3", "rr@2"):
        with pytest.raises(ValueError):
            evaluation.parse_metric(bad)


def test_run_lines(spark):
    text = ["1 Q0 a 2 0.5 t", "1 Q0 a 1 0.4 t", "1 b x y t", "", "# note"]
    lines = spark.createDataFrame(list(enumerate(text)), "line_no long, value string")
    got = {(r.query_id, r.doc_id): (r["rank"], r.score) for r in trec.parse_run(lines).collect()}
    assert got[("1", "a")] == (1, 0.4)
    assert {(r.query_id, r.doc_id): r.score for r in trec.parse_run(lines, strict=True).collect()} == {("1", "a"): 0.4}


def test_qrels(spark):
    lines = spark.createDataFrame(list(enumerate(["1 0 a 2", "1 0 a x", "# c d e f", "1 0", " 2  0 b 1 "])), "line_no long, value string")
    assert sorted(map(tuple, trec.parse_qrels(lines).collect())) == [("1", "a", 1), ("2", "b", 1)]
    with pytest.raises(Exception, match="no integer"):
        trec.parse_qrels(lines, bad_rel=None).collect()


def test_run_round_trip(spark, tmp_path):
    run = spark.createDataFrame([(1, 5, 1, 0.25), (1, 6, 2, 0.125)], "item_id long, doc_id long, rnk long, score double")
    trec.write_run(run, str(tmp_path / "run"), "x", gzip=True)
    got = trec.parse_run(lines.numbered(spark, str(tmp_path / "run"))).collect()
    assert sorted((r.query_id, r.doc_id, r["rank"], r.score) for r in got) == [("1", "5", 1, 0.25), ("1", "6", 2, 0.125)]


def test_windows_cover_and_stop(spark):
    for n in (0, 1, 5, 6, 7, 23):
        docs = spark.createDataFrame([(1, " ".join(str(i) for i in range(n)))], "doc_id long, text string")
        got = [r.chunk.split() for r in chunking.windows(docs, 5, 2).orderBy("chunk_index").collect()]
        assert [x for c in got for x in c if x] == [] if not n else got[-1][-1] == str(n - 1)
        assert all(len(c) == 5 for c in got[:-1])


def test_pool_refills(spark):
    runs = spark.createDataFrame([("a", 1, d, d) for d in range(1, 6)] + [("b", 1, d, d) for d in range(1, 6)], "model string, item_id long, doc_id long, rnk long")
    have = spark.createDataFrame([(1,)], "doc_id long")
    assert sorted(map(tuple, subsets.pool_quota(runs, have, 2).collect())) == [(1, "a", 2), (1, "a", 3), (1, "b", 4), (1, "b", 5)]


def test_pool_against_the_greedy_loop(spark):
    rng = random.Random(3)
    rows = [(m, i, d, r) for i in range(12) for m in "abc" for r, d in enumerate(rng.sample(range(60), rng.randrange(1, 25)), 1)]
    have = set(rng.sample(range(60), 6))
    taken, want = set(have), []
    for i in range(12):
        for m in "abc":
            free = [d for mm, ii, d, _ in rows if (mm, ii) == (m, i) and d not in taken][:3]
            taken |= set(free)
            want += [(i, m, d) for d in free]
    got = subsets.pool_quota(spark.createDataFrame(rows, "model string, item_id long, doc_id long, rnk long"), spark.createDataFrame([(d,) for d in have], "doc_id long"), 3)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_filled_and_neighbours(spark):
    """Places are those of the corpus, not ids: gaps and any order of ids."""
    for ids in (list(range(20)), [10, 20, 30, 40, 55, 7, 3]):
        order = spark.createDataFrame(list(enumerate(ids)), "ord long, doc_id long")
        gold = spark.createDataFrame([(ids[3],)], "doc_id long")
        near = subsets.neighbours(order, gold, 2, 2)
        assert sorted(r[0] for r in near.collect()) == sorted([ids[1], ids[2], ids[4], ids[5]])
        assert [r[0] for r in subsets.neighbours(order, gold, 0, 0).collect()] == []
        got = {r[0] for r in subsets.filled(order, near, gold, 6).collect()}
        assert set(ids[1:6]) <= got and len(got) == 6
        assert {r[0] for r in subsets.filled(order, near, gold, 3).collect()} == {ids[3], ids[1], ids[2]}
    gold = spark.createDataFrame([(20,)], "doc_id long")
    order = spark.createDataFrame([(0, 10), (1, 20), (2, 30), (3, 40)], "ord long, doc_id long")
    assert sorted(r[0] for r in subsets.neighbours(order, gold, 1, 1).collect()) == [10, 30]
    assert subsets.parse_neighbours("1-3") == (1, 3)
    with pytest.raises(ValueError):
        subsets.parse_neighbours("3-1")


def test_split_sizes(spark):
    q = spark.range(143).select(F.lit("s").alias("split"), F.col("id").alias("query_id"))
    assert subsets.split_80_20(q).filter("side = 'train80'").count() == 114


def plain_topk(v, q, k):
    out = set()
    for i, x in q.items():
        scores = []
        for d, y in v.items():
            n = math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(a * a for a in y))
            scores.append((-(round(sum(a * b for a, b in zip(x, y)) / n, 5) if n else 0.0), d))
        out |= {(i, d, r) for r, (_, d) in enumerate(sorted(scores)[:k], 1)}
    return out


def test_dense_against_all_pairs(spark):
    rng = random.Random(1)
    v = {d: [rng.randrange(-3, 4) * 1.0 for _ in range(6)] for d in range(80)} | {500: [0.0] * 6}
    q = {i: [rng.randrange(-3, 4) * 1.0 + 0.5 for _ in range(6)] for i in range(11)}
    vectors = spark.createDataFrame([*v.items(), (900, None), (901, [1.0, 2.0])], "doc_id long, v array<double>").repartition(5)
    asked = spark.createDataFrame([*q.items(), (99, None), (98, [1.0])], "item_id long, q array<double>")
    for block in (4, 4096):
        assert {(r.item_id, r.doc_id, r.rnk) for r in dense.dense_topk(vectors, asked, 5, block).collect()} == plain_topk(v, q, 5)
    parts = [dense.dense_topk(vectors.filter(F.col("doc_id") % 3 == i), asked, 5) for i in range(3)]
    assert {(r.item_id, r.doc_id, r.rnk) for r in dense.merged_topk(parts, 5).collect()} == plain_topk(v, q, 5)


def test_dense_without_and_with_many_queries(spark):
    vectors = spark.createDataFrame([(d, [float(d % 7), 1.0, float(d % 3)]) for d in range(30)], "doc_id long, v array<double>").coalesce(1)
    none = spark.createDataFrame([], "item_id long, q array<double>")
    assert dense.dense_topk(vectors, none).columns == ["item_id", "doc_id", "rnk", "score"] and dense.dense_topk(vectors, none).count() == 0
    many = spark.range(5000).select(F.col("id").alias("item_id"), F.array(F.col("id") % 5 + 1.0, F.lit(0.5), F.lit(1.0)).alias("q"))
    assert dense.dense_topk(vectors, many, 2).select("item_id").distinct().count() == 5000


def test_boolean_and_is_inside_or(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red hen"), (3, None)], "doc_id long, text string")
    index.write_index(docs, str(tmp_path))
    c = lexical.Lexical(index.read_index(spark, str(tmp_path)), spark.createDataFrame([(7, "red fox"), (8, "")], "item_id long, text string"))
    assert [tuple(r) for r in c.boolean(True).collect()] == [(7, 1)]
    assert sorted(tuple(r) for r in c.boolean(False).collect()) == [(7, 1), (7, 2)]


def test_text_helpers(spark):
    df = spark.createDataFrame([("", "b", " t ", ""), (None, None, "t", "x")], "a string, b string, c string, d string")
    got = df.select(falsy("a", "b"), titled("c", "d")).collect()
    assert [tuple(r) for r in got] == [("b", "t"), (None, "t\nx")]
    words = spark.createDataFrame([("ponies",), ("boxes",), ("walking",), ("glass",)], "w string")
    assert [r[0] for r in words.select(stem(F.col("w"))).collect()] == ["pony", "box", "walk", "glass"]


def test_heavy_terms_in_parts_score_the_same(spark, tmp_path):
    docs = spark.createDataFrame([(i, "common " + " ".join(["rare"] * (i % 3)) + f" w{i}") for i in range(60)] + [(99, None), (98, "the of")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "common rare"), (2, "w5 common common")], "item_id long, text string")
    found = []
    for heavy in (7, 10**6):
        index.write_index(docs, str(tmp_path / str(heavy)), heavy=heavy)
        i = index.read_index(spark, str(tmp_path / str(heavy)))
        assert {r.doc_id: r.dl for r in i.lengths.collect()}.items() >= {99: 0, 98: 0, 0: 2}.items() and i.corpus.first().n_docs == 62
        c = lexical.Lexical(i, asked)
        found.append([sorted((r.item_id, r.doc_id, round(r.score, 9)) for r in x.collect()) for x in (c.tfidf(), c.coordination(), c.bm25("okapi"), c.bm25("lucene"), c.decayed())])
    assert found[0] == found[1] and len(found[0][0]) == 120
    assert i.stats.filter("salts > 1").isEmpty() and not index.read_index(spark, str(tmp_path / "7")).stats.filter("salts > 1").isEmpty()


def test_guard(spark):
    ok = spark.createDataFrame([(1,), (2**32 - 2,)], "doc_id long")
    assert index.guarded(ok).count() == 2
    for bad in (0, -1, 2**32 - 1, None):
        with pytest.raises(Exception, match="out of range"):
            index.guarded(spark.createDataFrame([(bad,)], "doc_id long")).collect()


def test_lines_of_several_files_keep_their_order(spark, tmp_path):
    for name, rows in (("a.txt", ["1 0 x 1", "1 0 y 1", "2 0 z 1"]), ("b.txt.gz", ["1 0 w 1", "3 0 v"])):
        text = "\n".join(rows) + "\n"
        (tmp_path / name).write_bytes(gzip.compress(text.encode()) if name.endswith("gz") else text.encode())
    got = lines.numbered(spark, str(tmp_path))
    assert [r.value for r in lines.ordinals(got, "line_no").orderBy("ord").collect()] == ["1 0 x 1", "1 0 y 1", "2 0 z 1", "1 0 w 1", "3 0 v"]
    assert sorted(map(tuple, trec.parse_gold(got).collect())) == [("1", "w"), ("2", "z"), ("3", "v")]
    assert sorted(map(tuple, trec.parse_relevant(got).collect())) == [("1", "w"), ("1", "x"), ("1", "y"), ("2", "z")]


def test_corpus_order_skips_bad_lines(spark):
    rows = ['{"id": 7}', "", "no json", '{"id": "a"}', '{"x": 1}', '{"id": ""}', '{"id": 3}']
    got = lines.corpus_order(spark.createDataFrame(list(enumerate(rows)), "line_no long, value string")).orderBy("ord").collect()
    assert [tuple(r) for r in got] == [(0, "7"), (1, "a"), (2, "3")]


def test_documents_and_queries_from_lines(spark):
    rows = ['{"id": 1, "title": " T ", "text": "x"}', '{"doc_id": "9", "id": 2, "title": "", "text": " y "}', '{"id": ', '{"title": "no id"}', "", '{"id": 3}', "[1]", "null"]
    df = spark.createDataFrame(list(enumerate(rows)), "line_no long, value string")
    got = {form: {r.doc_id: r.text for r in jsonl.documents(df, form).collect()} for form in jsonl.FORMS}
    assert got["titled"] == {"1": "T\nx", "2": "y", "3": ""} and got["plain"] == {"1": "x", "2": " y ", "3": ""}
    assert got["strict"] == {"1": "T \nx", "9": "y"} and got["spaced"] == {"1": "T  x", "2": "y", "3": ""}
    asked = ['{"query_id": "a", "query": "first"}', '{"qid": "a", "text": "last"}', '{"id": 5, "title": "t"}', '{"query": "no id"}', "{"]
    df = spark.createDataFrame(list(enumerate(asked)), "line_no long, value string")
    assert {r.query_id: r.query for r in jsonl.queries(df).collect()} == {"a": "last", "5": "t"}


def test_npy_shards(spark, tmp_path):
    import numpy as np

    want = {}
    for n, name in ((2, "shard2/emb_0"), (10, "shard10/emb_0"), (10, "shard10/emb_1"), (None, "loose/emb")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        v = np.arange(6, dtype=np.float32).reshape(3, 2) + len(want)
        np.save(tmp_path / f"{name}.npy", v)
        ids = [len(want) + i for i in range(3)]
        (tmp_path / f"{name}.txt").write_text("\n".join(map(str, ids)))
        want |= {i: (n, x.tolist()) for i, x in zip(ids, v)}
    np.save(tmp_path / "shard2" / "alone.npy", np.zeros((1, 2)))
    got = {r.id: (r.shard, list(r.v)) for r in shards.read_npy(spark, str(tmp_path)).collect()}
    assert got == {i: x for i, x in want.items() if x[0] is not None}
    assert {r.id for r in shards.read_npy(spark, str(tmp_path), grouped=False).collect()} == set(want)
    (tmp_path / "shard2" / "emb_0.txt").write_text("1\n2")
    with pytest.raises(Exception, match="3, 2.* vectors for 2 ids"):
        shards.read_npy(spark, str(tmp_path)).collect()


def test_porter():
    pairs = "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop falling:fall hissing:hiss failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit vietnamization:vietnam predication:predic operator:oper feudalism:feudal hopefulness:hope formaliti:formal triplicate:triplic electrical:electr goodness:good revival:reviv allowance:allow inference:infer adjustment:adjust adoption:adopt homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll"
    for p in pairs.split():
        word, stem_ = p.split(":")
        assert porter(word) == stem_, word


def test_analyzers(spark):
    df = spark.createDataFrame([("The cat's ponies WERE running, for the dogs",), (None,)], "text string")
    got = [r[0] for r in df.select(ANALYZERS["english"]("text")).collect()]
    assert got == [["cat", "poni", "were", "run", "dog"], []]
    df = spark.createDataFrame([("\"Don't you, cannot pay $3.50 (yet)?\" he said--John's 1,000 things... ok.",)], "text string")
    assert df.select(treebank("text")).first()[0] == ["``", "Do", "n't", "you", ",", "can", "not", "pay", "$", "3.50", "(", "yet", ")", "?", "''", "he", "said", "--", "John", "'s", "1,000", "things", "...", "ok", "."]


def test_subset_files_and_planted_faults(spark, tmp_path):
    docs = spark.createDataFrame([(i, '{"id": %d, "text": "t%d"}' % (i * 10, i)) for i in range(40)], "line_no long, value string")
    asked = spark.createDataFrame([("s", str(q), f"text {q}") for q in range(10)], "split string, query_id string, query string")
    gold = spark.createDataFrame([("s", str(q), str(q * 30) if q < 9 else "9999") for q in range(10)], "split string, query_id string, doc_id string")
    runs = spark.createDataFrame([("m", str(q), str((q * 7 + r) % 40 * 10), r) for q in range(10) for r in range(1, 9)], "model string, item_id string, doc_id string, rnk long")
    source, plan = validator.Source(docs, asked, gold, runs), validator.Plan({"train80": 30, "eval20": 12}, (1, 1), 2)
    out = str(tmp_path / "out")
    validator.build(spark, out, source, plan)
    assert validator.status(validator.validate(spark, out, source, plan)) == 0
    text = "".join(p.read_text() for p in (tmp_path / "out/eval20/corpus").glob("part-*"))
    assert len(text.splitlines()) == 12 and '{"id": ' in text
    for p in (tmp_path / "out/train80/ids").glob("part-*"):
        p.write_text("\n".join(p.read_text().split()[1:]) + "\n") if p.stat().st_size else None
    for p in (tmp_path / "out").rglob(".*.crc"):
        p.unlink()
    report = validator.validate(spark, out, source, plan)
    bad = {(r.check, r.side): (r.detail, r["sample"]) for r in report.filter("not ok").collect()}
    assert validator.status(report) == 1 and bad[("ids_are_corpus", "train80")][0] >= 1 and len(bad[("ids_are_corpus", "train80")][1]) == bad[("ids_are_corpus", "train80")][0]
    shutil.rmtree(tmp_path / "out/eval20/qrels")
    with pytest.raises(FileNotFoundError, match="FATAL.*eval20/qrels"):
        validator.validate(spark, out, source, plan)


def test_key_value(spark, tmp_path):
    kv = jsonl.KeyValue(spark, str(tmp_path))
    kv.put(spark.createDataFrame([("a", "1", 0), ("a", "2", 1), ("b", "3", 0)], "key string, value string, order int"))
    kv.put(spark.createDataFrame([("b", "4", 0)], "key string, value string, order int"))
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert {r.key: r.value for r in kv.get(asked, "-").collect()} == {"a": "2", "b": "4", "c": "-"}


def test_index_stream_goes_on_after_a_restart(spark, tmp_path):
    """Three files in batches of one, a stop, and a fourth file: each counts once, for a folder and for a single file."""
    docs = spark.createDataFrame([(i, f"alpha beta{i}") for i in range(8)], "doc_id long, text string")
    for i in range(3):
        docs.filter(f"doc_id % 4 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: incremental.index_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), files=1)
    assert run().filter("term = 'alpha'").count() == 6 and run().select("batch").distinct().count() == 3
    docs.filter("doc_id % 4 = 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run().filter("term = 'alpha'").count() == 8 and run().select("batch").distinct().count() == 4
    one = incremental.index_files(spark, "/root/testdata/sf0.001/documents.parquet", str(tmp_path / "one"), str(tmp_path / "ck1"))
    assert one.select("doc_id").distinct().count() > 100


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    from quillon import session

    class Far:
        master = "spark://host:7077"

    class Conf:
        def get(self, *a):
            return None

    class Session:
        sparkContext, conf = Far(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_running_topk(spark, tmp_path):
    for i, rows in enumerate(([(1, 1, 1.0), (1, 2, 3.0)], [(1, 3, 2.0), (1, 1, 5.0)])):
        spark.createDataFrame(rows, "item_id long, doc_id long, score double").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        stream = spark.readStream.schema("item_id long, doc_id long, score double").parquet(str(tmp_path / "in" / "*"))
        incremental.running_topk(stream, str(tmp_path / "state"), str(tmp_path / "ck"), 2)
    got = spark.read.parquet(str(tmp_path / "state" / "batch=1")).orderBy("rnk").collect()
    assert [(r.doc_id, r.score) for r in got] == [(1, 5.0), (2, 3.0)]
    spark.createDataFrame([(1, 9, 9.0)], "item_id long, doc_id long, score double").coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    incremental.running_topk(spark.readStream.schema("item_id long, doc_id long, score double").parquet(str(tmp_path / "in" / "*")), str(tmp_path / "state"), str(tmp_path / "ck"), 2)
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["batch=1", "batch=2"]
