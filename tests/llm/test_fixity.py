"""WARC records and the Merkle audit: round trips, trees made by hand, planted faults, and what the descent looks at."""

import gzip
import hashlib

from pyspark.sql import functions as F
from quillon.llm import fixity
from quillon.session import saved

FOLDER = "/root/testdata/sf0.001"
PAGES, LEAVES = "page_id long, url string, html string", "node long, file long, start long, end long, hash string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_hand(leaves):
    """Levels of (node -> (file, start, end, hash)) from leaves to the root, in plain Python."""
    ids = list(leaves)
    levels = 1
    while len({i >> 4 * levels for i in ids}) > 1 and not {i >> 4 * levels for i in ids} <= {-1, 0}:
        levels += 1
    every = [dict(leaves)]
    for level in range(1, levels + 2):
        up = {}
        for n in sorted(every[-1]):
            up.setdefault(n >> 4 if level <= levels else 0, []).append(n)
        below = every[-1]
        every.append({u: (min(below[n][0] for n in ns), min(below[n][1] for n in ns), max(below[n][2] for n in ns), sha(",".join(":".join(map(str, (n, *below[n]))) for n in ns))) for u, ns in up.items()})
    return every


def leaf_table(spark, ids, hashes=None):
    return {i: (i >> 9, 10 * k, 10 * k + 10, (hashes or {}).get(i, sha(str(i)))) for k, i in enumerate(sorted(ids))}


def frame(spark, leaves):
    return saved(spark.createDataFrame([(n, *x) for n, x in leaves.items()], LEAVES), "leaves")


def test_nodes_are_those_of_a_tree_made_by_hand(spark):
    for ids in (range(40), [3], [-1, 5], [-300, -17, -16, 0, 15, 16, 4000], [1 << 60, 7], [-(1 << 62), (1 << 62) + 5]):
        leaves = leaf_table(spark, ids)
        at = frame(spark, leaves)
        want = by_hand(leaves)
        got = fixity.tree(at, fixity.height(at))
        assert len(got) == len(want) and len(want[-1]) == 1
        for a, b in zip(got, want):
            assert {r.node: (r.file, r.start, r.end, r.hash) for r in a.collect()} == b


def audited(spark, a, b):
    x, y = frame(spark, a), frame(spark, b)
    levels = fixity.height(x, y)
    bad, met = fixity.audit(fixity.tree(x, levels), fixity.tree(y, levels))
    return {r.node: r.state for r in bad.collect()}, met


def test_only_differing_branches_are_looked_at(spark):
    """4096 leaves, one changed: one node differs on each level, and no other is compared below them."""
    a = leaf_table(spark, range(4096))
    assert audited(spark, a, a) == ({}, [0])
    state, met = audited(spark, a, a | {77: (*a[77][:3], sha("x"))})
    assert state == {77: "changed"} and met == [1] * len(met) and len(met) == 5
    state, met = audited(spark, a, a | {i: (*a[i][:3], sha("x")) for i in (77, 78, 4000)})
    assert set(state) == {77, 78, 4000} and met[-1] == 3 and met[-2] == 2


def test_states(spark):
    a = leaf_table(spark, [-20, -1, 5, 600, 601, 602])
    b = {n: x for n, x in a.items() if n != 5} | {700: (1, 0, 9, sha("new")), 601: (1, 99, 109, a[601][3]), 602: (1, 1, 2, sha("both"))}
    assert audited(spark, a, b)[0] == {5: "lost", 700: "extra", 601: "moved", 602: "changed"}
    assert audited(spark, a, {})[0] == {n: "lost" for n in a} and audited(spark, {}, a)[0] == {n: "extra" for n in a}
    assert audited(spark, {}, {})[0] == {}


def rule(i, lost_before):
    return "lost" if i % 389 == 11 else "changed" if i % 97 == 13 or i % 193 == 7 else "moved" if lost_before else "ok"


def test_query(spark, tmp_path):
    pages = [(i, None if i % 5 == 0 else f"u{i}", None if i % 7 == 0 else f"é{i}" * (i % 9)) for i in range(1200)]
    rows = [*pages, (None, "u", "h"), (3, "zz", "later"), (-600, "neg", "x"), (1 << 40, "far", "h" * 2_000_000)]
    (spark.createDataFrame(rows, PAGES).withColumn("slot", F.lit(1)).withColumn("record", F.lit("x")).withColumn("hash", F.lit(2))).repartition(5).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in fixity.op8_fixity(spark, str(tmp_path)).collect()}
    ids = [*range(1200), -600, 1 << 40]
    assert sorted(got) == sorted(ids)
    for i in ids:
        assert got[i].state == rule(i, any(j % 389 == 11 for j in ids if j >> 9 == i >> 9 and j < i)), i
    spark.createDataFrame([], PAGES).write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert fixity.op8_fixity(spark, str(tmp_path / "none")).count() == 0


def test_round_trip(spark, tmp_path):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    records = fixity.warc_records(pages)
    fixity.write_warc(records, str(tmp_path / "w"))
    back = fixity.read_warc(spark, str(tmp_path / "w"), "part-*").collect()
    assert {(r.start, r.end) for r in back} == {(r.start, r.end) for r in records.collect()}
    assert sorted(r.block.decode() for r in back) == sorted(r.html for r in pages.collect()) and not sum(r.malformed for r in back)


def test_foreign_files(spark, tmp_path):
    """Plain and gzip files of other writers: odd header case, a separator inside a block, broken headers, cut ends."""
    record = lambda uri, block, size=None: b"WARC/1.0\r\nwarc-type: response\r\nWARC-Target-URI:" + uri + b"\r\nContent-Length: " + (str(len(block)).encode() if size is None else size) + b"\r\n\r\n" + block + b"\r\n\r\n"
    one, two, three = record(b"http://a", b"x\r\n\r\nWARC/1.0\r\n\r\ny"), record(b"http://b", b""), record(b"http://c", b"\0\xff" * 50)
    (tmp_path / "a.warc").write_bytes(one + record(b"http://bad", b"zz", b"abc") + two + record(b"http://big", b"zz", b"99999") + three)
    (tmp_path / "b.warc.gz").write_bytes(fixity.compressed([one, two]))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(one + three)[:-20])
    (tmp_path / "d.warc").write_bytes(b"")
    (tmp_path / "e.warc").write_bytes(b"no record at all" + three[:-60])
    got = {}
    for r in fixity.read_warc(spark, str(tmp_path)).collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.uri, r.block and bytes(r.block), r.malformed))
    assert got["a.warc"] == [("http://a", b"x\r\n\r\nWARC/1.0\r\n\r\ny", 0), (None, None, 1), ("http://b", b"", 0), (None, None, 1), ("http://c", b"\0\xff" * 50, 0)]
    assert [x[0] for x in got["b.warc.gz"]] == ["http://a", "http://b"]
    assert sum(x[2] for x in got["c.warc.gz"]) >= 1 and "d.warc" not in got and {x[2] for x in got["e.warc"]} == {1}
