"""Joins with few ids leave texts where they are."""

from quillon.plans import catalogue
from quillon.session import saved
from quillon.sources import jsonl

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_copied_where_they_are(spark, tmp_path):
    """Before, all lines were shuffled to meet the few ids."""
    ids = saved(spark.createDataFrame([(3,), (5,), (3,)], "id long"), "ids")
    lines = spark.range(40).selectExpr("id as line_no", "to_json(struct(id, 'x' as text)) as value")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        jsonl.copy_lines(lines, ids, str(tmp_path / "out"))
        for name in ("verbatim_subset", "chunk_qrels", "hard_negative"):
            shuffled = [x for x in plan(catalogue.QUERIES[name](spark, SMALL)).splitlines() if "Exchange hash" in x and "text" in x]
            assert not shuffled, (name, shuffled)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"id":3,"text":"x"}', '{"id":5,"text":"x"}']
