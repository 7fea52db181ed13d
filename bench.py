"""Times the headline queries and prints one JSON line."""

import json
import os
import time

from quillon.plans.catalogue import QUERIES
from quillon.session import session

NAMES = (
    "stored_index tf_postings term_stats boolean_and coord_count coord_count_norm tfidf tfidf_norm tfidf_reduced tfidf_decay phrase_weighted "
    "bm25_lucene bm25_terrier bm25_okapi dense_topk dense_sharded_topk chunk_sliding best_positive_chunk hard_negative eval_sweep pool_quota fill_to_size"
).split()


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus), **{"spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda n: QUERIES[n](spark, folder).write.format("noop").mode("overwrite").save()
    run("term_stats")  # warms the JVM
    start = time.perf_counter()
    run("coord_count")  # the index that all rankings read is written by the first of them
    first = round(time.perf_counter() - start, 3)
    took = {}
    for n in NAMES:
        start = time.perf_counter()
        run(n)
        took[n] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "index_and_first_ranking": first, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
