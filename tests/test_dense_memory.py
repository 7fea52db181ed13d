"""Memory of a dense search."""

import tracemalloc

import numpy as np
import pyarrow as pa
from quillon.operators import dense


def test_dense_scores_of_a_batch_are_not_held_together():
    """Queries times the vectors of a batch were in memory at once, and sorted for each query."""
    rng = np.random.default_rng(2)
    v, q = np.round(rng.normal(size=(4000, 8)), 1), rng.normal(size=(500, 8))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    batch = pa.record_batch([pa.array(np.arange(4000)), pa.array(list(v), pa.list_(pa.float64()))], ["doc_id", "v"])
    shared = type("Shared", (), {"value": (list(range(500)), q)})
    tracemalloc.start()
    found = pa.Table.from_batches(dense.searched(shared, 5)(iter([batch]))).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4000 * 500 * 8
    scores = np.round(q @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).T, 5)
    want = {(i, int(d)) for i in range(500) for d in np.lexsort((np.arange(4000), -scores[i]))[:5]}
    assert set(zip(found.item_id, found.doc_id)) == want
