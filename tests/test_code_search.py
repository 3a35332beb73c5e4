"""The codes of the kept index are compared for some queries at a time, so that memory doesn't grow with the queries."""

import tracemalloc

import numpy as np
import pyarrow as pa

from millrace.operators import index as I


def test_codes_are_compared_for_some_queries_at_once():
    """The function that tasks run, on 4,000 queries and codes: all scores at once would be 128 MB, twice."""
    rng, caught = np.random.default_rng(1), []

    class Frame:
        schema = {"query_id": I.T.StructField("query_id", I.T.LongType()), "id": I.T.StructField("id", I.T.LongType())}
        select = groupBy = cogroup = lambda self, *_: self

        def applyInArrow(self, of, schema):
            caught.append(of)

    model, n = I.Model(np.eye(8)[:2], rng.normal(size=(4, 16, 2))), 4000
    I._best_by_code(Frame(), Frame(), model, 5)
    codes, vectors = rng.integers(0, 16, (n, 4)).astype(np.uint8), rng.normal(size=(n, 8))
    chunks = pa.table({"id": pa.array(range(n), pa.int64()), "list": pa.array([1] * n, pa.int32()), "code": pa.array([c.tobytes() for c in codes], pa.binary())})
    queries = pa.table({"query_id": pa.array(range(n), pa.int64()), "q": pa.array(vectors.tolist(), pa.list_(pa.float32()))})
    tracemalloc.start()
    got = caught[0](chunks, queries)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = I._matrix(queries["q"].combine_chunks())
    vectors_of = model.centres[1] + np.concatenate([model.books[k][codes[:, k]] for k in range(4)], 1)
    scores = whole @ vectors_of.T
    assert got.num_rows == 5 * n and peak < 80 << 20
    assert np.allclose(got["score"].to_numpy().reshape(n, 5), -np.sort(-scores, 1)[:, :5])
