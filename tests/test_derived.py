"""Kept vectors: only what has changed is embedded again."""

from pyspark.sql import functions as F

from millrace.functions import providers
from millrace.operators import derived as D


def test_only_changes_are_embedded(spark, tmp_path):
    path, asked = str(tmp_path / "store"), spark.sparkContext.accumulator(0)

    class Counting(providers.Stub):  # in here it is sent to the workers by value
        def embed(self, texts):
            asked.add(len(texts))
            return super().embed(texts)

    embed = lambda c: providers.embed(c, Counting)
    titles = lambda *rows: spark.createDataFrame(rows, "id long, title string")
    state = lambda df: {r.id: r.state for r in D.states(df, "id", F.col("title"), path, "m").collect()}
    first = titles((1, "a"), (2, "b"), (3, None))
    assert state(first) == {1: "new", 2: "new", 3: "new"}
    assert D.refresh(first, "id", F.col("title"), path, "one", embed, "m") == 1 and asked.value == 2
    second = titles((1, "a"), (2, "B"), (4, "d"))
    assert state(second) == {1: "unchanged", 2: "stale", 4: "new"}
    assert D.refresh(second, "id", F.col("title"), path, "two", embed, "m") == 2 and asked.value == 4
    got = {r.id: r.vector for r in D.vectors(second, "id", F.col("title"), path, "m").collect()}
    want = providers.Stub().embed(["a", "B", "d"])
    assert [[round(x, 5) for x in got[k]] for k in (1, 2, 4)] == [[round(x, 5) for x in v] for v in want] and len(got) == 3
    assert state(first) == {1: "unchanged", 2: "stale", 3: "unchanged"}  # the store has what was last published
    assert set(D.vectors(first, "id", F.col("title"), path, "m").toPandas()["id"]) == {1, 3}
    assert {r.state for r in D.states(second, "id", F.col("title"), path, "another model").collect()} == {"stale"} | {"stale"}
