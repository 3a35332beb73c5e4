"""What a task of the similarity search holds at once is bounded, however many queries there are."""

from pyspark.sql import functions as F

from millrace.operators import vectors as V


def test_all_pairs_are_dealt_into_small_tasks(spark, monkeypatch):
    sizes = {}
    monkeypatch.setattr(V, "_meet", lambda rows, asked, keys, *_: sizes.update(rows=rows, asked=asked, keys=keys))
    table = spark.range(6000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    asked = table.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    V.similarities(table, asked)
    most = lambda df: df.groupBy(*sizes["keys"]).count().agg(F.max("count")).first()[0]
    assert most(sizes["rows"]) * most(sizes["asked"]) <= 1_000_000
