"""The kept index: recall against the exact search, pruned reads, and vectors that come later."""

import re

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import index as I
from millrace.operators import vectors as V
from millrace.plans import vector_queries as Q


def test_recall_of_the_query(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    approximate = {(r.query_id, r.vec_id) for r in Q.ivf_topk(spark, sf).collect()}
    exact = {(r.query_id, r.vec_id) for r in V.top_k(Q.EMB(spark, sf), Q.asked(spark, sf)).collect()}
    assert len(exact) == 8 * Q.asked(spark, sf).count() == len(approximate) and len(approximate & exact) >= 0.9 * len(exact)


def clusters(seed=1, n=1600):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(16, 32))[rng.integers(0, 16, n)] + 0.25 * rng.normal(size=(n, 32))
    return [(k, [float(v) for v in row]) for k, row in enumerate(x)]


def test_a_quarter_of_the_lists_is_enough_for_vectors_in_clusters(spark, tmp_path):
    rows, path = clusters(), str(tmp_path / "index")
    table = spark.createDataFrame([*rows, (5000, None)], "vec_id long, embedding array<float>")
    I.build(table, path, lists=16, parts=8, codewords=32)
    asked = table.where("vec_id % 100 = 0 and embedding is not null").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    exact = {(r.query_id, r.vec_id) for r in V.top_k(table, asked).collect()}
    found = I.search(spark, path, asked, probes=4, rerank=64, tile=200, block=5)
    assert len({(r.query_id, r.id) for r in found.collect()} & exact) >= 0.9 * len(exact)
    # One query: only the folders of its lists are read, at most a quarter of the rows.
    one = asked.where("query_id = 300")
    lists = [r.list for r in I.probed(one, I.model_of(spark, path), 2).collect()]
    read = I.rows_of(spark, path).where(F.col("list").isin(lists))
    assert read.count() <= 0.25 * len(rows)
    plan = I.search(spark, path, one, probes=2)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*list#\d+ IN \(" + ",".join(map(str, sorted(lists))), plan)
    assert {r.id for r in I.search(spark, path, one, probes=2).collect()} & {v for q, v in exact if q == 300}


def test_added_vectors_replace_those_of_their_ids(spark, tmp_path):
    rows, path = clusters(2, 400), str(tmp_path / "index")
    schema = "vec_id long, embedding array<float>"
    I.build(spark.createDataFrame(rows, schema), path, lists=8, parts=8, codewords=16)
    moved = [(7, [-x for x in rows[7][1]]), (900, rows[3][1])]
    assert I.add(spark.createDataFrame(moved, schema), path, "second") == 2
    now = dict(rows) | dict(moved)
    table = spark.createDataFrame(list(now.items()), schema)
    held = {r.id: r.embedding for r in I.rows_of(spark, path).collect()}
    assert set(held) == set(now) and np.allclose(held[7], now[7]) and I.rows_of(spark, path).count() == len(now)
    asked = table.where("vec_id in (3, 7, 20)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = {(r.query_id, r.id, r.score) for r in I.search(spark, path, asked, k=3, probes=8, rerank=400).collect()}
    assert got == {(r.query_id, r.vec_id, r.score) for r in V.top_k(table, asked, 3).collect()}
