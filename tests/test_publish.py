"""Loads that readers see whole or not at all."""

import pytest
from pyspark.sql import functions as F

from millrace.sources import publish as P

SCHEMA = "document_id long, text string"


def rows(spark, *pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def seen(spark, path, **options):
    return sorted(map(tuple, P.published(spark, path, SCHEMA, **options).collect()))


def test_a_killed_load_reruns_to_the_same_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    assert seen(spark, path) == [] and P.statuses(spark, path).count() == 0
    assert P.publish(rows(spark, (1, "a"), (1, "b"), (2, "c")), path, "one") == 1
    second = rows(spark, (2, "C"), (3, "d"))
    P.begin(second, path, "two")
    monkeypatch.setattr(P, "write_new", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        P.publish(second, path, "two")
    assert seen(spark, path) == [(1, "a"), (1, "b"), (2, "c")]  # all is written, but the manifest
    assert {r.document_id: r.status for r in P.statuses(spark, path).collect()} == {1: "done", 2: "done", 3: "processing"}
    assert sorted(r.document_id for r in P.not_done(rows(spark, (1, ""), (3, ""), (9, "")), path).collect()) == [3, 9]
    monkeypatch.undo()
    for _ in range(2):  # again: nothing changes
        assert P.publish(second, path, "two") == 2
    assert seen(spark, path) == [(1, "a"), (1, "b"), (2, "C"), (3, "d")]
    assert seen(spark, path, at=1) == [(1, "a"), (1, "b"), (2, "c")] and seen(spark, path, at=0) == []


def test_failures_are_listed_and_done_rows_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    P.publish(rows(spark, (1, "a"), (2, "b")), path, "one")
    bad = spark.createDataFrame([(2, "OSError: gone"), (3, "ValueError: " + "x" * 900), (4, "y")], "document_id long, error string")
    P.publish(rows(spark, (4, "d")), path, "two", failed=bad)
    got = {r.document_id: (r.status, r.error and len(r.error)) for r in P.statuses(spark, path).collect()}
    assert got == {1: ("done", None), 2: ("done", None), 3: ("failed", 500), 4: ("done", None)}
    assert seen(spark, path) == [(1, "a"), (2, "b"), (4, "d")]


def test_two_loads_at_one_time_both_count(spark, tmp_path, monkeypatch):
    path, real, raced = str(tmp_path / "t"), P.write_new, []

    def behind(s, place, text):
        if not raced:  # another load takes the generation first
            raced.append(1)
            P.publish(rows(spark, (7, "x")), path, "other")
        return real(s, place, text)

    monkeypatch.setattr(P, "write_new", behind)
    assert P.publish(rows(spark, (1, "a")), path, "mine") == 2
    assert P.generation(spark, path) == (2, ["other", "mine"]) and seen(spark, path) == [(1, "a"), (7, "x")]


def test_empty_load_and_folders_by_value(spark, tmp_path):
    path = str(tmp_path / "t")
    P.publish(rows(spark).withColumn("list", F.lit(1)), path, "none", by="list")
    P.publish(rows(spark, *[(k, "t") for k in range(50)]).withColumn("list", (F.col("document_id") % 5).cast("int")), path, "some", by="list")
    found = P.published(spark, path, SCHEMA + ", list int").where("list = 3")
    assert found.count() == 10 and "PartitionFilters: [isnotnull(list" in found._jdf.queryExecution().toString()
