import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.streaming import state as S


def plain(requests, limits):
    """The definition, on (key, id, t) in order of time."""
    logs, out = {}, {}
    for key, id_, t in sorted(requests, key=lambda r: (r[2], r[1])):
        log = logs.setdefault(key, [])
        ok = all(sum(t - x < w for x in log) < n for w, n in limits)
        if ok:
            log.append(t)
        out[id_] = ok
    return out


@pytest.mark.parametrize("limits", [S.PER_ACCOUNT, S.PER_ADDRESS])
def test_log(spark, limits):
    random.seed(5)
    rows = [(k % 3, k, float(random.randint(0, 400))) for k in range(900)]
    frame = spark.createDataFrame([(a, b, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t)) for a, b, t in rows], "key int, id int, at timestamp")
    assert {r.id: r.accepted for r in S.rate_limited(frame, "key", "at", "id", limits).collect()} == plain(rows, limits)


def test_edges(spark):
    rows = [(1, k, 0.0) for k in range(31)] + [(1, 31, 60.0)]
    got = plain(rows, S.PER_ACCOUNT)
    assert got[29] and not got[30] and got[31]
    empty = spark.createDataFrame([], "key int, id int, at timestamp")
    assert S.rate_limited(empty, "key", "at", "id").count() == 0


def test_address(spark):
    df = spark.createDataFrame([("1.1.1.1, 2.2.2.2 ", "p"), ("", "p"), (None, "p")], "f string, p string")
    assert [r[0] for r in df.select(S.client_address(F.col("f"), F.col("p"))).collect()] == ["2.2.2.2", "p", "p"]


def test_cache(spark):
    cache = spark.createDataFrame([("a", "old", "v1", 4), ("b", "b", "v0", 1)], "question_key string, answer string, version string, hits long")
    answers = spark.createDataFrame([("a", "new", "answered", 1), ("a", "newer", "answered", 2), ("c", "x", "not_found", 1), ("d", " ", "answered", 1), (None, "x", "answered", 1)], "question_key string, answer string, status string, at int")
    after = {r.question_key: (r.answer, r.version, r.hits) for r in S.cache_upsert(cache, answers, "v1").collect()}
    assert after == {"a": ("newer", "v1", 0), "b": ("b", "v0", 1)}
    asked = spark.createDataFrame([("a", True), ("a", False), ("b", True), (None, True)], "k string, first_turn boolean")
    assert sorted((r.k or "", r.first_turn, r.answer) for r in S.cache_lookup(asked, cache, "k", "v1").where("hit").collect()) == [("a", True, "old")]


def streamed(spark, tmp_path, schema, batches, of, name, idle="true"):
    """The rows that a stream over files, one batch each, puts out; and the state's rows after each batch. idle: whether batches without data run, which in processing time never end."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", idle)
    held, source = [], str(tmp_path / f"{name}-in")
    for rows in batches:
        rows.coalesce(1).write.mode("append").parquet(source)
        q = of(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-state")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(60) and q.exception() is None
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress and q.lastProgress["stateOperators"] else None)
    return spark.read.parquet(str(tmp_path / f"{name}-out")).collect(), held


AT = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def test_limiter_stream(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rng = random.Random(8)
    batches = [sorted((rng.randrange(3), 100 * b + k, 50.0 * b + rng.randrange(50)) for k in range(80)) for b in range(3)]
    frame = lambda rows: spark.createDataFrame([(k, i, AT + dt.timedelta(seconds=t)) for k, i, t in rows], "key long, id long, at timestamp")
    idle = [[(99, None, 5000.0)], [(99, None, 5001.0)], [(99, None, 5002.0)]]  # no requests: they only move the clock
    got, held = streamed(spark, tmp_path, "key long, id long, at timestamp", [frame(b) for b in [*batches, *idle]], lambda s: S.limit_stream(s, delay="100 seconds"), "limited")
    assert {r.id: r.accepted for r in got} == plain([r for b in batches for r in b], S.PER_ACCOUNT)
    assert held[2] > 0 and held[-1] == 0


def test_cache_stream_equals_the_batch(spark, sf, tmp_path):
    from millrace.plans import session_queries as Q

    answers = Q._answers(spark, sf).select("question_key", "answer", "status", "at", F.lit("v1").alias("version"), "first_turn")
    half = answers.approxQuantile("at", [0.5], 0.0)[0]
    schema = "question_key string, answer string, status string, at long, version string, first_turn boolean"
    asks = answers.where("at % 3 = 0").select("question_key", F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("status"), F.col("at") + 10**9, "version", F.lit(True).alias("first_turn"))
    other = answers.where("at % 5 = 0 and question_key is not null").limit(1).select("question_key", F.lit("of the next version").alias("answer"), F.lit("answered").alias("status"), (F.col("at") + 2 * 10**9).alias("at"), F.lit("v2").alias("version"), "first_turn")
    again = other.select("question_key", F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("status"), (F.col("at") + 10**9).alias("at"), F.lit("v1").alias("version"), F.lit(True).alias("first_turn"))
    batches = [spark.createDataFrame(b.collect(), schema) for b in (answers.where(F.col("at") <= half), answers.where(F.col("at") > half), asks, other, again)]
    got, _ = streamed(spark, tmp_path, schema, batches, S.cache_stream, "cache", "false")
    cache = S.cache_upsert(spark.createDataFrame([], "question_key string, answer string, version string, hits long"), answers, "v1")
    want = {r.question_key: (r.answer, r.version, r.hits) for r in cache.collect()}
    last = {}
    for r in sorted((r for r in got if r.event == "stored" and r.version == "v1"), key=lambda r: r["at"]):
        last[r.question_key] = (r.answer, r.version, r.hits)
    assert last == want
    asked = [r for r in got if r.event in ("hit", "miss") and r.at < 2 * 10**9]
    looked = S.cache_lookup(spark.createDataFrame(batches[2].collect(), schema).drop("answer"), cache, "question_key", "v1")
    assert {(r.at, r.answer, r.event == "hit") for r in asked} == {(r.at, r.answer, r.hit) for r in looked.collect()} and any(r.event == "hit" for r in asked)
    assert [r.event for r in got if r.at >= 3 * 10**9] == ["miss"]  # the new version's answer has dropped the old one
    assert len(got) == sum(b.count() for b in batches)


def test_cache_counts_hits_until_it_is_overwritten(spark, tmp_path):
    schema = "question_key string, at long, version string, answer string, status string, first_turn boolean"
    rows = [("a", 1, "v", None, None, True), ("a", 2, "v", "x", "answered", True), ("a", 3, "v", None, None, True), ("a", 4, "v", None, None, True), ("a", 5, "v", None, None, False), ("a", 6, "v", " ", "answered", True), ("a", 7, "v", "y", "out_of_scope", True), ("a", 8, "v", None, None, True), (None, 9, "v", None, None, True), (None, 10, "v", "z", "answered", True), ("a", 11, "v", "q", "not_found", True)]
    got, _ = streamed(spark, tmp_path, schema, [spark.createDataFrame(rows, schema)], S.cache_stream, "hits", "false")
    assert [(r.at, r.event, r.answer, r.hits) for r in sorted(got, key=lambda r: r["at"])] == [
        (1, "miss", None, 0), (2, "stored", "x", 0), (3, "hit", "x", 1), (4, "hit", "x", 2), (5, "miss", None, 0), (6, "ignored", " ", 0), (7, "stored", "y", 0), (8, "hit", "y", 1), (9, "miss", None, 0), (10, "ignored", "z", 0), (11, "ignored", "q", 0),
    ]


def test_conversation_stream_equals_the_batch(spark, sf, tmp_path):
    from millrace.operators import chat as C
    from millrace.plans import chat_queries as Q
    from millrace.streaming.conversation import context_stream

    turns = Q.talk(spark, sf).select("conv_id", "turn", F.timestamp_micros(((F.col("at") + 1_704_067_200) * 1_000_000).cast("long")).alias("sent"), "role", "text", "named")
    schema = "conv_id long, turn long, sent timestamp, role string, text string, named array<string>"
    rows = turns.collect()
    batches = [spark.createDataFrame([r for r in rows if lo <= r.turn < hi], schema) for lo, hi in ((0, 3), (3, 4), (4, 99))]
    batches += [spark.createDataFrame([(-1, 0, AT + dt.timedelta(days=k), "assistant", "", [])], schema) for k in (1, 2, 3)]
    got, held = streamed(spark, tmp_path, schema, batches, lambda s: context_stream(s, delay="1 hour"), "talk")
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(tuple(r)) for r in C.turn_context(Q.talk(spark, sf), "conv_id", "turn", "at", "role", "text", "named").select("conv_id", "turn", "text", *C.CONTEXT).collect())
    assert held[2] > 10 > held[-1]  # but for the last conversation all have ended
    flow = lambda df: sorted(repr(tuple(r)) for r in C.routed(df, Q.RULES).select("conv_id", "turn", "step", "status", "query", "best_score").collect())
    assert flow(spark.read.parquet(str(tmp_path / "talk-out"))) == flow(C.turn_context(Q.talk(spark, sf), "conv_id", "turn", "at", "role", "text", "named"))
