"""State that survives between requests: the sliding-log rate limiter and the versioned answer cache, as batch and as stream."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

# Windows in seconds, and accepted requests in each.
PER_ACCOUNT = ((60.0, 30),)
PER_ADDRESS = ((60.0, 20), (3600.0, 200))


def new_log(limits, times=()) -> deque:
    """The last accepted times, as many as the largest limit counts; older ones can't matter any more."""
    return deque(times, max(most for _, most in limits))


def admit(log: deque, now: float, limits) -> bool:
    """Whether a request is accepted, given the log of the accepted ones before it, in order; if so, the log has it.

    A window is full if the request that would have to leave it first, the `most`-th last one, is still in it.
    """
    full = any(len(log) >= most and now - log[-most] < window for window, most in limits)
    if not full:
        log.append(now)
    return not full


def client_address(forwarded: Column, peer: Column) -> Column:
    """The last entry of a forwarding header, which the own proxy wrote; else the peer."""
    return F.coalesce(F.nullif(F.trim(F.element_at(F.split(forwarded, ","), -1)), F.lit("")), peer)


def rate_limited(requests: DataFrame, key: str, at: str, id_col: str, limits=PER_ACCOUNT) -> DataFrame:
    """(key, id, at, accepted). A rejected request doesn't count against later ones, so no window frame can say this.

    A task goes through one key's requests at a time, in order of time, and holds the accepted ones of the longest window:
    rows come sorted by key and time, so a key of any length is streamed, not gathered.
    """
    rows = requests.select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.col(at).alias("at"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("t"))

    def judge(frames):
        now, log = None, new_log(limits)
        for frame in frames:
            accepted = []
            for key, t in zip(frame["key"], frame["t"], strict=True):
                if key != now:
                    now, log = key, new_log(limits)
                accepted.append(admit(log, t, limits))
            yield pd.DataFrame({"key": frame["key"], "id": frame["id"], "accepted": accepted})

    kind = lambda c: requests.schema[c].dataType
    schema = T.StructType([T.StructField("key", kind(key)), T.StructField("id", kind(id_col)), T.StructField("accepted", T.BooleanType())])
    ordered = rows.repartition("key").sortWithinPartitions("key", "t", "id").select("key", "id", "t")
    return ordered.mapInPandas(judge, schema).select(F.col("key").alias(key), F.col("id").alias(id_col), "accepted")


def window_count(requests: DataFrame, key: str, at: str, seconds: int = 60) -> DataFrame:
    """requests with the number of the key's requests in the seconds before and at each, accepted or not: no limiter, a cheap sight of load."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return requests.withColumn("recent", F.count("*").over(w))


class Limiter(StatefulProcessor):
    """The limiter over a stream: state is a key's log, and a timer that drops it once its last request has left the longest window."""

    def __init__(self, limits=PER_ACCOUNT):
        self.limits, self.longest = limits, max(window for window, _ in limits)

    def init(self, handle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "times array<double>")

    def handleInputRows(self, key, rows, timerValues):
        log = new_log(self.limits, self.times.get()[0] if self.times.exists() else ())
        before = tuple(log)
        for frame in rows:
            frame = frame[frame["id"].notna()].sort_values(["t", "id"])
            yield pd.DataFrame({"key": [key[0]] * len(frame), "id": frame["id"], "accepted": [admit(log, t, self.limits) for t in frame["t"]]})
        if tuple(log) != before:
            self.times.update((list(log),))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((log[-1] + self.longest) * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.times.clear()
        return iter(())

    def close(self) -> None:
        pass


def limit_stream(requests: DataFrame, key_type: str = "long", id_type: str = "long", limits=PER_ACCOUNT, delay: str = "0 seconds") -> DataFrame:
    """requests (key, id, at), a stream -> (key, id, accepted).

    Requests of a key are judged in order of time within what arrives together; those more than `delay` behind the latest of all count as late, and Spark
    leaves them out. Rows without an id are no requests, they only move the clock. A key without a request within the longest window holds no state.
    """
    rows = requests.withWatermark("at", delay).withColumn("t", F.unix_micros("at") / 1e6)
    return rows.groupBy("key").transformWithStateInPandas(Limiter(limits), f"key {key_type}, id {id_type}, accepted boolean", "Append", "EventTime")


def cache_lookup(questions: DataFrame, cache: DataFrame, key: str, version: str) -> DataFrame:
    """questions with the cached answer of their key, if it is of this version and no history came before; hit says so."""
    current = cache.where(F.col("version") == version).select(F.col("question_key").alias("_k"), "answer", "hits")
    usable = F.when(F.col("first_turn"), F.col(key))
    return questions.join(current, usable == F.col("_k"), "left").withColumn("hit", F.col("_k").isNotNull()).drop("_k")


#: Statuses of answers that a cache may hold.
STORABLE = ("answered", "out_of_scope")


def cache_upsert(cache: DataFrame, answers: DataFrame, version: str) -> DataFrame:
    """The cache after answers (question_key, answer, status, at): of a key the last storable one, with hits reset; others stay."""
    storable = answers.where(F.col("question_key").isNotNull() & F.col("status").isin(*STORABLE) & (F.trim("answer") != ""))
    last = storable.groupBy("question_key").agg(F.max_by(F.struct("answer", "status"), "at").alias("x"))
    fresh = last.select("question_key", "x.answer", F.lit(version).alias("version"), F.lit(0).cast("long").alias("hits"))
    return cache.select("question_key", "answer", "version", "hits").join(fresh, "question_key", "left_anti").unionByName(fresh)


class AnswerCache(StatefulProcessor):
    """A question's cached answer, by version, for as long as it lives."""

    def __init__(self, lifetime_ms: int):
        self.lifetime_ms = lifetime_ms

    def init(self, handle) -> None:
        self.entries = handle.getMapState("entries", "version string", "answer string, hits bigint", self.lifetime_ms)

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            out = []
            for row in frame.sort_values("at").itertuples():
                version = (row.version,)
                if isinstance(row.status, str):  # an answer
                    stored = row.status in STORABLE and isinstance(row.answer, str) and row.answer.strip(" ") != ""
                    if stored:
                        for old in [k for k in self.entries.keys() if tuple(k) != version]:
                            self.entries.removeKey(tuple(old))
                        self.entries.updateValue(version, (row.answer, 0))
                    out.append((key[0], row.at, "stored" if stored else "ignored", row.answer, row.version, 0))
                    continue
                hit = row.first_turn and self.entries.containsKey(version)
                answer, hits = self.entries.getValue(version) if hit else (None, -1)
                if hit:
                    self.entries.updateValue(version, (answer, hits + 1))
                out.append((key[0], row.at, "hit" if hit else "miss", answer, row.version, hits + 1))
            yield pd.DataFrame(out, columns=["question_key", "at", "event", "answer", "version", "hits"])

    def close(self) -> None:
        pass


def cache_stream(events: DataFrame, lifetime_ms: int = 30 * 24 * 3600 * 1000) -> DataFrame:
    """events (question_key, at long, version, answer, status, first_turn), a stream -> (question_key, at, event, answer, version, hits).

    A row without a status asks: it is a hit, with the answer, if an answer of its version is held and no turn came before it, else a miss. A row with one
    brings an answer: stored where its status allows and it isn't blank, else ignored. Storing resets the hits, and drops
    answers of other versions. An answer that isn't stored or asked for within its lifetime is dropped by Spark. Questions without a key are always a miss, or ignored.
    Of a key's rows that arrive together, earlier ones (`at`) come first.
    """
    columns = ["question_key", "at", "version", "answer", "status", "first_turn"]
    known = events.where("question_key is not null").select(*columns).groupBy("question_key")
    schema = "question_key string, at bigint, event string, answer string, version string, hits bigint"
    held = known.transformWithStateInPandas(AnswerCache(lifetime_ms), schema, "Append", "ProcessingTime")
    rest = events.where("question_key is null").select("question_key", "at", F.when(F.col("status").isNull(), "miss").otherwise("ignored").alias("event"), F.when(F.col("status").isNotNull(), F.col("answer")).alias("answer"), "version", F.lit(0).cast("long").alias("hits"))
    return held.unionByName(rest)
