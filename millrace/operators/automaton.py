"""Many names in many texts: a multi-pattern automaton (Aho-Corasick) goes over each text once, however many names there are."""

from __future__ import annotations

import math
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns, and characters in all of them, that one automaton holds: some 100 MB at most.
MOST, MOST_CHARACTERS = 50_000, 1_000_000
#: Bytes of text that meet an automaton in a task, where there are several.
BLOCK = 32 << 20


def build(patterns: list[str]):
    """The automaton of different patterns; what it finds is a pattern's place in the list."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for k, pattern in enumerate(patterns):
        made.add_word(pattern, k)
    if patterns:
        made.make_automaton()
    return made


def first_found(machine, text: str | None) -> int | None:
    """The least place of a pattern that the text holds."""
    return min((k for _, k in machine.iter(text)), default=None) if text and len(machine) else None


#: The automaton of this Python worker, with what it is for: tasks that follow each other share it.
_WORKER: list[tuple[str, object]] = []


def _machine(key: str, patterns):
    if not _WORKER or _WORKER[0][0] != key:
        _WORKER[:] = [(key, build(patterns()))]
    return _WORKER[0][1]


def best_pattern(texts: DataFrame, text: Column, patterns: DataFrame, pattern: str, order: str, to: str, most: int = MOST, most_characters: int = MOST_CHARACTERS, block: int = BLOCK) -> DataFrame:
    """texts with `to`: the pattern of the least `order` that the text holds, or null. Null texts and empty patterns hold nothing.

    patterns: different strings, and their order, a column that can be compared; equal orders go by the pattern. Up to `most` patterns of `most_characters` make one
    automaton, which every task gets. More are dealt into shards by a hash, and texts into blocks; each shard
    meets each block in a task of its own, so nothing is broadcast, and a text's best pattern is that of its shards' bests.
    """
    listed = patterns.where(F.col(pattern) != "").select(F.col(pattern).alias("_p"), F.col(order).alias("_o"))
    n, characters = listed.agg(F.count("*"), F.coalesce(F.sum(F.length("_p")), F.lit(0))).first()
    shards = max(math.ceil(n / most), math.ceil(characters / most_characters))
    if shards <= 1:
        key, shared = uuid.uuid4().hex, texts.sparkSession.sparkContext.broadcast([r["_p"] for r in listed.orderBy("_o", "_p").collect()])

        @F.arrow_udf("string")
        def of(column: pa.Array) -> pa.Array:
            machine, known = _machine(key, lambda: shared.value), shared.value
            found = (first_found(machine, t) for t in column.to_pylist())
            return pa.array([None if k is None else known[k] for k in found], pa.string())

        return texts.withColumn(to, of(text))

    def meet(rows: pa.Table, names: pa.Table) -> pa.Table:
        names = names.select(["_o", "_p"])
        known = sorted(zip((_plain(x) for x in names["_o"].to_pylist()), names["_p"].to_pylist(), range(len(names)), strict=True))
        machine = build([p for _, p, _ in known])
        found = [(k, t) for k, t in zip(rows["_k"].to_pylist(), (first_found(machine, t) for t in rows["_t"].to_pylist()), strict=True) if t is not None]
        at = names.take(pa.array([known[t][2] for _, t in found], pa.int64()))
        return pa.table({"_k": pa.array([k for k, _ in found], pa.int64()), "_o": at["_o"], "_p": at["_p"]})

    asked = texts.select(text.alias("_t")).where("_t is not null and _t <> ''").withColumn("_k", F.xxhash64("_t"))
    blocks = max(1, math.ceil((asked.agg(F.sum(F.octet_length("_t"))).first()[0] or 0) / block))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = asked.select("_k", "_t", F.pmod("_k", F.lit(blocks)).cast("int").alias("_block"), numbers(shards).alias("_shard")).groupBy("_shard", "_block")
    names = listed.select("_o", "_p", F.pmod(F.xxhash64("_p"), F.lit(shards)).cast("int").alias("_shard"), numbers(blocks).alias("_block")).groupBy("_shard", "_block")
    schema = T.StructType([T.StructField("_k", T.LongType()), T.StructField("_o", listed.schema["_o"].dataType), T.StructField("_p", T.StringType())])
    best = rows.cogroup(names).applyInArrow(meet, schema).groupBy("_k").agg(F.min(F.struct("_o", "_p"))["_p"].alias(to))
    return texts.join(best, F.xxhash64(text) == F.col("_k"), "left").drop("_k")


def _plain(x):
    """A value that compares as Spark's does: null first."""
    if isinstance(x, dict):
        return tuple(_plain(v) for v in x.values())
    return (x is not None, x if x is not None else 0)
