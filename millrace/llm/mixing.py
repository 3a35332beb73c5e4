"""Mixing sources to target weights: temperature, then budgeted block permutations.

Weights are the sources' token shares raised to an exponent between 0 (all alike) and 1 (as they are) and normalised. The
exponent is found by bisection, as the one nearest to 1 that reaches a target entropy, or nearest to 0 that keeps every
source within a repetition limit. What it needs of the sources are sums over them, taken by Spark for some exponents at a time, so sources
may be many. Each source then owes weight x budget tokens (of words, the unit here). It is read as whole passes over its
documents plus a part of one more. A pass is a permutation of the source's blocks of its own, where a block is the documents with one value of a
keyed hash; a block's position in the pass is its rank by a hash that is keyed by pass. The part takes whole blocks by position while they fit, and of
the next block whole documents while they fit.

No task sees a whole source: blocks are ranked in slices of the permuted order, whose sizes are added up first.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import cut, stored, words

RESULTS = ("n_tokens", "pass", "block", "position")
#: Parts into which a step of the bisection cuts what is left, and steps: together some 48 bits.
_PARTS, _STEPS = 16, 12
#: Blocks that are ranked together.
_SLICE = 4096


def _bisect(good: Callable[[list[float]], list[bool]], low: float, high: float) -> float:
    """good(low) holds, and up to some point after it; the last exponent where it does."""
    if good([high])[0]:
        return high
    for _ in range(_STEPS):
        inner = [low + (high - low) * k / _PARTS for k in range(1, _PARTS)]
        held = [low, *(x for x, ok in zip(inner, good(inner), strict=True) if ok)]
        low, high = held[-1], ([*inner, high][len(held) - 1])
    return low


@dataclass(frozen=True)
class Mix:
    """What is owed: exponent, budget in tokens, and the sum of the powers of all shares, by which they are normalised."""

    exponent: float
    budget: int
    norm: float

    def weight(self, share: float) -> float:
        return share**self.exponent / self.norm if share else 0.0


def plan(tokens: tuple[int, int, int], sums: Callable[[list[float]], list[tuple[float, float]]], target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None) -> Mix:
    """The mix for sources of which the smallest, the largest and all together have so many tokens (those without tokens left out).

    sums: for exponents a, the sums over all shares p of p^a and of p^a log2 p. target_entropy: bits; the exponent nearest to 1
    whose weights have at least this entropy (0, if none has). max_repeats: the exponent nearest to 0 with which no source is
    read more often than this. Given both, the limit on repeats wins. budget: tokens in all; by default the least with which
    every source is read once in full, so that nothing is lost.
    """
    least, most, total = tokens
    if not total:
        return Mix(1.0, 0, 1.0)
    low, high = least / total, most / total

    def owed(a: float, norm: float) -> float:
        return float(budget) if budget is not None else total * high ** (1 - a) * norm

    def repeats(exponents: list[float]) -> list[float]:
        return [owed(a, norm) * low ** (a - 1) / (norm * total) for a, (norm, _) in zip(exponents, sums(exponents), strict=True)]

    def entropies(exponents: list[float]) -> list[float]:
        return [math.log2(norm) - a * logs / norm for a, (norm, logs) in zip(exponents, sums(exponents), strict=True)]

    exponent = 1.0 if target_entropy is None and max_repeats is None else 0.0
    if target_entropy is not None:
        exponent = _bisect(lambda xs: [x >= target_entropy - 1e-12 for x in entropies(xs)], 0.0, 1.0)
    if max_repeats is not None and repeats([exponent])[0] > max_repeats + 1e-12:
        exponent = 1.0 - _bisect(lambda xs: [x <= max_repeats + 1e-12 for x in repeats([1.0 - d for d in xs])], 0.0, 1.0 - exponent)
    norm = sums([exponent])[0][0]
    return Mix(exponent, math.ceil(owed(exponent, norm) - 1e-6), norm)


def _sums(shares: DataFrame) -> Callable[[list[float]], list[tuple[float, float]]]:
    def of(exponents: list[float]) -> list[tuple[float, float]]:
        power = [F.pow("share", F.lit(a)) for a in exponents]
        row = shares.agg(*[F.sum(p) for p in power], *[F.sum(p * F.log2("share")) for p in power]).first()
        return list(zip(row[: len(power)], row[len(power) :], strict=True))

    return of


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float | None = None,
    max_repeats: float | None = None, budget: int | None = None, block_docs: int = 1000, seed: int = 11,
) -> DataFrame:
    """mix_sources() with the columns of docs together in one, doc: whatever their names, none is lost."""
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("n_tokens"))
    rows = cut(boxed.select("id", "source", "n_tokens"))  # no texts
    sources = stored(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.greatest(F.lit(1), F.round(F.count("*") / block_docs)).cast("long").alias("blocks")))
    sizes = sources.where("tokens > 0").agg(F.min("tokens"), F.max("tokens"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    shares = sources.where("tokens > 0").select((F.col("tokens") / sizes[2]).alias("share")) if sizes[2] else sources
    mix = plan(tuple(sizes), _sums(shares), target_entropy, max_repeats, budget)
    owed = F.floor(mix.budget * F.pow(F.col("tokens") / max(1, sizes[2]), F.lit(mix.exponent)) / mix.norm + 1e-6)
    full = F.col("tokens") > 0
    sources = stored(sources.select(
        F.col("source").alias("s"), "blocks", F.when(full, F.floor(owed / F.col("tokens"))).otherwise(1).cast("int").alias("passes"), F.when(full, owed % F.col("tokens")).otherwise(0).cast("long").alias("rest"),
    ))
    # Spark broadcasts the sources, and the plays below, only where they are small.
    blocked = lambda df: df.join(sources, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks")).cast("int")).drop("s")

    # A play is one reading of a block: its turn in the pass, its position by that, and the tokens before it.
    blocks = blocked(rows).groupBy("source", "block", "blocks", "passes", "rest").agg(F.sum("n_tokens").alias("size"))
    reads = F.col("passes") + (F.col("rest") > 0).cast("int")
    plays = blocks.withColumn("pass", F.explode(F.when(reads > 0, F.sequence(F.lit(0), reads - 1)).otherwise(F.array().cast("array<int>"))))
    plays = plays.withColumn("turn", F.xxhash64("block", "source", "pass", F.lit(seed + 1)))
    plays = cut(plays.withColumn("slice", F.floor((F.col("turn").cast("double") / 2.0**64 + 0.5) * F.ceil(F.col("blocks") / _SLICE))))
    earlier = Window.partitionBy("source", "pass").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = plays.groupBy("source", "pass", "slice").agg(F.sum("size").alias("size"), F.count("*").alias("n")).select(
        F.col("source").alias("s"), F.col("pass").alias("p"), F.col("slice").alias("l"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("tokens_before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("blocks_before")
    )
    inside = Window.partitionBy("source", "pass", "slice").orderBy("turn", "block")
    before = F.col("tokens_before") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plays = plays.join(slices, F.col("source").eqNullSafe(F.col("s")) & (F.col("pass") == F.col("p")) & (F.col("slice") == F.col("l")))
    plays = plays.withColumn("before", before).withColumn("position", F.col("blocks_before") + F.row_number().over(inside) - 1)
    partial = F.col("pass") == F.col("passes")
    plays = plays.where(~partial | (F.col("before") < F.col("rest"))).select(
        F.col("source").alias("s"), F.col("block").alias("b"), "pass", "position", F.when(partial & (F.col("before") + F.col("size") > F.col("rest")), F.col("rest") - F.col("before")).alias("room")
    )
    plays = stored(plays)
    same_block = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
    # Of the block that only fits in part, at most one a source, the last document, in the order of its key, that still fits.
    key = F.struct(F.xxhash64("id", F.lit(seed + 2)), F.col("id"))
    cut_block = blocked(rows).join(plays.where("room is not null"), same_block).withColumn("key", key)
    upto = F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("key"))
    last = cut_block.withColumn("upto", upto).where("upto <= room").groupBy(F.col("source").alias("s2")).agg(F.max("key").alias("last"))
    plays = stored(plays.join(last, F.col("s").eqNullSafe(F.col("s2")), "left").drop("s2"))
    return blocked(boxed).join(plays, same_block).where(F.col("room").isNull() | (key <= F.col("last"))).select("doc", *RESULTS)


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """A row for each time a document is read: all columns of docs, with n_tokens, pass (0 first), block, and position (the block's place in the pass, 0 first).

    options: those of mixed(). A null source is a source of its own. Documents without tokens (null, empty or white texts) cost nothing: they come with
    their block, and a source that has no others is read once. A block holds about `block_docs` documents; within the block that is cut, documents
    come in the order of a keyed hash, then of id, and rows that repeat an id are taken or left together. Of a text only its number of words
    counts, however long it is. Columns of docs named like a result are replaced. Empty input gives no rows.
    """
    names = [f"doc.`{c}`" for c in docs.columns if c not in RESULTS]
    return mixed(docs, **options).select(*names, *RESULTS)
