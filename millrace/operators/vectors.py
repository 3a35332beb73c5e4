"""Similarity search: every query against every chunk, overall, in a scope and for each group; score fusion and what follows from scores.

Queries are rows, as chunks are. Both are dealt into tiles, every tile of chunks meets every block of queries in a task of its own
as one matrix product, and what leaves a task is the best of each query there. No side is broadcast or collected, however many
queries or chunks there are. Scores are rounded to 9 places before they are ranked, so equal vectors tie.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Chunks and queries that meet in a task, at most; bytes of vectors on either side; and the queries of one matrix product.
TILE, BLOCK, BYTES, STEP = 8192, 8192, 64 << 20, 256
#: Chunks and queries that meet where every pair is returned: half a million pairs, which take some 50 MB.
PAIRS_TILE, PAIRS_BLOCK = 1024, 512


def _matrix(vectors: pa.ChunkedArray, dims: int) -> np.ndarray:
    return vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def _meet(rows: DataFrame, asked: DataFrame, keys: list[str], k: int | None, id_col: str, group: str | None) -> DataFrame:
    """The k best rows (all, if None) of each query, and of each group, within each set of equal keys: (query_id, id, group, score)."""
    names = [id_col] + ([group] if group else [])

    def of(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        n, m = len(chunks), len(queries)
        x, q, score = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
        if n and m:
            dims = chunks["dims"][0].as_py()
            a, every, ids = _matrix(chunks["embedding"], dims), _matrix(queries["q"], dims), chunks[id_col].to_numpy()
            of_group = np.unique(chunks[group].to_numpy(), return_inverse=True)[1] if group else np.zeros(n, int)
            for at in range(0, m, STEP):
                b = every[at : at + STEP]
                norms = np.linalg.norm(b, axis=1)[:, None] * np.linalg.norm(a, axis=1)
                scores = np.round(np.divide(b @ a.T, norms, out=np.zeros((len(b), n)), where=norms > 0), 9) + 0.0
                if k is None:
                    found = [np.arange(n)] * len(b)
                else:
                    orders = [np.lexsort((ids, -row, of_group)) for row in scores]
                    found = [order[np.arange(n) - np.searchsorted(of_group[order], of_group[order]) < k] for order in orders]
                q.append(at + np.repeat(np.arange(len(b)), [len(f) for f in found])), x.append(np.concatenate(found))
                score.append(scores[q[-1] - at, x[-1]])
        x, q, score = map(np.concatenate, (x, q, score))
        return pa.table({"query_id": queries["query_id"].take(pa.array(q))} | {c: chunks[c].take(pa.array(x)) for c in names} | {"score": score})

    schema = T.StructType([asked.schema["query_id"], *[rows.schema[c] for c in names], T.StructField("score", T.DoubleType())])
    keys = [*keys, "dims"]
    rows = rows.where("embedding is not null").withColumn("dims", F.size("embedding")).select(*keys, *names, "embedding")
    asked = asked.where("q is not null").withColumn("dims", F.size("q")).select(*keys, "query_id", "q")
    return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(of, schema)


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(max(1, n) - 1).cast("long"))


def similarities(chunks: DataFrame, queries: DataFrame, k: int | None = None, group: str | None = None, id_col: str = "vec_id", tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """chunks (id, embedding), queries (query_id, q) -> (query_id, id, group, score): every pair, or of each tile the k best for each query (and group).

    A pair whose vectors differ in length, or are null, is left out; a vector without length has score 0.
    """
    if k is None:  # all pairs of a task are in memory at once
        tile, block = min(tile, PAIRS_TILE), min(block, PAIRS_BLOCK)
    parts = lambda df, vector, most: (lambda n, dims: math.ceil(n / max(1, min(most, BYTES // (8 * max(1, dims))))))(*df.agg(F.count("*"), F.coalesce(F.max(F.size(vector)), F.lit(0))).first())
    tiles, blocks = parts(chunks, "embedding", tile), parts(queries, "q", block)
    rows = chunks.withColumn("tile", F.pmod(F.xxhash64(id_col), F.lit(max(1, tiles)))).withColumn("block", F.explode(_numbers(blocks)))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, blocks)))).withColumn("tile", F.explode(_numbers(tiles)))
    return _meet(rows, asked, ["tile", "block"], k, id_col, group)


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in double precision; null if a vector is null or the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def vector(values) -> Column:
    """A query vector as a literal, so that it needs no join."""
    return F.array(*[F.lit(float(x)) for x in values])


def top_k(chunks: DataFrame, queries: DataFrame, k: int = 8, id_col: str = "vec_id") -> DataFrame:
    """(query_id, id, rank, score): each query's k best chunks, scores rounded to 4 places; equal scores by id. Filter chunks first: a scope is exact."""
    best = ranked_in(similarities(chunks, queries, k, id_col=id_col), "query_id", k, [F.desc("score"), id_col])
    return best.withColumn("score", F.round("score", 4))


def ranked_in(rows: DataFrame, group: str | list[str], k: int, order: list) -> DataFrame:
    """The first k rows of each group, with rank; tasks cut groups down before the shuffle."""
    keys = [group] if isinstance(group, str) else group
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def group_scores(chunks: DataFrame, queries: DataFrame, group: str, id_col: str, k: int = 5) -> DataFrame:
    """(query_id, group, score, chunk_ids): for each query the mean of the k best similarities of each group, and those chunks, best first."""
    best = ranked_in(similarities(chunks, queries, k, group, id_col), ["query_id", group], k, [F.desc("score"), id_col])
    ids = F.transform(F.sort_array(F.collect_list(F.struct("rank", id_col))), lambda x: x[id_col])
    return best.groupBy("query_id", group).agg(F.avg("score").alias("score"), ids.alias("chunk_ids"))


def centroids(chunks: DataFrame, group: str, embedding: str = "embedding") -> DataFrame:
    """(group, centroid): the mean vector of each group."""
    parts = chunks.select(group, F.posexplode(embedding).alias("k", "x")).groupBy(group, "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("centroid"))


def fuse(content: DataFrame, other: DataFrame, keys: list[str], weight: float = 0.5) -> DataFrame:
    """content (keys, score, ...) with score = weight x its own + (1 - weight) x other's (keys, other_score)."""
    return content.join(other, keys).withColumn("score", weight * F.col("score") + (1 - weight) * F.col("other_score")).drop("other_score")


# Fixed values, as defaults here: five chunks stand for a group, content and name weigh 0.5 each; programmes count within 0.04 of the best; scores from 0.35 on, over
# 0.37, are percents; a lead of 10 over the third of three is sure; two core rows, and 3,000 characters of evidence.


def collapse(rows: DataFrame, name: str | list[str], order: list) -> DataFrame:
    """The first row of each name."""
    return ranked_in(rows, name, 1, order).drop("rank")


def relevant(rows: DataFrame, by: str, margin: float = 0.04) -> DataFrame:
    """Rows whose score is at most `margin` below the best of their query."""
    best = rows.groupBy(by).agg(F.max("score").alias("_best"))
    return rows.join(best, by).where(F.col("score") >= F.col("_best") - margin).drop("_best")


def percent(score: Column, low: float = 0.35, span: float = 0.37) -> Column:
    """A score on a fixed scale of 0 to 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround((score - low) / span * 100, 0).cast("int")))


def confidence(rows: DataFrame, keys: list[str], gap: int = 10) -> DataFrame:
    """high if there are three or more results and the first is `gap` points above the third, else low. rows: percent, rank."""
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("percent")))
    return rows.groupBy(*keys).agg(F.when((F.count("*") >= 3) & (at(1) - at(3) >= gap), "high").otherwise("low").alias("confidence"))


def core_rows(chunks: DataFrame, group: str, page: str, id_col: str, wanted: Column, contents: Column, k: int = 2) -> DataFrame:
    """The first k chunks of each group, in page order, that hold a wanted heading and aren't a table of contents."""
    return ranked_in(chunks.where(wanted & ~contents), group, k, [page, id_col])


def evidence(rows: DataFrame, group: str, order: str, page: str, text: str, longest: int = 3000) -> DataFrame:
    """The rows' texts under page headers, in order, cut at `longest` characters."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order, page, text))), lambda x: F.concat(F.lit("[page "), x[page].cast("string"), F.lit("]\n"), x[text]))
    return rows.groupBy(group).agg(F.substring(F.array_join(parts, "\n\n"), 1, longest).alias("evidence"))
