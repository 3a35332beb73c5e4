"""A similarity index that is kept: inverted lists of vectors with short codes, published in generations.

Vectors lie in folders by the list of their nearest centre, beside a code of some bytes each (product quantisation: the
nearest codeword of each part of what the centre leaves of the vector). A search reads the folders of the lists that its queries probe, first the
codes only, takes the best of each query by what the codes say, and reads those vectors in full for the exact scores. New vectors
are published as a further load, and replace those of the same id.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.vectors import BLOCK, STEP, TILE, _numbers, cosine, ranked_in
from millrace.sources import publish as P
from millrace.sources.folders import exists, read_text, write_new


@dataclass
class Model:
    centres: np.ndarray  # lists x dims, unit length
    books: np.ndarray  # parts x codewords x dims / parts

    def text(self) -> str:
        return json.dumps({"centres": self.centres.tolist(), "books": self.books.tolist()})

    @staticmethod
    def of(text: str) -> Model:
        found = json.loads(text)
        return Model(np.array(found["centres"]), np.array(found["books"]))


def _means(x: np.ndarray, k: int, rounds: int, unit: bool) -> np.ndarray:
    """Centres by Lloyd's rounds, from rows spread over x."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", lists: int = 16, parts: int = 16, codewords: int = 64, sample_rows: int = 20_000, rounds: int = 10) -> Model:
    """Centres and codewords from a sample of about `sample_rows` vectors at most, chosen by a hash of the id, which goes to the driver; every vector is indexed by them. All vectors have one length, which `parts` divides."""
    n, whole = vectors.count(), 1 << 62
    sample = vectors.where(F.col(vector_col).isNotNull() & (F.pmod(F.xxhash64(id_col, F.lit("index")), F.lit(whole)) < min(whole, whole * sample_rows // max(1, n)))).orderBy(id_col)
    x = np.array([r[0] for r in sample.select(vector_col).collect()], float)
    if not len(x):
        raise ValueError("an index needs vectors")
    x = _unit(x)
    centres = _means(x, lists, rounds, True)
    rest = (x - centres[(x @ centres.T).argmax(1)]).reshape(len(x), parts, -1)
    return Model(centres, np.stack([_means(rest[:, k], codewords, rounds, False) for k in range(parts)]))


def _matrix(vectors: pa.Array) -> np.ndarray:
    return _unit(vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1))


def coded(vectors: DataFrame, model: Model, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, list, code, embedding) of vectors that aren't null."""

    @F.arrow_udf("struct<list: int, code: binary>")
    def of(column: pa.Array) -> pa.Array:
        x = _matrix(column)
        own = (x @ model.centres.T).argmax(1)
        rest = (x - model.centres[own]).reshape(len(x), len(model.books), -1)
        codes = np.stack([((b**2).sum(1) - 2 * rest[:, k] @ b.T).argmin(1) for k, b in enumerate(model.books)], 1).astype(np.uint8)
        return pa.StructArray.from_arrays([pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", "code"])

    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"), of(F.col(vector_col)).alias("_x"))
    return rows.select("id", "_x.list", "_x.code", "embedding")


def build(vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", load: str = "first", **options) -> None:
    """Fits a model, unless the folder has one, and publishes the vectors as the index's first load."""
    spark = vectors.sparkSession
    if not exists(spark, f"{path}/model.json"):
        write_new(spark, f"{path}/model.json", fit(vectors, id_col, vector_col, **options).text())
    add(vectors, path, load, id_col, vector_col)


def add(vectors: DataFrame, path: str, load: str, id_col: str = "vec_id", vector_col: str = "embedding") -> int:
    """Publishes further vectors, which replace those of the same ids; returns the generation that has them."""
    return P.publish(coded(vectors, model_of(vectors.sparkSession, path), id_col, vector_col), path, load, "id", by="list")


def model_of(spark: SparkSession, path: str) -> Model:
    return Model.of(read_text(spark, f"{path}/model.json"))


def rows_of(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The index's rows that count: (id, list, code, embedding)."""
    return P.published(spark, path, f"id {id_type}, code binary, embedding array<float>, list int", "id")


def probed(queries: DataFrame, model: Model, probes: int) -> DataFrame:
    """queries (query_id, q), a row for each of the `probes` lists whose centres are nearest."""

    @F.arrow_udf("array<int>")
    def of(column: pa.Array) -> pa.Array:
        near = (-(_matrix(column) @ model.centres.T)).argsort(1, kind="stable")[:, :probes]
        return pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))

    return queries.where("q is not null").withColumn("list", F.explode(of(F.col("q"))))


def _best_by_code(rows: DataFrame, asked: DataFrame, model: Model, rerank: int) -> DataFrame:
    """(query_id, id, list, score) of the best `rerank` of each query in each list and tile, by the inner products with the centre and the codewords."""
    books = model.books

    def of(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        n, m = len(chunks), len(queries)
        q, x, score = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        if n and m:
            codes = np.frombuffer(b"".join(chunks["code"].to_pylist()), np.uint8).reshape(n, -1)
            whole = _matrix(queries["q"].combine_chunks())
            cut = whole.reshape(m, len(books), -1)
            centre, ids = model.centres[chunks["list"][0].as_py()], chunks["id"].to_numpy()
            found, best = [], []
            for at in range(0, m, STEP):  # so many queries at once, as in the exact search
                some = slice(at, at + STEP)
                scores = np.repeat(whole[some] @ centre, n).reshape(-1, n)
                for k, book in enumerate(books):
                    scores += (cut[some, k] @ book.T)[:, codes[:, k]]
                first = np.stack([np.lexsort((ids, -row))[:rerank] for row in scores])
                found.append(first.ravel()), best.append(np.take_along_axis(scores, first, 1).ravel())
            x, score = np.concatenate(found), np.concatenate(best)
            q = np.repeat(np.arange(m), min(n, rerank))
        return pa.table({"query_id": queries["query_id"].take(pa.array(q)), "id": chunks["id"].take(pa.array(x)), "list": chunks["list"].take(pa.array(x)), "score": score})

    schema = T.StructType([asked.schema["query_id"], rows.schema["id"], T.StructField("list", T.IntegerType()), T.StructField("score", T.DoubleType())])
    keys = ["list", "tile", "block"]
    return rows.select(*keys, "id", "code").groupBy(*keys).cogroup(asked.select(*keys, "query_id", "q").groupBy(*keys)).applyInArrow(of, schema)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 8, probes: int = 4, rerank: int = 128, id_type: str = "bigint", tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """(query_id, id, rank, score): of each of queries (query_id, q) about its k best vectors, by exact cosine, of equal ones the smaller id first.

    Each query meets the codes of its `probes` lists, in tiles, however long a list is; of these the `rerank` best are compared in full. Lists that no query probes aren't read.
    """
    model = model_of(spark, path)
    asked = probed(queries, model, probes)
    wanted = sorted(r["list"] for r in asked.select("list").distinct().collect())  # at most as many as there are lists
    rows = rows_of(spark, path, id_type).where(F.col("list").isin(wanted))
    blocks = math.ceil(queries.count() / block)
    sizes = rows.groupBy("list").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    placed = rows.join(sizes, "list").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles").cast("long"))).withColumn("block", F.explode(_numbers(blocks)))
    asked = asked.join(sizes, "list").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles").cast("long") - 1))).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, blocks))))
    best = ranked_in(_best_by_code(placed, asked, model, rerank), "query_id", rerank, [F.desc("score"), "id"]).select("query_id", "id", "list")
    exact = best.join(rows.select("list", "id", "embedding"), ["list", "id"]).join(queries, "query_id").select("query_id", "id", F.round(cosine(F.col("embedding"), F.col("q")), 9).alias("score"))
    return ranked_in(exact, "query_id", k, [F.desc("score"), "id"]).withColumn("score", F.round("score", 4))
