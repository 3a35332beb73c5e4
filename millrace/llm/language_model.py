"""Language-model scoring by deleted interpolation of word bigrams.

P(w | v) = a * c(v, w) / c(v) + b * c(w) / N + c / (V + 1), with weights (a, b, c) for each bucket of context frequency
(the power of two below c(v)). The weights are learned by expectation-maximisation on held-out counts: each training token
is predicted from the counts of all others, that is with its own occurrence deleted.

Counts of a corpus have no bound, so they are never broadcast. Documents are encoded once, as blocks of some megabytes
with a dictionary of their own, into a table that is bucketed by block. A block asks for what it needs: for its different
words and bigrams it sends 64-bit hashes with its own counts to shards of the hash space, packed, each kind once, however
frequent it is. A shard adds up and answers with the totals in the order asked. So a very frequent word or bigram costs
one number for each block, and a task holds one block, or one shard's requests. Words and bigrams are told apart by these hashes.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import cut, dropped, shared_folder, shuffle_partitions, size_in_bytes, small_batches

#: Buckets of context frequency: by powers of two, the last for all beyond.
BUCKETS = 32
_END = np.uint64(xxhash.xxh3_64_intdigest(b" "))  # no word is a space


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, dtype, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype)


def _pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (v ^ (v >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _block(number: int, ids: pa.Array, texts: pa.Array, held: pa.Array) -> dict:
    """Texts as codes of a dictionary (0: the end of a text)."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), "[\\x20\\x09-\\x0D]+")
    found, of = lists.flatten(), pc.list_parent_indices(lists)
    word = pc.not_equal(found, "")
    coded, of = found.filter(word).dictionary_encode(), of.filter(word).to_numpy()
    sizes = np.bincount(of, minlength=len(texts)) + 1
    codes = np.zeros(int(sizes.sum()), np.int32)
    codes[np.arange(len(of)) + of] = coded.indices.to_numpy(zero_copy_only=False) + 1
    words = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    train = int(sizes[~held.to_numpy(zero_copy_only=False)].sum())
    return {"block": number, "ids": ids, "held": held, "sizes": _pack(sizes.astype(np.int32)), "n_words": len(words) + 1, "words": _pack(np.append(_END, words)), "codes": _pack(codes), "n_codes": len(codes), "train_tokens": train}


def _kinds(row: dict) -> dict:
    """A block's tokens, and its different words and bigrams with the counts in training texts."""
    n, k = row["n_codes"], row["n_words"]
    codes, words = _unpack(row["codes"], np.int32, n), _unpack(row["words"], np.uint64, k)
    sizes = _unpack(row["sizes"], np.int32, len(row["held"]))
    training = np.repeat(~np.asarray(row["held"], bool), sizes)
    pairs, pair = np.unique(np.concatenate([[0], codes[:-1]]).astype(np.int64) * k + codes, return_inverse=True)
    first, second = pairs // k, pairs % k
    count = lambda x, size: np.bincount(x[training], minlength=size).astype(np.uint32)
    return {
        "sizes": sizes, "codes": codes, "pair": pair, "first": first, "second": second,
        "words": (words, count(codes, k)), "pairs": (_pair_hash(words[first], words[second]), count(pair, len(pairs))),
    }


def _shards(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts each shard's hashes together, and where each shard starts and ends."""
    shard = (hashes >> np.uint64(20)) % np.uint64(shards)
    return np.argsort(shard, kind="stable"), np.append(0, np.cumsum(np.bincount(shard.astype(np.int64), minlength=shards)))


def _ask(shards: int):
    def of(batches):
        for batch in batches:
            for row in batch.to_pylist():
                kinds = _kinds(row)
                asked = ((0, kinds["words"]), (shards, kinds["pairs"]))
                del kinds  # the tokens' codes aren't needed here
                for base, (hashes, counts) in asked:
                    order, at = _shards(hashes, shards)
                    rows = [(base + s, hashes[order[at[s] : at[s + 1]]], counts[order[at[s] : at[s + 1]]]) for s in range(shards) if at[s] < at[s + 1]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["block"]] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([_pack(r[2]) for r in rows], pa.binary())],
                        ["block", "shard", "hashes", "counts"],
                    )

    return of


def _answer(group: pa.Table) -> pa.Table:
    """Totals for the requests of one shard; its number of different kinds in training texts goes with the first."""
    hashes = [np.frombuffer(x.as_py(), np.uint64) for x in group["hashes"]]
    counts = [_unpack(x.as_py(), np.uint32, len(h)) for x, h in zip(group["counts"], hashes, strict=True)]
    kinds, kind = np.unique(np.concatenate(hashes), return_inverse=True)
    totals = np.bincount(kind, np.concatenate(counts), len(kinds))
    ends = np.cumsum([len(h) for h in hashes])
    told = [_pack(totals[x].astype(np.uint64)) for x in np.split(kind, ends[:-1])]
    seen = [int((totals > 0).sum())] + [0] * (len(told) - 1)
    return pa.table({"block": group["block"], "shard": group["shard"], "totals": pa.array(told, pa.binary()), "seen": pa.array(seen, pa.int64())})


def _totals(kinds: dict, answers: pa.Table, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The corpus counts of a block's words and bigrams."""
    told = dict(zip(answers["shard"].to_pylist(), answers["totals"].to_pylist(), strict=True))
    out = []
    for base, (hashes, _) in ((0, kinds["words"]), (shards, kinds["pairs"])):
        order, at = _shards(hashes, shards)
        total = np.empty(len(hashes))
        for s in range(shards):
            if at[s] < at[s + 1]:
                total[order[at[s] : at[s + 1]]] = _unpack(told[base + s], np.uint64, at[s + 1] - at[s])
        out.append(total)
    return out[0], out[1]


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the power of two below its count."""
    return np.where(context > 0, np.minimum(1 + np.floor(np.log2(np.maximum(context, 1))), BUCKETS - 1), 0).astype(np.int64)


def _over(a: np.ndarray, b) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)


def _deleted(shards: int, n: int):
    """Held-out counts of a block: training tokens by bucket and by their estimates without themselves, in steps of a quarter of a power of two."""

    def step(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.round(4 * np.log2(np.maximum(p, 1e-300))), 10_000).astype(np.int32)

    def of(block: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = _kinds(block.to_pylist()[0])
        word, pair = _totals(kinds, answers, shards)
        tokens = kinds["pairs"][1].astype(float)
        used = tokens > 0
        context, then, joint, tokens = word[kinds["first"]][used], word[kinds["second"]][used], pair[used], tokens[used]
        p2, p1 = _over(joint - 1, context - 1), _over(then - 1, np.full(len(then), n - 1.0))
        frame = pa.table({"bucket": _bucket(context - 1), "s2": step(p2), "s1": step(p1), "tokens": tokens, "p2": tokens * p2, "p1": tokens * p1})
        return frame.group_by(["bucket", "s2", "s1"]).aggregate([(c, "sum") for c in ("tokens", "p2", "p1")]).rename_columns(["bucket", "s2", "s1", "tokens", "p2", "p1"])

    return of


def learn_weights(cells: list[tuple[int, float, float, float]], uniform: float, rounds: int = 60) -> np.ndarray:
    """BUCKETS x 3 weights, of bigram, unigram and uniform, by EM on cells (bucket, tokens, bigram and unigram estimate)."""
    out = np.zeros((BUCKETS, 3))
    table = np.array(cells, float).reshape(-1, 4)
    for bucket in range(BUCKETS):
        mine = table[table[:, 0] == bucket] if bucket else table
        p = np.column_stack([mine[:, 2] if bucket else np.zeros(len(mine)), mine[:, 3], np.full(len(mine), uniform)])
        w = np.array([1 / 3, 1 / 3, 1 / 3]) if bucket else np.array([0, 0.5, 0.5])
        for _ in range(rounds if len(mine) else 0):
            shares = p * w
            shares *= (mine[:, 1] / np.maximum(shares.sum(1), 1e-300))[:, None]
            w = shares.sum(0) / shares.sum()
        out[bucket] = w
    return out


def _score(shards: int, n: int, v: int, weights: np.ndarray):
    def of(block: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = _kinds(block.to_pylist()[0])
        word, pair = _totals(kinds, answers, shards)
        context, then = word[kinds["first"]], word[kinds["second"]]
        w = weights[_bucket(context)]
        p = w[:, 0] * _over(pair, context) + w[:, 1] * then / max(n, 1) + w[:, 2] / (v + 1)
        ends = np.append(0, np.cumsum(kinds["sizes"], dtype=np.int64)[:-1])
        add = lambda x, per: np.add.reduceat(x[per], ends)
        base = np.log10((word + 0.1) / (n + 0.1 * (v + 1)))
        ids = block["ids"].combine_chunks().flatten()
        return pa.table({
            "id": ids, "held_out": block["held"].combine_chunks().flatten(), "n_tokens": pa.array(kinds["sizes"].astype(np.int64)), "n_known": pa.array(add((word > 0).astype(np.int64), kinds["codes"])),
            "base_score": pa.array(add(base, kinds["codes"])), "score": pa.array(add(np.log10(p), kinds["pair"])),
        })

    return of


def _scored(blocks: DataFrame, kind: T.DataType) -> tuple[DataFrame, int]:
    """(id, held_out, n_tokens, n_known, base_score, score) of all blocks' texts, and the number of training tokens."""
    # A shard answers for as much as two blocks ask.
    shards, n = blocks.agg(F.greatest(F.ceil(F.count("*") / 2), F.lit(1)), F.coalesce(F.sum("train_tokens"), F.lit(0))).first()

    asked = blocks.drop("ids").mapInArrow(_ask(shards), "block long, shard int, hashes binary, counts binary")
    answers = cut(asked.groupBy("shard").applyInArrow(_answer, "block long, shard int, totals binary, seen long"))
    v = answers.where(F.col("shard") < shards).agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0]
    answers = answers.select("block", "shard", "totals")

    def with_answers(columns: list[str], of, schema) -> DataFrame:
        return blocks.select("block", *columns).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(of, schema)

    coded = ["held", "sizes", "words", "codes", "n_words", "n_codes"]
    cells = with_answers(coded, _deleted(shards, n), "bucket long, s2 int, s1 int, tokens double, p2 double, p1 double").groupBy("bucket", "s2", "s1").agg(*[F.sum(c).alias(c) for c in ("tokens", "p2", "p1")])
    # At most buckets x steps x steps cells, whatever the corpus.
    weights = learn_weights([(r.bucket, r.tokens, r.p2 / r.tokens, r.p1 / r.tokens) for r in cells.collect()], 1 / (v + 1))
    schema = T.StructType([T.StructField("id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return cut(with_answers(["ids", *coded], _score(shards, n, v, weights), schema)), n


def score_texts(docs: DataFrame, held_out: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """One row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the text, A-Z lower-cased, and one end; the first word follows an end. held_out: SQL condition
    on the id; texts where it holds are scored, not learned from. n_known: tokens found in training texts. base_score: the
    sum of log10 of (c + 0.1) / (N + 0.1 (V + 1)); score: the log10 probability under the interpolated model. A null or
    empty text is one end. Repeated rows are rows of their own and all counted. Texts are scored whole; a very long one is a
    block of its own. An empty table gives no rows, and one without training texts the uniform model. Other columns of docs aren't returned.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType

    def encode(batches):
        part, number, ids, texts, held, total = TaskContext.get().partitionId(), 0, [], [], [], 0

        def done():
            pa.default_memory_pool().release_unused()
            row = _block((part << 24) + number, pa.concat_arrays(ids), pa.concat_arrays(texts), pa.concat_arrays(held))
            ids.clear(), texts.clear(), held.clear()
            return pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64())] + [pa.ListArray.from_arrays(pa.array([0, len(row[c])], pa.int32()), row[c]) for c in ("ids", "held")] + [pa.array([row[c]]) for c in ("sizes", "words", "codes")] + [pa.array([row[c]], pa.int64()) for c in ("n_words", "n_codes", "train_tokens")], ["block", "ids", "held", "sizes", "words", "codes", "n_words", "n_codes", "train_tokens"])

        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < len(batch):
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + block_bytes - total, "right")))
                ids.append(batch.column(0).slice(at, end - at)), texts.append(batch.column(1).slice(at, end - at)), held.append(batch.column(2).slice(at, end - at))
                total += int(sizes[end - 1] - (sizes[at - 1] if at else 0))
                at = end
                if total >= block_bytes or at < len(batch):
                    yield done()
                    number, total = number + 1, 0
        if ids:
            yield done()

    fields = [("block", T.LongType()), ("ids", T.ArrayType(kind)), ("held", T.ArrayType(T.BooleanType())), ("sizes", T.BinaryType()), ("words", T.BinaryType()), ("codes", T.BinaryType()), ("n_words", T.LongType()), ("n_codes", T.LongType()), ("train_tokens", T.LongType())]
    held = F.coalesce(F.expr(held_out), F.lit(False))
    blocks = docs.select(F.col(id_col), F.col(text_col), held.alias("held")).mapInArrow(encode, T.StructType([T.StructField(*f) for f in fields]))
    # Bucketed by block, so that the joins below move the answers only; and fixed, so that a block stays what it was.
    name = f"millrace_lm_{uuid.uuid4().hex}"
    # Buckets of some 64 MB of input, however much there is of it.
    buckets = max(shuffle_partitions(spark), -(-size_in_bytes(docs, text_col) // (64 << 20)))
    path = f"{shared_folder(spark)}/{name}"
    try:
        blocks.write.bucketBy(min(buckets, 100_000), "block").option("path", path).option("compression", "none").saveAsTable(name)
        scored, n = _scored(spark.table(name), kind)
    finally:  # the result is in the shared folder by itself
        spark.sql(f"drop table if exists {name}")
        dropped(spark, path)
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
