"""Ranked lexical search: postings in term buckets, joined with the terms of the queries.

Every document's terms become postings (bucket, term, row, id, tf, n), in a table with a folder for each bucket of terms, so that a
search reads the buckets of its terms only. A term's postings stay spread over the files of the blocks of documents that made
them: no task holds a frequent term whole. A search joins the terms of all queries with the postings and scores
each posting in integers; a score doesn't depend on the query, so postings move once, by document, and meet the
queries there. Sums of a document then need no further shuffle, and only the best of each task are ranked together.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import ascii_lower, cut, in_slices, shared_folder, small_batches

#: For each byte of UTF-8 what it is in a term: letters in lower case, digits and all bytes of other characters themselves; else a space.
_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of a text that are taken apart at a time.
_PART = 4 << 20


def _long_counts(text: memoryview) -> Counter:
    """The terms of one very long text with their counts, some of it at a time: what is held grows with its different terms only."""
    counts, rest = Counter(), b""
    for k in range(0, len(text), _PART):
        some = rest + bytes(text[k : k + _PART]).translate(_BYTES)
        end = some.rfind(b" ") + 1 if k + _PART < len(text) else len(some)
        counts.update(some[:end].split())
        rest = some[end:]
    return counts


def term_counts(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """For each text's different terms: the text's index, the term, its count, and the number of the text's terms; in the order of texts."""
    data = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    whole = memoryview(data.buffers()[2] or b"")[ends[0] : ends[-1]]
    if len(data) == 1 and len(whole) > _PART:
        counts = _long_counts(whole)
        terms, tf = pa.array([t.decode() for t in counts], pa.string()), np.fromiter(counts.values(), np.int64, len(counts))
        return np.zeros(len(tf), np.int64), terms, tf, np.full(len(tf), tf.sum())
    plain = pa.Array.from_buffers(pa.large_string(), len(data), [None, pa.py_buffer((ends - ends[0]).astype(np.int64)), pa.py_buffer(bytes(whole).translate(_BYTES))])
    lists = pc.ascii_split_whitespace(plain)
    words, of = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(words), 0)
    coded, of = words.filter(full).dictionary_encode(), of[full.to_numpy(zero_copy_only=False)]
    kinds = max(1, len(coded.dictionary))
    pairs, tf = np.unique(of * kinds + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    of_pair = pairs // kinds
    return of_pair, coded.dictionary.take(pa.array(pairs % kinds)).cast(pa.string()), tf, np.bincount(of, minlength=len(lists))[of_pair]


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16) -> DataFrame:
    """A row for each different term of each row of docs: bucket, term, row (a number for each row of docs), id, tf, n (the row's terms, with repeats), lead (in one posting of each row).

    Terms are the maximal runs of ASCII letters, digits and all characters beyond ASCII, only A-Z lower-cased. Null and empty texts have no postings. Texts
    are read whole, very long ones piece by piece. Rows that repeat are rows of their own. row differs each time it is computed: store the result.
    """
    small_batches(docs.sparkSession)

    def take_apart(batches):
        for batch in batches:
            for at, some in in_slices(batch.column("text")):
                of, terms, tf, n = term_counts(some)
                place = pa.array(of + at)
                lead = np.diff(of, prepend=-1) != 0
                yield pa.RecordBatch.from_arrays([terms, batch.column("row").take(place), batch.column("id").take(place), pa.array(tf.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(lead)], ["term", "row", "id", "tf", "n", "lead"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(take_apart, f"term string, row bigint, id {rows.schema['id'].dataType.simpleString()}, tf bigint, n bigint, lead boolean")
    return found.withColumn("bucket", _bucket(buckets))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def store_postings(found: DataFrame, path: str) -> DataFrame:
    """Writes postings to a new folder, a subfolder for each bucket, and reads them from there."""
    found.write.partitionBy("bucket").parquet(path)
    return found.sparkSession.read.schema(found.schema).parquet(path)


def search(items: DataFrame, found: DataFrame, top: int = 20, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id", buckets: int = 16, broadcast_rows: int = 200_000) -> DataFrame:
    """For each row of items its `top` documents of highest score above 0: item id, rank (from 1), document id, score; all, if fewer.

    found: stored postings, in as many `buckets`. N counts the documents with a term, L all their terms, n one document's, df the documents that hold
    a term, tf its occurrences in the document. A term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))), with m = 75 + (25 n N) div L a document
    scores the sum of w ((10^9 tf) div (1000 tf + 12 m)) over the item's terms, repeats included, in 64-bit integers. Equal scores go by ascending id, null ids
    first. Items without terms, and null texts, have no rows; items that repeat are ranked each for itself. No documents, no rows.
    Different terms and (item, term) rows are broadcast while each is `broadcast_rows` at most; beyond that Spark joins by shuffle.
    """
    words = F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(_TERM), 0)
    items = items.select(F.col(item_col).alias("item"), F.monotonically_increasing_id().alias("ask"), words.alias("terms"))
    items = items.select("item", "ask", F.explode("terms").alias("term"))
    asked = cut(items.groupBy("ask", "item", "term").agg(F.count("*").alias("times")))
    few = F.broadcast if asked.count() <= broadcast_rows else lambda df: df
    terms = cut(asked.select("term").distinct().select("term", F.xxhash64("term").alias("number"), _bucket(buckets).alias("bucket")))
    total = found.agg(F.count_if("lead").alias("docs"), F.coalesce(F.sum("tf"), F.lit(0)).alias("terms")).first()
    weight = F.floor(1000 * F.log(F.lit(2.0 * total.docs + 2) / (2 * F.col("df") + 1))).cast("long")
    df = found.join(few(terms.select("bucket", "term")), ["bucket", "term"]).groupBy("bucket", "term").agg(F.count("*").alias("df"))
    weights = cut(df.join(terms, ["bucket", "term"]).select("bucket", "term", "number", weight.alias("w")).where("w > 0"))
    of_item = few(asked.join(weights, "term").select("number", "term", "ask", "item", "times"))
    m = F.lit(75) + F.expr(f"25 * n * {total.docs}L div {max(1, total.terms)}L")
    score = F.col("w") * F.expr("(1000000000L * tf) div (1000 * tf + 12 * m)")
    scored = found.join(few(weights), ["bucket", "term"]).withColumn("m", m).select("row", "id", "number", "term", score.alias("s"))
    met = scored.repartition("row").join(of_item, ["number", "term"]).where("s > 0")
    sums = met.groupBy("row", "id", "ask", "item").agg(F.sum(F.col("s") * F.col("times")).alias("score"))
    place = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "id", "row")).alias("rank")
    return sums.select("item", place, "id", "score").where(F.col("rank") <= top).select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def ranked(items: DataFrame, docs: DataFrame, top: int = 20, buckets: int = 16) -> DataFrame:
    """search() of items (item_id, text) in docs (doc_id, text): makes the postings, in the shared folder, and asks them."""
    path = f"{shared_folder(docs.sparkSession)}/postings-{uuid.uuid4().hex}"
    return search(items, store_postings(postings(docs, buckets=buckets), path), top, buckets=buckets)
