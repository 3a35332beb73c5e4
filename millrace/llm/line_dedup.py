"""Line dedup with two Bloom filters, one of hashes seen once and one of hashes seen twice.

Pass 1 reads the lines and fills both filters: a hash that the once filter already holds goes into the twice filter. Each
task does so for its own lines; merging two tasks' filters ors both kinds and adds to the twice filter what both once
filters share, so every hash that really repeats is in the merged twice filter. Merging is spread over segments of the bit
array. Pass 2 sends only lines whose hash is in the twice filter across the network, for the exact count of documents and
the choice of the one that keeps the line. Lines that don't repeat, and documents without suspects, never move.

The filters have 16 bits for each line, counted first. Up to 2^30 bits (64 million lines) they are broadcast, 128 MB at most. Beyond that
hashes are dealt into segments by their value, as many as the count asks for, each with two filters of its own in one task: lines'
hashes go there twice, once to fill the filters and once, with the ids of their documents, to be tested, and are streamed,
not held. Then documents with suspects move to meet them, so texts move too; results are the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import cut, in_slices, small_batches, stored

_TRIM = " \t\n\x0b\x0c\r"


def _keys(texts: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each different key of at least `least` code points, and for each a flag: more than one line of these texts has it."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n").flatten()
    keys = pc.ascii_lower(pc.utf8_trim(lines, characters=_TRIM))
    keys = keys.filter(pc.greater_equal(pc.utf8_length(keys), least))
    counted = pc.value_counts(keys)
    keys, counts = counted.field("values"), counted.field("counts").to_numpy(zero_copy_only=False)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys.to_pylist()), np.uint64, len(keys))
    return hashes, counts > 1


def _positions(hashes: np.ndarray, bits: int, probes: int) -> list[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [((hashes + np.uint64(k) * step) % np.uint64(bits)).astype(np.int64) for k in range(probes)]


def _has(bitmap: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    found = np.ones(len(at[0]), bool)
    for p in at:
        found &= (bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return found


def _put(bitmap: np.ndarray, at: list[np.ndarray], chosen: np.ndarray) -> None:
    for p in at:
        np.bitwise_or.at(bitmap, p[chosen] >> 3, np.left_shift(np.uint8(1), (p[chosen] & 7).astype(np.uint8)))


def _pack(bitmap: np.ndarray) -> bytes:
    return pa.compress(bitmap.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size, codec="zstd", asbytes=True), np.uint8)


def twice_filter(docs: DataFrame, text_col: str, least: int, bits: int, probes: int, segments: int = 64) -> bytes:
    """The bit array, of bits / 8 bytes, that holds every key hash that more than one line of docs has."""
    part = bits // 8 // segments

    def fill(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for _, texts in in_slices(batch.column(0)):
                hashes, several = _keys(texts, least)
                at = _positions(hashes, bits, probes)
                _put(twice, at, several | _has(once, at))
                _put(once, at, np.ones(len(hashes), bool))
        rows = [(k, _pack(once[k * part : (k + 1) * part]), _pack(twice[k * part : (k + 1) * part])) for k in range(segments) if once[k * part : (k + 1) * part].any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["segment", "once", "twice"])

    def merge(batches):
        # Rows come sorted by segment: one pair of arrays at a time is held, however many tasks filled filters.
        now, once, twice = None, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([_pack(twice)], pa.binary())], ["segment", "twice"])

        for batch in batches:
            for row in batch.to_pylist():
                a, b = _unpack(row["once"], part), _unpack(row["twice"], part)
                if row["segment"] != now:
                    if now is not None:
                        yield done()
                    now, once, twice = row["segment"], a.copy(), b.copy()
                else:
                    twice |= b | (once & a)
                    once |= a
        if now is not None:
            yield done()

    filled = docs.select(text_col).mapInArrow(fill, "segment int, once binary, twice binary")
    merged = filled.repartition(segments, "segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, twice binary")
    bitmap = bytearray(bits // 8)
    for row in merged.toLocalIterator():  # segments rows, bits / 8 bytes in all
        bitmap[row.segment * part : (row.segment + 1) * part] = _unpack(bytes(row.twice), part).tobytes()
    return bytes(bitmap)


def _tester(docs: DataFrame, bitmap: bytes, least: int, bits: int, probes: int):
    """A function of an Arrow array of texts: of each suspected repeat the place of its text, and its key."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # bits / 8 bytes, whatever the input

    def test(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        held, rows, found = np.frombuffer(shared.value, np.uint8), [pa.array([], pa.int64())], [pa.array([], pa.string())]
        for start, part in in_slices(texts):
            lists = pc.split_pattern(pc.fill_null(part, ""), "\n")
            keys = pc.ascii_lower(pc.utf8_trim(lists.flatten(), characters=_TRIM))
            long = pc.greater_equal(pc.utf8_length(keys), least)
            of, coded = pc.list_parent_indices(lists).filter(long), keys.filter(long).dictionary_encode()
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
            if len(hashes):
                hit = pa.array(_has(held, _positions(hashes, bits, probes))[coded.indices.to_numpy(zero_copy_only=False)])
                rows.append(pc.add(of.filter(hit).cast(pa.int64()), start))
                found.append(coded.filter(hit).dictionary_decode().cast(pa.string()))
        return pa.concat_arrays(rows), pa.concat_arrays(found)

    return test


def filter_bits(docs: DataFrame, text_col: str) -> int:
    """A power of two: 16 bits for each line, but at least 2^20."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.agg(F.sum(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1)).first()[0] or 0
    return 1 << max(20, (16 * lines).bit_length())


def segmented_suspects(docs: DataFrame, least: int, bits: int, probes: int, segment_bits: int) -> DataFrame:
    """docs (id, text) -> (id, key), suspected repeats, by filters of `segment_bits` bits for each of as many segments of hashes as `bits` asks for."""
    segments = max(1, bits // segment_bits)
    kind = docs.schema["id"].dataType
    chunk = T.StructType([T.StructField("segment", T.IntegerType()), T.StructField("hashes", T.BinaryType()), T.StructField("several", T.BinaryType()), T.StructField("ids", T.ArrayType(kind))])

    def hash_lines(batches):
        for batch in batches:
            for start, texts in in_slices(batch.column(1)):
                lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
                keys = pc.ascii_lower(pc.utf8_trim(lists.flatten(), characters=_TRIM))
                long = pc.greater_equal(pc.utf8_length(keys), least)
                of, coded = pc.list_parent_indices(lists).filter(long).to_numpy(zero_copy_only=False), keys.filter(long).dictionary_encode()
                each = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))[coded.indices.to_numpy(zero_copy_only=False)]
                counts = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))[coded.indices.to_numpy(zero_copy_only=False)]
                segment = (each % np.uint64(segments)).astype(np.int64)
                order = np.argsort(segment, kind="stable")
                ends = np.searchsorted(segment[order], np.arange(segments + 1))
                ids = batch.column(0).slice(start, len(texts)).take(pa.array(of[order]))
                used = np.flatnonzero(np.diff(ends))
                spans = [slice(ends[k], ends[k + 1]) for k in used]
                yield pa.RecordBatch.from_arrays([
                    pa.array(used, pa.int32()), pa.array([each[order][x].tobytes() for x in spans], pa.binary()), pa.array([(counts[order][x] > 1).tobytes() for x in spans], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.append(0, ends[used + 1]), pa.int32()), ids),
                ], ["segment", "hashes", "several", "ids"])

    def fill(batches):
        now, once, twice = None, None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([_pack(twice)], pa.binary())], ["segment", "twice"])
        for batch in batches:
            for row in batch.to_pylist():
                if row["segment"] != now:
                    if now is not None:
                        yield done()
                    now, once, twice = row["segment"], np.zeros(segment_bits // 8, np.uint8), np.zeros(segment_bits // 8, np.uint8)
                hashes, first = np.unique(np.frombuffer(row["hashes"], np.uint64), return_index=True)
                at = _positions(hashes // np.uint64(segments), segment_bits, probes)
                _put(twice, at, np.frombuffer(row["several"], bool)[first] | _has(once, at))
                _put(once, at, np.ones(len(hashes), bool))
        if now is not None:
            yield done()

    def test(batches):
        held = None
        for batch in batches:
            for k in range(batch.num_rows):  # of a segment its filter comes first, then its hashes
                if (packed := batch.column("twice")[k].as_py()) is not None:
                    held = _unpack(packed, segment_bits // 8)
                    continue
                hashes = np.frombuffer(batch.column("hashes")[k].as_py(), np.uint64)
                hit = pa.array(_has(held, _positions(hashes // np.uint64(segments), segment_bits, probes)))
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values.filter(hit), pa.array(hashes.view(np.int64)).filter(hit)], ["id", "hash"])

    hashed = stored(docs.select("id", "text").mapInArrow(hash_lines, chunk))
    dealt = lambda df, *order: df.repartition(segments, "segment").sortWithinPartitions("segment", *order)
    filters = stored(dealt(hashed.select("segment", "hashes", "several")).mapInArrow(fill, "segment int, twice binary"))
    asked = hashed.select("segment", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("twice"), "hashes", "ids")
    both = filters.select("segment", F.lit(0).alias("kind"), "twice", F.lit(None).cast("binary").alias("hashes"), F.lit(None).cast(T.ArrayType(kind)).alias("ids")).unionByName(asked)
    suspects = dealt(both, "kind").mapInArrow(test, T.StructType([T.StructField("id", kind), T.StructField("hash", T.LongType())])).distinct()

    @F.arrow_udf("array<string>")
    def of_hashes(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        out = []
        for text, some in zip(texts, wanted, strict=True):
            some, lines = set(some.as_py()), {x.encode().strip(_TRIM.encode()).lower() for x in text.as_py().split("\n")}
            out.append([x.decode() for x in lines if (h := xxhash.xxh3_64_intdigest(x)) - (h >> 63 << 64) in some])
        return pa.array(out, pa.list_(pa.string()))

    by_id = suspects.groupBy("id").agg(F.collect_list("hash").alias("hashes"))  # a document's lines at most
    met = docs.select("id", F.coalesce("text", F.lit("")).alias("text")).join(by_id, "id")
    return met.select("id", F.explode(of_hashes("text", "hashes")).alias("key")).where(F.length("key") >= least)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20, in_docs: int = 3, bits: int | None = None, probes: int = 4, broadcast_bits: int = 1 << 30) -> DataFrame:
    """All columns of docs, the text without repeated lines, with n_lines (before) and n_dropped.

    A line's key is the line without white space at its ends, A-Z lower-cased. A key of at least `least` code points found
    in `in_docs` or more documents loses all its lines but those in the document with the largest id; the other lines stay,
    in order, joined by a newline. Within the document that keeps a key all its lines stay. A null or empty text is one
    empty line, and comes back as an empty text. A null id can't be told apart from other documents, so its lines stay and
    count for no key. Rows that repeat an id count as one document, and all of them keep what that id keeps. Texts are handled
    whole, however long, and an empty table gives no rows. Columns of docs named n_lines or n_dropped are replaced; others pass unchanged.
    """
    names = [f"doc.`{c}`" if c != text_col else f"text as `{c}`" for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return without_lines(docs, id_col, text_col, least, in_docs, bits, probes, broadcast_bits).selectExpr(*names, "n_lines", "n_dropped")


def without_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20, in_docs: int = 3, bits: int | None = None, probes: int = 4, broadcast_bits: int = 1 << 30) -> DataFrame:
    """drop_repeated_lines() with the columns of docs together in one, doc, and the new text, n_lines and n_dropped beside it."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_col, text_col, bits = "id", "text", bits or filter_bits(docs, "text")
    if bits > broadcast_bits:
        found = cut(segmented_suspects(docs.where("id is not null"), least, bits, probes, broadcast_bits >> 1).distinct())
        return _rewritten(docs, found, in_docs, None)
    bitmap = twice_filter(docs, text_col, least, bits, probes)
    test = _tester(docs, bitmap, least, bits, probes)

    def suspects(batches):
        for batch in batches:
            of, keys = test(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), keys], ["id", "key"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("key", T.StringType())])
    # A document and key once each; both aggregations combine before they shuffle, so a common line makes no large group.
    found = cut(docs.where(F.col(id_col).isNotNull()).select(id_col, text_col).mapInArrow(suspects, schema).distinct())
    return _rewritten(docs, found, in_docs, test)


def _rewritten(docs: DataFrame, found: DataFrame, in_docs: int, test) -> DataFrame:
    """docs (doc, id, text) without the lines that found, (id, key) of suspects, turns out to have in `in_docs` documents; test tells documents without suspects, which don't move."""
    confirmed = found.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keep_id")).where(F.col("n") >= in_docs).select("key", "keep_id")
    confirmed = cut(confirmed)  # then the join deals both sides out anew, and Spark can split it at a very common line
    drops = found.join(confirmed, "key").where("id <> keep_id").groupBy(F.col("id").alias("_id")).agg(F.collect_list("key").alias("_drop"))

    @F.arrow_udf("boolean")
    def suspected(texts: pa.Array) -> pa.Array:
        held = np.zeros(len(texts), bool)
        held[test(texts)[0].to_numpy(zero_copy_only=False)] = True
        return pa.array(held)

    @F.arrow_udf("struct<text: string, n_dropped: bigint>")
    def rewrite(texts: pa.Array, drop: pa.Array) -> pa.Array:
        kept, dropped = [], []
        for text, keys in zip(texts, drop, strict=True):
            lines, gone = (text.as_py() or "").split("\n"), {k.encode() for k in keys.as_py() or ()}
            stay = [x for x in lines if x.encode().strip(_TRIM.encode()).lower() not in gone]
            kept.append("\n".join(stay))
            dropped.append(len(lines) - len(stay))
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(dropped, pa.int64())], ["text", "n_dropped"])

    docs = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("n_lines", F.size(F.split("text", "\n", -1)).cast("long"))
    if test is None:
        every = docs.join(drops, F.col("id") == F.col("_id"), "left").withColumn("new", rewrite("text", "_drop"))
        return every.select("doc", F.col("new.text").alias("text"), "n_lines", F.col("new.n_dropped").alias("n_dropped"))
    # Documents without a suspect stay where they are.
    clean = docs.where(~suspected("text")).withColumn("n_dropped", F.lit(0).cast("long"))
    rest = docs.where(suspected("text")).join(drops, F.col("id") == F.col("_id"), "left").withColumn("new", rewrite("text", "_drop"))
    return clean.unionByName(rest.select("doc", "id", F.col("new.text").alias("text"), "n_lines", F.col("new.n_dropped").alias("n_dropped"))).drop("id")
