"""Byte-level BPE encoding and decoding: the tokenizers library over Arrow batches.

A rank file (a line for each token: its bytes in base64, its rank) gives the vocabulary. The library works on characters, so
every byte is written as one printable character; a token's merges are all pairs of tokens that make it up, by its rank, so
that it merges the pair of least rank wherever it stands, as encoders of rank files do. Each task makes its encoder
once, from a description that the driver makes. Decoding turns ids back through the table of bytes: characters whose bytes
lie in several ids come back whole, because bytes are joined before they are read as UTF-8.
"""

from __future__ import annotations

import base64
import codecs
import os
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import in_slices, small_batches

#: Fixed value: the pattern that splits texts before the merges of the public byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where PATTERN never has a match across: between a character that isn't white space and a space or line end, or a letter or digit and a mark (but ').
_CUT = re.compile(r"\S[ \n]|[^\W_][!-&(-/:-@、。！，：；？]")
#: Code points that the library gets at once, about.
_PART = 1 << 18


def byte_letters() -> list[str]:
    """The character of each byte: Latin-1's visible characters are their own; the other bytes, in order, take those from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def describe(ranks: dict[bytes, int], pattern: str = PATTERN) -> str:
    """The encoder of a rank file, as the library's JSON."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    letters = byte_letters()
    shown = {token: "".join(letters[b] for b in token) for token in ranks}
    pairs = [(rank, ranks[a], ranks[b], shown[a], shown[b]) for token, rank in ranks.items() for k in range(1, len(token)) if (a := token[:k]) in ranks and (b := token[k:]) in ranks]
    model = models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=[(a, b) for *_, a, b in sorted(pairs)], ignore_merges=True)
    made = Tokenizer(model)
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made.to_str()


def parts_of(text: str, size: int = _PART) -> list[str]:
    """The text in parts of about `size` code points, cut where PATTERN has no match across; a stretch without such a place stays whole."""
    parts, at = [], 0
    while len(text) - at > size and (place := _CUT.search(text, at + size - 1)):
        parts.append(text[at : (at := place.start() + 1)])
    return [*parts, text[at:]]


def stretches(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All texts cut before each space or line end that follows no white space, where PATTERN has no match across; and how many stretches each text has.

    After a character whose last bytes could be those of white space beyond ASCII no cut is made.
    """
    data = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    code, ends = np.frombuffer(data.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]
    cut = np.zeros(len(code) + 1, bool)
    cut[1:-1] = ((code[1:] == 32) | (code[1:] == 10)) & (code[:-1] > 32)
    cut[2:-1] &= (code[1:-1] < 0x80) | ~np.isin(code[:-2], (0x80, 0x81, 0x9A, 0xC2))
    cut[ends] = True
    cut[-1] = False
    begins = np.flatnonzero(cut)
    of = np.bincount(np.searchsorted(ends, begins, "right") - 1, minlength=len(texts))
    return pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(np.append(begins, len(code))), pa.py_buffer(np.ascontiguousarray(code))]), of


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts (large_string), one after another, and where each begins (with the end of the last)."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _closed(texts: pa.Array) -> np.ndarray:
    """Which of some texts, none of them empty, begin with a space or line end and end in no white space."""
    code, ends = _flat(texts)
    first, last = code[ends[:-1]], ends[1:] - 1
    a, b, c = (np.where(last - k >= ends[:-1], code[np.maximum(last - k, 0)], 0) for k in range(3))  # the last byte, and those before it
    white = ((a >= 9) & (a <= 13)) | ((a >= 28) & (a <= 32)) | ((b == 0xC2) & ((a == 0x85) | (a == 0xA0))) | ((c == 0xE1) & (b == 0x9A) & (a == 0x80))
    white |= (c == 0xE2) & (((b == 0x80) & ((a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF))) | ((b == 0x81) & (a == 0x9F)))
    white |= (c == 0xE3) & (b == 0x80) & (a == 0x80)
    return ((first == 32) | (first == 10)) & ~white


def _ranges(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] of each range, one after another."""
    return values[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]


class Encoder:
    """The library's encoder, which sees each different stretch of the texts that it gets together once, many of them side by side in one string."""

    def __init__(self, described: str, lengths: np.ndarray):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library, self.lengths = Tokenizer.from_str(described), lengths

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.int32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]  # fast: without offsets

    def _side_by_side(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, and how many each has. The texts, each begun by a space or line end and ended by neither, are cut apart again by the bytes of the ids."""
        code, ends = _flat(texts)
        parts, first = [np.zeros(0, np.int32)], 0
        while first < len(texts):  # about _PART bytes at a time
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + _PART, "right")) - 1)
            for part in parts_of(code[ends[first] : ends[last]].tobytes().decode()):
                parts += self._ids([part])
            first = last
        ids = np.concatenate(parts)
        upto = np.searchsorted(np.cumsum(self.lengths[ids]), ends[1:], "right") if len(ids) else np.zeros(len(texts), np.int64)
        return ids, np.diff(upto, prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (some megabytes together) one after another, and how many each text has."""
        cut, of = stretches(texts)
        coded = cut.dictionary_encode()
        different = coded.dictionary
        fits = _closed(different)
        ids, sizes = self._side_by_side(different.filter(pa.array(fits)))
        alone = [self._ids(parts_of(text)) for text in different.filter(pa.array(~fits)).to_pylist()]
        values = np.concatenate([ids, *(part for parts in alone for part in parts)])
        every = np.zeros(len(different), np.int64)
        every[fits], every[~fits] = sizes, [sum(map(len, parts)) for parts in alone]
        starts = np.empty(len(different), np.int64)
        starts[fits] = np.cumsum(sizes) - sizes
        starts[~fits] = len(ids) + np.cumsum(every[~fits]) - every[~fits]
        each = coded.indices.to_numpy(zero_copy_only=False)
        upto = np.append(0, np.cumsum(every[each]))
        return _ranges(values, starts[each], every[each]), np.diff(upto[np.append(0, np.cumsum(of))])

    def with_offsets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, how many each text has, and the code point at which each id's first character begins; texts are encoded whole, part by part."""
        ids, starts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            base = 0
            for part in parts_of(text or ""):
                done = self.library.encode(part, add_special_tokens=False)
                ids.append(np.array(done.ids, np.int32))
                starts.append(np.array(done.offsets, np.int32).reshape(-1, 2)[:, 0] + base)
                sizes[k] += len(ids[-1])
                base += len(part)
        return np.concatenate(ids), sizes, np.concatenate(starts)


#: The encoder of this Python worker, with what it is for: tasks that follow each other share it.
_WORKER: list[tuple[str, Encoder]] = []


def _encoder(key: str, shared) -> Encoder:
    if not _WORKER or _WORKER[0][0] != key:
        _WORKER[:] = [(key, Encoder(*shared.value))]
    return _WORKER[0][1]


def _lengths(ranks: dict[bytes, int]) -> np.ndarray:
    """The number of bytes of each id."""
    return np.array([len(token) for token in _table(ranks)], np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values, pa.int32()))


def encode_documents(docs: DataFrame, ranks_path: str, text_col: str = "text", pattern: str = PATTERN, offsets: bool = False) -> DataFrame:
    """All columns of docs, with ids (array of int), n_ids, and with `offsets` starts (array of int: the code point at which each id's first character begins).

    Columns of these names are replaced. Each match of `pattern` is encoded separately, without special tokens: their names are
    ordinary text. (The parts of long texts are cut where PATTERN has no match across; another pattern must have none there either.) Null and
    empty texts have no ids. Repeated rows are encoded alike. An empty table stays empty. Texts longer than some 260,000 code points are encoded part by
    part; their ids are one array.
    """
    small_batches(docs.sparkSession)
    ranks = read_ranks(ranks_path)
    shared, key = docs.sparkSession.sparkContext.broadcast((describe(ranks, pattern), _lengths(ranks))), uuid.uuid4().hex  # a few times the rank file

    def in_parts(texts: pa.Array, run) -> list[np.ndarray]:
        out = [run(some) for _, some in in_slices(texts, 4 << 20)] or [run(texts)]
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    if offsets:

        @F.arrow_udf("struct<ids: array<int>, starts: array<int>>")
        def found(texts: pa.Array) -> pa.Array:
            encoder = _encoder(key, shared)
            ids, sizes, starts = in_parts(texts, lambda some: encoder.with_offsets(some.to_pylist()))
            return pa.StructArray.from_arrays([_lists(ids, sizes), _lists(starts, sizes)], ["ids", "starts"])

        rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "starts", "n_ids")]
        coded = docs.select(*rest, found.asNondeterministic()(F.col(f"`{text_col}`")).alias("found of texts"))
        return coded.select(*rest, "found of texts.ids", "found of texts.starts", F.size("found of texts.ids").cast("long").alias("n_ids"))

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        encoder = _encoder(key, shared)
        return _lists(*in_parts(texts, encoder.encode))

    # Said to be non-deterministic, so that Spark doesn't encode again for each later use of the ids.
    return docs.withColumn("ids", ids_of.asNondeterministic()(F.col(f"`{text_col}`"))).withColumn("n_ids", F.size("ids").cast("long"))


def _joined(ids: pa.Array, table: pa.Array) -> pa.Array:
    """The bytes of lists of ids; ids that aren't in the table have none."""
    lists = pc.if_else(pc.is_valid(ids), ids, pa.scalar([], ids.type))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    pieces = table.take(pa.array(np.where((flat >= 0) & (flat < len(table) - 1), flat, len(table) - 1)))
    ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    offsets = np.frombuffer(pieces.buffers()[1], np.int64)[: len(pieces) + 1]  # the pieces lie one after another: a text is a range of them
    return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(np.ascontiguousarray(offsets[ends])), pieces.buffers()[2]])


def _table(ranks: dict[bytes, int]) -> list[bytes]:
    """The bytes of each id, and none after the last."""
    by_id = {rank: token for token, rank in ranks.items()}
    return [by_id.get(k, b"") for k in range(max(by_id, default=-1) + 2)]


def _some_at_a_time(ids: pa.Array):
    """(lists of about 260,000 ids together, or one text's), so that working copies stay small."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ids):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 18), "right")))
        yield ids.slice(at, end - at)
        at = end


def decode_documents(encoded: DataFrame, ranks_path: str, to_col: str = "decoded", ids_col: str = "ids") -> DataFrame:
    """All columns, with the bytes of ids in `to_col` (binary): the encoded text in UTF-8. Null or no ids give no bytes, ids of no token none either. An empty table stays empty."""
    shared = encoded.sparkSession.sparkContext.broadcast(_table(read_ranks(ranks_path)))

    @F.arrow_udf("binary")
    def bytes_of(ids: pa.Array) -> pa.Array:
        table = pa.array(shared.value, pa.large_binary())
        return pa.concat_arrays([pa.array([], pa.binary()), *(_joined(some, table).cast(pa.binary()) for some in _some_at_a_time(ids))])

    return encoded.withColumn(to_col, bytes_of(F.col(f"`{ids_col}`")))


def decode_pieces(encoded: DataFrame, ranks_path: str, to_col: str = "pieces", ids_col: str = "ids") -> DataFrame:
    """All columns, with the text of each id in `to_col` (array of string): a character whose bytes lie in several ids belongs to the last of them, and bytes that are no UTF-8, or an unfinished character at the end, are U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(_table(read_ranks(ranks_path)))

    @F.arrow_udf("array<string>")
    def pieces_of(ids: pa.Array) -> pa.Array:
        out, table = [], shared.value
        for some in ids.to_pylist():
            reader, pieces = codecs.getincrementaldecoder("utf-8")("replace"), []
            for k, i in enumerate(some or [], 1):
                pieces.append(reader.decode(table[i] if i is not None and 0 <= i < len(table) else b"", final=k == len(some)))
            out.append(pieces)
        return pa.array(out, pa.list_(pa.string()))

    return encoded.withColumn(to_col, pieces_of(F.col(f"`{ids_col}`")))


def packed_ids(ids: Column) -> Column:
    """Ids as binary, each in 32 bits, little-endian: what token shards hold. Null gives no bytes."""

    @F.arrow_udf("binary")
    def of(lists: pa.Array) -> pa.Array:
        out = [pa.array([], pa.binary())]
        for some in _some_at_a_time(lists):
            flat = some.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(some), 0).to_numpy(zero_copy_only=False), dtype=np.int64))
            out.append(pa.Array.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(ends * 4), pa.py_buffer(flat)]).cast(pa.binary()))
        return pa.concat_arrays(out)

    return of(ids)
