"""Byte-level BPE against tiktoken on the same rank file, exact round trips, and offsets."""

import base64
import hashlib
import random
import struct

import pyarrow as pa
import pytest
import tiktoken

from millrace.llm import byte_bpe, queries


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(3)
    texts = [None, "", " ", "  \n\t ", "it's I'll they'd 'S", "<|endoftext|> x", "é" * 50, "日本語の文、です。" * 9, "\U0001f468‍\U0001f469 ́é", "a b　c\u0085d", "\x00\x1c\x1d\x7f", " " * 40 + "x", "aaaaaaaaaaaaaaaaaaaaaaaa", "1234567890 ١٢٣ Ⅻ"]
    for letters in ("a ", "ab", " \n\t", "()-=", "ha ", "é́ ", "'strevm d", "0 1a", "\U0001f600a "):
        texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    return texts


def test_query_as_tiktoken(spark, sf, tik):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_byte_bpe(spark, sf).collect()}
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = tik.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert got == want


def test_odd_texts_clashing_columns_and_round_trip(spark, tik):
    texts = odd_texts()
    docs = spark.createDataFrame([(k, t, "old", -1) for k, t in enumerate(texts)], "doc_id long, text string, ids string, n_ids int")
    for offsets in (False, True):
        coded = byte_bpe.encode_documents(docs, queries.RANKS, offsets=offsets)
        rows = {r.doc_id: r for r in byte_bpe.decode_documents(coded, queries.RANKS).collect()}
        for k, t in enumerate(texts):
            assert rows[k].ids == tik.encode_ordinary(t or "") and rows[k].n_ids == len(rows[k].ids)
            assert bytes(rows[k].decoded).decode() == (t or "") and rows[k].text == t
            if offsets:  # an id's first byte lies in the character that its offset names
                upto = 0
                for i, start in zip(rows[k].ids, rows[k].starts, strict=True):
                    assert len(t[:start].encode()) <= upto < len(t[: start + 1].encode())
                    upto += len(tik.decode_single_token_bytes(i))
    empty = byte_bpe.decode_documents(byte_bpe.encode_documents(docs.limit(0), queries.RANKS), queries.RANKS)
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "ids", "n_ids", "decoded"]


def test_long_texts_are_cut_where_no_match_is(spark, tik):
    rng = random.Random(4)
    long = ["".join(rng.choice(("word ", "x", "  ", "\n", "12", "é", "'s", "、", "!?", "  ", "ab,", "\x1c")) for _ in range(4000)) for _ in range(6)]
    for t in long:
        parts = byte_bpe.parts_of(t, 50)
        assert "".join(parts) == t and len(parts) > 50
        assert [i for p in parts for i in tik.encode_ordinary(p)] == tik.encode_ordinary(t)
    assert byte_bpe.parts_of("a" * 500, 50) == ["a" * 500]  # no such place
    big = "ten words of some text that repeat, and again. " * 20_000
    docs = spark.createDataFrame([(1, big)], "doc_id long, text string")
    row = byte_bpe.encode_documents(docs, queries.RANKS, offsets=True).first()
    assert row.ids == tik.encode_ordinary(big) and row.starts[-1] >= len(big) - 2


@pytest.mark.parametrize("part", [10, 1 << 18])
def test_stretches_side_by_side(tik, part, monkeypatch):
    monkeypatch.setattr(byte_bpe, "_PART", part)
    rng = random.Random(6)
    pieces = ("word", "x", " ", "  ", "\n", "\n\n", "12", "\u00e9", "'s", "\u3001", "!?", "\u00a0", "\u3000", "\u2003", "\u1680", "\u0085", "\u2028", "ab,", "\x1c", "\t", "\r", "\u2026", "\u00c0", "\U0001f642")
    ranks = byte_bpe.read_ranks(queries.RANKS)
    encoder = byte_bpe.Encoder(byte_bpe.describe(ranks), byte_bpe._lengths(ranks))
    for _ in range(6):
        texts = [None, "", *("".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(200)), *odd_texts()]
        ids, sizes = encoder.encode(pa.array(texts, pa.string()))
        want = [tik.encode_ordinary(t or "") for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        cut, of = byte_bpe.stretches(pa.array(texts, pa.string()).slice(3))
        assert of.sum() == len(cut) and "".join(cut.to_pylist()) == "".join(t or "" for t in texts[3:])


def test_split_characters(spark, tik):
    text = "ok 🙂🙃 日 \U0001f9ff"
    ids = tik.encode_ordinary(text)
    docs = spark.createDataFrame([(1, ids), (2, ids[:-1]), (3, []), (4, None), (5, [10**6, -1, ids[0]])], "doc_id long, ids array<int>")
    rows = {r.doc_id: r for r in byte_bpe.decode_pieces(byte_bpe.decode_documents(docs, queries.RANKS), queries.RANKS).collect()}
    assert "".join(rows[1].pieces) == text and len(rows[1].pieces) == len(ids) and "" in rows[1].pieces  # some character is split
    assert bytes(rows[2].decoded) == b"".join(tik.decode_single_token_bytes(i) for i in ids[:-1]) and rows[2].pieces[-1].endswith("�")
    assert bytes(rows[3].decoded) == bytes(rows[4].decoded) == b"" and rows[3].pieces == rows[4].pieces == []
    assert bytes(rows[5].decoded) == tik.decode_single_token_bytes(ids[0])


def test_packed_ids(spark):
    df = spark.createDataFrame([([1, 50255],), ([],), (None,)], "ids array<int>")
    assert [bytes(r[0]) for r in df.select(byte_bpe.packed_ids(df["ids"])).collect()] == [struct.pack("<2I", 1, 50255), b"", b""]


def test_closed_stretches_by_their_bytes():
    ends = [chr(c) for c in [*range(0x3100), 0xFEFF, 0xFFFD, 0x1F642, 0x12085]]
    texts = [first + rest for first in (" ", "\n", "\t", "　", "a", "é") for rest in ("", "x", *ends)]
    got = byte_bpe._closed(pa.array(["skipped", *texts], pa.large_string()).slice(1))
    assert got.tolist() == [t[0] in " \n" and not t[-1].isspace() for t in texts]
    assert byte_bpe._closed(pa.array([], pa.large_string())).tolist() == []
