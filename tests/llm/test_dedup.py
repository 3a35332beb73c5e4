"""Exact dedup, line dedup and SimHash against plain definitions."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import queries
from millrace.llm import simhash as simhash_module
from millrace.llm.components import components
from millrace.llm.exact_dedup import exact_groups
from millrace.llm.line_dedup import drop_repeated_lines
from millrace.llm.shared import cut
from millrace.llm.simhash import links, near_duplicates, near_groups, simhash, trie_forest

SCHEMA = "doc_id long, text string, kept string, key string, n_lines string, id string, fp string, _id string, _drop string, new string, to string"


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "x", "y", "z", "i", "f", "a", "b", "c", "d") for d, t in rows], SCHEMA)


LONG = "word " * 60_000
ROWS = [(1, "a"), (2, "a"), (3, ""), (4, None), (5, "b"), (5, "b"), (6, LONG), (7, LONG), (None, "a"), (8, "A"), (9, "a ")]


def test_exact(spark):
    got = exact_groups(frame(spark, ROWS)).collect()
    want = []
    for d, t in ROWS:
        same = [x for x, y in ROWS if (y or "") == (t or "")]
        keep = max(x for x in same if x is not None)
        want.append((d, keep, len(same), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_exact_normalised_and_empty(spark):
    assert {r.doc_id: r.keep_id for r in exact_groups(frame(spark, [(1, "a "), (2, "A")]), normalise=lambda t: F.lower(F.trim(t))).collect()} == {1: 2, 2: 2}
    assert exact_groups(frame(spark, [])).count() == 0


def test_exact_hot_group_is_salted(spark):
    rows = [(k, "same") for k in range(400)] + [(1000 + k, f"t{k}") for k in range(200)]
    got = {r.doc_id: r for r in exact_groups(frame(spark, rows).repartition(8)).collect()}
    assert all(got[k].keep_id == 399 and got[k].group_size == 400 for k in range(400)) and sum(r.kept for r in got.values()) == 201


def plain_lines(rows, least=20, in_docs=3):
    space = "[\x20\x09-\x0d]"
    key = lambda x: re.sub(f"^{space}+|{space}+$", "", x).translate({i: i + 32 for i in range(65, 91)})
    holders = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= least:
                holders.setdefault(key(x), set()).add(d)
    gone = lambda d, x: d is not None and len(h := holders.get(key(x), ())) >= in_docs and max(h) != d
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not gone(d, x)]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(map(repr, out))


@pytest.mark.parametrize(("bits", "broadcast"), [(None, 1 << 30), (1 << 12, 1 << 30), (None, 1 << 18), (1 << 14, 1 << 13), (1 << 12, 1 << 9)])  # the last three by segments, the last with full filters
def test_lines(spark, bits, broadcast):
    random.seed(2)
    pool = [f"a line that is long enough number {k}" for k in range(60)] + ["short", "", " \t A Line that is LONG enough number 1 \r", "ü" * 20, "ü" * 19, "x" * 50_000]
    rows = [(k, "\n".join(random.choice(pool) for _ in range(random.randint(0, 9)))) for k in range(80)] + [(7, pool[0] + "\n" + pool[0]), (None, pool[1]), (90, None), (91, ""), (92, "\n\n")]
    got = drop_repeated_lines(frame(spark, rows), bits=bits, broadcast_bits=broadcast)
    assert got.columns == ["doc_id", "text", "kept", "key", "id", "fp", "_id", "_drop", "new", "to", "n_lines", "n_dropped"]
    assert sorted(repr((r.doc_id, r.text, r.n_lines, r.n_dropped)) for r in got.collect()) == plain_lines(rows)


def test_lines_of_empty_table(spark):
    assert drop_repeated_lines(frame(spark, [])).count() == 0


def plain_fingerprint(text, width):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    shingles = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for t in ["", None, "One", "one two", "One two three", "a b c d e f g é Ü\x0b\x0c x\u00a0y", "r " * 500]:
        assert simhash(t) == plain_fingerprint(t, 3) and simhash(t, 5) == plain_fingerprint(t, 5)


def plain_groups(prints, budget):
    """Smallest member of each component, by repeated relabelling."""
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= budget
    label = np.arange(len(prints))
    while not np.array_equal(new := np.where(near, label[None, :], len(label)).min(1), label):
        label = new
    return label


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_trie(budget):
    rng = np.random.default_rng(budget)
    for n in (1, 2, 30, 400):
        base = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
        near = base ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        prints = np.unique(np.concatenate([base, near, near ^ np.uint64(1), np.uint64(1) << np.arange(64, dtype=np.uint64)]))
        u, v = trie_forest(prints, budget)
        got = np.arange(len(prints))
        got[np.searchsorted(prints, u)] = np.searchsorted(prints, v)
        assert np.array_equal(got, plain_groups(prints, budget))


@pytest.mark.parametrize("leaf", [4096, 8])
def test_links_by_levels(spark, leaf):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    hot = np.uint64(0xF0F0) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64))
    prints = np.unique(np.concatenate([base, base ^ np.uint64(3 << 62), base ^ np.uint64(7), hot]))
    tree = components(links(spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long"), 2, leaf)).collect()
    got = {int(x): int(x) for x in prints.view(np.int64)} | {r.u: r.v for r in tree}
    want = plain_groups(prints, 2)
    pairs = {(got[int(x)], int(w)) for x, w in zip(prints.view(np.int64), want, strict=True)}
    assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    assert {r.u: r.v for r in components(edges).collect()} == {k: 0 for k in range(1, 41)} | {101: 100}


def test_groups(spark):
    rows = [*ROWS, (20, "one two three four five six"), (21, "One two three four five six"), (22, "!!! ?"), (23, " \n")]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in near_groups(frame(spark, rows)).collect()), key=repr)
    prints = np.array([plain_fingerprint(t, 3) for _, t in rows], np.uint64)
    label, want = plain_groups(prints, 2), []
    for k, (d, _) in enumerate(rows):
        want.append((d, f"{prints[k]:016x}", min(x for x, m in zip((r[0] for r in rows), label == label[k], strict=True) if m and x is not None)))
    assert got == sorted(want, key=repr)
    assert near_groups(frame(spark, [])).count() == 0


def test_near_duplicates_are_verified(spark):
    base = " ".join(f"w{k * 7919 % 1000}" for k in range(300))
    rows = [(5, base), (3, base), (9, base + " more"), (1, "quite another text of some ten words for the test"), (2, None), (4, ""), (None, base)]
    got = {r.doc_id: (r.keep_id, r.kept) for r in near_duplicates(frame(spark, rows)).collect()}
    assert got[1] == (1, True) and got[None][1]
    stays = got[3][0]  # of Jaccard 0.997, however many bits apart, one stays
    assert stays in (3, 9) and {k: got[k] for k in (3, 5, 9)} == {k: (stays, k == stays) for k in (3, 5, 9)}
    assert got[2] == (2, True) and got[4] == (2, False)
    assert near_duplicates(frame(spark, [])).count() == 0


def shingle_sets(rows, width=5):
    words = {d: t.lower().split() for d, t in rows}
    return {d: {" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} for d, w in words.items()}


def holds(rows, got, similarity=0.8):
    """By all pairs: no two that stay are alike, and whatever goes is alike the one that stands for it."""
    sets = shingle_sets(rows)
    alike = lambda a, b: len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])
    stay = sorted(d for d, to in got.items() if d == to)
    assert set(got) == set(sets)
    assert not [(a, b) for k, a in enumerate(stay) for b in stay[k + 1 :] if min(len(sets[a]), len(sets[b])) >= similarity * max(len(sets[a]), len(sets[b])) and alike(a, b)]
    assert all(got[to] == to and alike(d, to) for d, to in got.items())


def test_near_duplicates_find_every_similar_pair(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rng = random.Random(5)
    for k, (_, t) in enumerate(rows[:60]):
        for c in range(3):  # edits that move the fingerprint by more bits than the budget
            w = t.split()
            for _ in range(1 + len(w) // 60):
                w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
            rows.append((10_000 + 10 * k + c, " ".join(w)))
    holds(rows, {r.doc_id: r.keep_id for r in near_duplicates(frame(spark, rows)).collect()})


def repeats(rng, n, times):
    """Pairs of n words and a phrase, often in the one and twice in the other, with a word changed: alike, though fingerprints count repeats."""
    w = [f"u{rng.randrange(10**6)}" for _ in range(n)]
    v = [*w[: n // 2], "changed", *w[n // 2 + 1 :]]
    return " ".join(w + ["buy", "this", "now"] * times), " ".join(v + ["buy", "this", "now"] * 2)


def test_a_repeated_phrase_hides_no_pair(spark):
    rng = random.Random(9)
    pairs = [repeats(rng, n, times) for n, times in ((800, 400), (300, 200), (120, 90), (90, 60), (60, 300), (2000, 900))]
    rows = [(10 * k + c, t) for k, pair in enumerate(pairs) for c, t in enumerate(pair)]
    assert max((simhash(a) ^ simhash(b)).bit_count() for a, b in pairs) > 24
    got = {r.doc_id: r.keep_id for r in near_duplicates(frame(spark, rows)).collect()}
    assert all(got[d] == got[d + 1] in (d, d + 1) for d in got if d % 10 == 0)


def chain():
    """Each alike the next, 2 and 3 alike each other, but the last not alike the first; and texts that share a passage only."""
    w = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(w[25 * k : 25 * k + 200])) for k in range(5)]
    return rows + [(50 + k, " ".join(w[300:400] + [f"own{k}-{j}" for j in range(20)])) for k in range(12)]


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_near_duplicates_of_a_chain(spark, rounds):
    got = {r.doc_id: r.keep_id for r in near_duplicates(frame(spark, chain()), budget=20, similarity=0.7, rounds=rounds).collect()}
    holds(chain(), got, 0.7)
    assert len({got[k] for k in range(5)}) > 1  # all five are one component, but not all alike


def test_versions_that_follow_each_other(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(6 * k, 6 * k + 150))) for k in range(300)]  # each alike the next two or so
    got = {r.doc_id: r.keep_id for r in near_duplicates(frame(spark, rows)).collect()}
    holds(rows, got)


def test_settling_a_long_path_takes_few_rounds(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(simhash_module, "cut", lambda df: calls.append(1) or cut(df))
    links = spark.createDataFrame([(k + 1, k) for k in range(1000)] + [(5000, 2000 + k) for k in range(50)], "id long, to long")
    gone = {r.id: r.to for r in simhash_module._settled(links).collect()}
    near = lambda a, b: abs(a - b) == 1 if max(a, b) <= 1000 else 5000 in (a, b)
    nodes = [*range(1001), 5000, *range(2000, 2050)]
    assert all(near(d, to) and to not in gone for d, to in gone.items())
    assert not [k for k in range(1000) if k not in gone and k + 1 not in gone] and 5000 not in gone and all(2000 + k in gone for k in range(50))
    assert len(nodes) > len(gone) and len(calls) <= 1 + 3 * 12


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_with_sql(name, spark, sf, duck):
    from compare import same_rows

    same_rows(queries.QUERIES[name](spark, sf), duck, queries.ORACLES[name])
