"""Sort-means against plain k-means in Python's integers, and odd rows."""

import hashlib
import math
import random
import struct

import numpy as np

from millrace.llm import queries
from millrace.llm.sort_means import gaps_of, nearest, sort_means
from compare import same_rows


def plain(rows, k, rounds, seed, dims, scale=1024):
    """rows of (id, vector) -> sorted rows of the result."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), struct.pack(f"<{dims}i", *v), v) for i, v in kept)
    centres = [v for *_, v in named[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v: min((apart(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        at = [best(v)[1] for _, v in kept]
        groups = [[v for (_, v), a in zip(kept, at, strict=True) if a == n] for n in range(len(centres))]
        centres = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centres, strict=True)]
    found = [(i, *best(v)) for i, v in kept]
    inertia = lambda n=None: sum(d for _, d, c in found if n is None or c == n)
    sha = lambda c: hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()
    return sorted(((i, c, d, inertia(c), inertia(), sha(c)) for i, d, c in found), key=str)


def test_query_equals_sql(spark, sf, duck):
    same_rows(queries.QUERIES["op11_sort_means"](spark, sf), duck, queries.ORACLES["op11_sort_means"])


def test_brute_force_with_ties_and_odd_rows(spark):
    rng = random.Random(5)
    rows = [(n, [rng.randrange(-3, 4) / 1024 for _ in range(3)]) for n in range(120)]  # many equal and equally near vectors
    rows += [(n, [rng.gauss(0, 1) for _ in range(3)]) for n in range(120, 200)]
    rows += [(7, [0.5, 0.5, 0.5]), (7, [0.5, 0.5, 0.5]), (None, [0.25, -0.25, 0.0]), (None, None), (300, [1.0, 2.0]), (301, [1.0, 2.0, 3.0, 4.0]), (302, [1.0, None, 2.0]), (303, [1.0, float("nan"), 0.0]), (304, [float("inf"), 0.0, 0.0]), (305, [])]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<float>, cluster string, inertia int")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for k, rounds in ((5, 4), (1, 2), (300, 3)):  # 300: more than there are vectors
        got = sort_means(df, k=k, rounds=rounds, dims=3)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == plain(rows, k, rounds, 3, 3)


def test_huge_components_are_held(spark):
    df = spark.createDataFrame([(1, [1e30, -1e30]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in sort_means(df, k=1, rounds=1, dims=2).collect()}
    assert got[1].distance > 0 and got[1].inertia == got[1].distance + got[2].distance


def test_empty(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0]), (2, None)]):
        got = sort_means(spark.createDataFrame(rows, schema))
        assert got.count() == 0 and got.columns[0] == "vec_id"


def test_scan_stops_only_strictly_beyond_twice_the_distance():
    # The vector lies midway: centroid 0 is exactly twice as far from centroid 1 as the vector, and wins the tie.
    centres = np.array([[0, 0], [4, 0], [100, 0]])
    to, d = nearest(np.array([[2, 0]]), np.array([1]), centres, *gaps_of(centres))
    assert to.tolist() == [0] and d.tolist() == [4]
    x = np.random.default_rng(1).integers(-9, 9, (400, 4))
    centres = x[:40]
    to, d = nearest(x, np.zeros(400, np.int64), centres, *gaps_of(centres))
    every = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert to.tolist() == every.argmin(1).tolist() and d.tolist() == every.min(1).tolist()
