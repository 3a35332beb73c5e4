"""Names in texts by an automaton, against looking for each name in each text."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import automaton as M
from millrace.operators import entities as E


@pytest.mark.parametrize("most", [1000, 7])
def test_best_pattern(spark, most):
    rng = random.Random(3)
    letters = "abcé日\U0001f642 "
    patterns = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(60)} | {"", "zz"})
    order = {p: rng.randint(0, 9) for p in patterns}
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(200)] + [None, "", "zz", "abc" * 20_000]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "id int, t string, _p string")
    names = spark.createDataFrame([(p, o) for p, o in order.items()], "p string, o int")
    got = {r.id: r.found for r in M.best_pattern(df, F.col("t"), names, "p", "o", "found", most=most, block=300).collect()}
    assert got == {k: min(((order[p], p) for p in patterns if p and t and p in t), default=(0, None))[1] for k, t in enumerate(texts)}
    assert {r.found for r in M.best_pattern(df, F.col("t"), names.limit(0), "p", "o", "found").collect()} == {None}
    assert M.best_pattern(df.limit(0), F.col("t"), names, "p", "o", "found", most=most).count() == 0


@pytest.mark.parametrize("most", [1000, 2])
def test_longest_match_over_shards(spark, most):
    names = [("Ab", ["Ab", "x"], 1), ("Small Ring", ["Small Ring", "Ring"], None), ("Small Rings", ["Small Rings"], 3), ("Small Pins", ["Ring"], 4), ("Ab", ["y"], None)]
    texts = ["an xAby", "the Small Ringside", "Small Rings", "", None, "x", "Rin", "y", "a Ring"]
    questions = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "q int, t string")
    table = spark.createDataFrame(names, "name string, v array<string>, fee int")
    got = [(r.q, r.matched, r.fee) for r in E.longest_match(questions, "q", "t", table, "name", "v", ["fee"], most=most).orderBy("q").collect()]
    assert got == [(0, "Ab", None), (1, "Small Rings", 3), (2, "Small Rings", 3), (3, None, None), (4, None, None), (5, "Ab", 1), (6, None, None), (7, "Ab", None), (8, "Small Pins", 4)]


def test_expansion_comes_first(spark):
    fees = spark.createDataFrame([("Programme of Computer Science", 1, ["New Computing"]), ("Environment field Management", 2, None), ("Small Art", 3, None)], "name string, fee int, others array<string>")
    asked = spark.createDataFrame([(0, "fee of comsci?"), (1, "Programme of Environment Science (2560)"), (2, "what does new computing or New Computing cost"), (3, "ART"), (4, "SmallArt"), (5, "the Art course")], "q int, t string")
    aliases = [("comsci", "Computer Science"), ("science", "Environment Management")]
    find = lambda expand: {r.q: r.fee for r in E.find_programme(asked, "q", "t", fees, "name", ["fee"], aliases, ["Programme of ", "field"], ["Programme of "], ["Small"], expand, "others").collect()}
    assert find(True) == {0: 1, 1: 2, 2: 1, 3: None, 4: 3, 5: None}
    assert find(False) == {0: None, 1: None, 2: 1, 3: None, 4: 3, 5: None}
