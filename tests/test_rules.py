import math
import random

from pyspark.sql import functions as F

from millrace.functions import assembly as A
from millrace.operators import conversations as C
from millrace.operators import entities as E
from millrace.operators import gates as G
from millrace.operators import vectors as V


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_percent_and_confidence(spark):
    got = values(spark, [(0.35,), (0.72,), (0.1,), (0.9,), (0.535,)], "s double", V.percent(F.col("s")))
    assert [x for (x,) in got] == [0, 100, 0, 100, 50]
    rows = spark.createDataFrame([("a", 1, 90), ("a", 2, 85), ("a", 3, 80), ("b", 1, 90), ("b", 3, 81), ("b", 2, 85), ("c", 1, 90), ("c", 2, 10)], "k string, rank int, percent int")
    assert {r.k: r.confidence for r in V.confidence(rows, ["k"]).collect()} == {"a": "high", "b": "low", "c": "low"}


def test_margin_includes_its_end(spark):
    rows = spark.createDataFrame([(1, 0.75, 0), (2, 0.5, 0), (3, 0.25, 0), (4, 0.25, 1)], "id int, score double, q int")
    assert sorted(r.id for r in V.relevant(rows, "q", 0.25).collect()) == [1, 2, 4]


def test_cosine_of_nothing(spark):
    got = values(spark, [([0.0, 0.0], [1.0, 0.0]), (None, [1.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<float>, b array<float>", F.round(V.cosine(F.col("a"), F.col("b")), 9))
    assert [x for (x,) in got] == [0.0, None, 1.0]


def test_alias_stands_alone(spark):
    got = values(spark, [("study it now",), ("unit",), ("it",), ("IT2",)], "t string", E.alias_present("IT", F.lower("t")))
    assert [x for (x,) in got] == [True, False, True, False]


def test_scopes_blank_out_longer_names_first(spark):
    names = ["data", "data science", "art"]
    got = values(spark, [("Data Science or art",), ("data",), ("ds please",), ("",), (None,)], "t string", E.resolve_scopes(F.col("t"), names, [("ds", "data science studies")]))
    # an alias brings every name that its term holds
    assert got[0][0] == ["data science", "art"] and got[1][0] == ["data"] and sorted(got[2][0]) == ["data", "data science"] and got[3][0] == []


def test_year_that_fits_nothing_keeps_all(spark):
    got = values(spark, [(["x (2560)", "x (2565)"], "in 2565"), (["x (2560)", "x (2565)"], "in 2599"), (["x (2560)"], "now")], "t array<string>, q string", E.narrow_by_year(F.col("t"), F.col("q")))
    assert [x for (x,) in got] == [["x (2565)"], ["x (2560)", "x (2565)"], ["x (2560)"]]


def test_search_text_needs_eight_characters(spark):
    of = E.search_text(F.col("q"), F.array("n"), "zzz", "Course")
    got = values(spark, [("Course Art 1234567", "art"), ("Course Art 12345678", "art"), ("free question", None)], "q string, n string", of)
    assert [x for (x,) in got] == ["Course Art 1234567", "12345678", "free question"]


def test_mentions_of_an_assistant_need_a_title(spark):
    of = E.mentions(F.col("t"), F.col("r"), ["art", "fine art"])
    got = values(spark, [("fine art", "user"), ("about art, yes", "assistant"), ("Programme of fine art (x)", "assistant"), ("- art\n", "assistant")], "t string, r string", of)
    assert [x for (x,) in got] == [["fine art"], [], ["fine art"], ["art"]]


def test_context(spark):
    rows = [(1, 1, ["a"]), (1, 2, []), (2, 1, ["a"]), (2, 2, ["a", "b"]), (3, 1, [])]
    got = {r.s: r.entity for r in C.context_entity(spark.createDataFrame(rows, "s int, at int, found array<string>"), "s", "at", "found").collect()}
    assert got == {1: "a", 2: None}


def test_validation(spark):
    raw = '{"items": [{"course_id": "1", "score": "abc", "rationale": "%s"}, {"course_id": "9", "score": 1}, {"course_id": "2", "score": 1.7, "cited_chunk_ids": ["c", "d"]}]}' % ("r" * 2001)
    of = G.validated_items(F.col("t"), F.array(F.lit("1"), F.lit("2")), F.array(F.lit("c")), 3)
    good, bad = values(spark, [(raw,), ("{",)], "t string", of)
    assert [(x.course_id, x.score, len(x.rationale), x.cited) for x in good[0]] == [("1", 0.0, 2000, []), ("2", 1.0, 0, ["c"])]
    assert bad[0] is None


def test_small_talk_is_the_whole_text(spark):
    of = G.small_talk(F.col("t"), {"greeting": ["hello"]}, ["who are you"])
    got = values(spark, [("Hello!",), ("hello, a question",), ("so who are you?",), ("",), ("who are you " + "x" * 40,)], "t string", of)
    assert [x for (x,) in got] == ["greeting", None, "identity", None, None]


def test_rationales(spark):
    got = values(spark, [("A b", {"### A b": "x"}), ("A b", {"ab": "y"}), ("A", {"z": "w"})], "t string, m map<string,string>", G.rationale_of(F.col("t"), F.col("m"), lambda x: F.lower(F.replace(x, F.lit(" "), F.lit("")))))
    assert [x for (x,) in got] == ["x", "y", ""]


def test_texts(spark):
    got = values(spark, [(None, None), ("", []), ("x", ["a", "b"])], "f string, l array<string>", A.profile_text([A.labelled("f: ", F.col("f")), A.labelled("l: ", A.joined(F.col("l")))]))
    assert [x for (x,) in got] == ["any programme", "any programme", "f: x | l: a, b"]
    assert values(spark, [("</doc>x",)], "t string", A.delimited("doc", F.col("t"))) == [("<doc>\nx\n</doc>",)]
    assert values(spark, [("please find art",), ("please find ",)], "t string", A.without_prefixes(F.col("t"), "please find")) == [("art",), ("please find ",)]


def test_unknown_names(spark):
    of = E.unknown_name(F.col("t"), "programme", "last|cost|is", ["blue bolt"], prefixes=("of", "the", "field"), asks=("which", "what"))
    got = values(spark, [("does the programme of the field Space Law cost much",), ("programme which is best",), ("the programme Blue Bolt is",), ("programme of the",), ("no marker",), ("programme of Art",), (None,)], "t string", of)
    assert [x for (x,) in got] == ["Space Law", None, None, None, None, None, None]


def test_search_text_goes_without_all_names(spark):
    state = E.scope_state(F.col("q"), ["Blue Bolt", "Red Gear"], [("rg", "Red Gear studies"), ("bb", "Blue Bolt")])
    got = values(spark, [("how do blue bolt and RG differ in 2565 please",), ("large bb?",), (None,)], "q string", state["found"], state["targets"], E.search_text(F.col("q"), state["targets"], "studies", "about"))
    assert got[0] == (["Blue Bolt", "Red Gear"], ["Blue Bolt", "rg"], "how do and differ in please")
    assert got[1] == (["Blue Bolt"], ["bb"], "large bb?")  # too little remains
    assert values(spark, [("Blue Bolt or IT, with items",)], "q string", E.without_names(F.col("q"), ["blue bolt"], ["it"])) == [("  or  , with items",)]


def test_tiles_and_blocks(spark):
    rng = random.Random(1)
    rows = [(k, [float(rng.choice((-1, 0, 1))) for _ in range(3)], k % 3) for k in range(60)] + [(100, None, 0), (101, [1.0], 1)]
    chunks = spark.createDataFrame(rows, "vec_id long, embedding array<double>, grp int")
    queries = chunks.where("vec_id % 7 = 0").selectExpr("vec_id as query_id", "embedding as q")
    cos = lambda a, b: 0.0 if not any(a) or not any(b) else sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    want = {}
    for q, a, _ in rows[:60:7]:
        for g in range(3):
            want[q, g] = [v for _, v in sorted((-round(cos(a, b), 9), v) for v, b, h in rows[:60] if h == g)[:2]]
    for sizes in ({}, {"tile": 9, "block": 2}):
        near = V.ranked_in(V.similarities(chunks, queries, 2, "grp", **sizes), ["query_id", "grp"], 2, [F.desc("score"), "vec_id"])
        got = {}
        for r in near.orderBy("query_id", "grp", "rank").collect():
            got.setdefault((r.query_id, r.grp), []).append(r.vec_id)
        assert got == want
    assert V.similarities(chunks, queries.limit(0)).count() == 0 and V.similarities(chunks.limit(0), queries, 3).count() == 0


def test_longest_match_finds_every_variant(spark):
    names = [("Ab", ["Ab", "x"]), ("Small Ring", ["Small Ring", "Ring"]), ("Small Rings", ["Small Rings"]), ("Other", ["Oth er\u00e9"]), ("None", ["", "zzzz"])]
    texts = ["an xAby", "the Small Ringside", "Small Rings", "\u00e9Oth er\u00e9", "", None, "x", "Rin", "aRingb"]
    questions = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "q int, t string")
    table = spark.createDataFrame([(n, v, k) for k, (n, v) in enumerate(names)], "name string, v array<string>, fee int")
    got = {r.q: r.matched for r in E.longest_match(questions, "q", "t", table, "name", "v", ["fee"]).collect()}
    want = {k: max(((len(n), n) for n, vs in names for v in vs if v and t and v in t), default=(0, None))[1] for k, t in enumerate(texts)}
    assert got == want
