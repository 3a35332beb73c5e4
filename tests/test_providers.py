import pytest
from pyspark.sql import functions as F

from millrace.functions import providers as P
from millrace.operators import gates as G


def test_embedding_is_deterministic(spark):
    rows = spark.createDataFrame([("a",), (None,), ("a",)], "t string").select(P.embed(F.col("t")).alias("v")).collect()
    assert rows[0].v == rows[2].v and len(rows[0].v) == 16 and rows[1].v is None


def test_chat_fails_to_null(spark):
    class Failing(P.Stub):  # in here it is sent to the workers by value
        def chat(self, prompt):
            raise OSError("429")

    df = spark.createDataFrame([("a",)], "t string")
    assert df.select(P.chat(F.col("t"))).first()[0] == '{"items": [], "seen": 1}'
    assert df.select(P.chat(F.col("t"), Failing)).first()[0] is None


def test_recognition_is_resumed(spark, tmp_path):
    sink = str(tmp_path / "ocr")
    page = lambda *r: spark.createDataFrame([(f, p, b"x") for f, p in r], "file string, page int, image binary")
    assert P.recognise_pages(page(("a", 1)), sink).count() == 1
    assert P.recognise_pages(page(("a", 1), ("a", 2)), sink).count() == 2


DAILY = '{"error": {"details": [{"quotaId": "RequestsPerDayPerModel"}, {"retryDelay": "24s"}]}}'
MINUTE = '{"error": {"details": [{"quotaId": "RequestsPerMinutePerModel"}, {"retryDelay": "%ss"}]}}'


def test_kinds_of_quota():
    assert P.QuotaUsed.of(DAILY).rest == 4 * 3600
    assert P.QuotaUsed.of(MINUTE % 31).rest == 45 and P.QuotaUsed.of(MINUTE % 60.5).rest == 62.5
    assert P.QuotaUsed.of('{"error": "exhausted"}').rest == 4 * 3600 and P.QuotaUsed.of("limit per minute reached").rest == 45


class Refusing(P.Stub):
    def __init__(self, bodies):
        super().__init__()
        self.bodies = list(bodies)

    def chat(self, prompt):
        if self.bodies and (body := self.bodies.pop(0)):
            raise P.QuotaUsed.of(body)
        return prompt


def test_a_model_that_refuses_is_left_alone_for_its_time():
    now, waits = [0.0], []

    def pause(seconds):
        waits.append(seconds)
        now[0] += seconds

    model = P.Fallback({"main": Refusing([DAILY]), "second": Refusing([None, MINUTE % 10]), "third": Refusing([None, MINUTE % 60])}, lambda: now[0], pause)
    assert model.chat("a") == "a" and model.calls == {"main": 1, "second": 1}
    assert model.chat("b") == "b" and model.calls == {"main": 1, "second": 2, "third": 1}  # main rests for hours, second for 45 s
    now[0] = 10.0
    with pytest.raises(P.QuotaUsed):
        model.chat("c")  # third refuses too, and no other is free
    assert model.chat("d") == "d" and waits == [36.0] and model.calls["second"] == 3  # waits for second, free at 45 s
    now[0] = 4 * 3600.0
    assert model.chat("e") == "e" and model.calls["main"] == 2
    lost = P.Fallback({"main": Refusing([DAILY, None])}, lambda: now[0], pause)
    with pytest.raises(P.QuotaUsed):
        lost.chat("a")
    assert lost.chat("b") == "b" and len(waits) == 1  # too long for anyone to wait: tried again


def test_fallback_inside_tasks(spark):
    class Daily(P.Stub):  # in here it is sent to the workers by value
        def chat(self, prompt):
            raise P.QuotaUsed(True)

    class Second(P.Stub):
        def chat(self, prompt):
            return f"second: {prompt}"

    df = spark.createDataFrame([(f"q{k}",) for k in range(20)] + [(None,)], "t string").coalesce(1)
    got = df.select(P.chat(F.col("t"), lambda: P.Fallback({"main": Daily(), "second": Second()})).alias("r")).collect()
    assert [r.r for r in got] == [f"second: q{k}" for k in range(20)] + [None]


def test_gates(spark):
    df = spark.createDataFrame([("fees of this programme?", "Art $1"), ("fees?", "Art"), ("fees?", None)], "t string, e string")
    assert [r[0] for r in df.select(G.resolve_reference(F.col("t"), "this programme", F.col("e"))).collect()] == ["fees of Art $1?", "fees? Art", "fees?"]
    asked = spark.createDataFrame([("I like data  science", "data science", True), ("I like it", "music", True), ("x", "x", False), ("x", "x", None)], "t string, i string, w boolean")
    none = F.lit(False)
    assert [r[0] for r in asked.select(G.recommendation(F.col("t"), none, F.col("w"), F.col("i"), none)).collect()] == ["data science", "I like it", None, None]
    said = spark.createDataFrame([(1, "good"), (1, "good"), (2, "no ground"), (2, ""), (3, None), (4, "good"), (4, "")], "k int, r string").withColumn("s", G.support(F.col("r"), ["no ground"]))
    assert {r.k: r.whole for r in G.support_of(said, ["k"], "s").collect()} == {1: "all_supported", 2: "none_supported", 3: "none_explained", 4: "mixed"}
    cells = spark.createDataFrame([(1, "b", "y"), (1, "a", "x"), (1, "c", "not stated"), (1, "d", "z")], "k int, d string, v string")
    assert G.as_points(cells, "k", "d", "v", ["a", "b", "c"], "not stated").first().points == ["x", "y"]
