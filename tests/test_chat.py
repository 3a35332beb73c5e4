"""The ordered flow of a turn, branch by branch, and what a conversation gives a turn to go by."""

from pyspark.sql import functions as F

from millrace.operators import chat as C

has = lambda *words: lambda t: F.coalesce(F.lower(t).rlike("|".join(words)), F.lit(False))
NAMES = ["art", "law"]
RULES = C.Rules(
    small_talk=lambda t: F.when(F.lower(t) == "hello", "greeting"), lists=has("which programmes"), fee=has("fee"), specific=has("credits", "fee"), names=lambda t: F.filter(F.array(*[F.when(F.lower(t).contains(n), n) for n in NAMES]), lambda x: x.isNotNull()), known=has("fine art"),
    unknown=lambda t: F.when(t.contains("programme of magic"), "magic"), interest=lambda t: F.when(t.contains("recommend"), F.lit("drawing")), cached=lambda t: F.when(t == "asked before", "not_found"), rewritten=lambda t, p: F.when(t.startswith("and "), F.concat_ws(" ", F.substring(t, 5, 100), p)),
    translated=lambda t: F.when(t.startswith("hola"), F.lit("good query")), score=lambda t: F.when(t.contains("good"), 0.9).when(t.contains("poor"), 0.3).otherwise(0.6), in_scope=lambda t: ~t.contains("weather"), answerable=lambda t: ~t.contains("secret"), reference="this programme", offer="Tell me more",
)


def route(spark, *turns):
    rows = [(k, text, n, role, previous, before, programme) for k, (text, n, role, previous, before, programme) in enumerate(turns)]
    df = spark.createDataFrame(rows, "id int, text string, n_history int, previous_role string, previous string, asked_before string, programme string")
    return [(r.step, r.status, r.query) for r in C.routed(df, RULES).orderBy("id").collect()]


def first(text):
    return (text, 0, None, None, None, None)


def later(text, programme=None, previous="an answer", before="a question"):
    return (text, 2, "assistant", previous, before, programme)


def test_first_turns(spark):
    got = route(spark, *map(first, ["asked before", "Hello", "Which programmes are there, and what fee?", "what fee has art", "recommend something", "the programme of magic", "how many credits", "how many credits has law", "is this programme good", "good question", "poor question", "poor question on fine art", "some weather", "good weather", "a good secret", "hola poor"]))
    assert got == [
        ("cached", "not_found", "asked before"), ("small_talk", "small_talk", "Hello"), ("list", "answered", "Which programmes are there, and what fee?"), ("fee", "answered", "what fee has art"), ("recommended", "answered", "drawing"), ("unknown", "answered", "the programme of magic"),
        ("which", "answered", "how many credits"), ("search", "answered", "how many credits has law"), ("which", "answered", "is this programme good"), ("search", "answered", "good question"), ("search", "out_of_scope", "poor question"), ("search", "answered", "poor question on fine art"),
        ("search", "out_of_scope", "some weather"), ("search", "answered", "good weather"), ("search", "not_found", "a good secret"), ("search", "answered", "good query"),
    ]


def test_later_turns(spark):
    got = route(
        spark, later("asked before"), later("and the fee?", "law"), later("what fee", "law"), later("what fee has art", "law"), later("what fee"), later("is this programme good", "law"), later("is this programme good"), later("how many credits"),
        later("rather drawing", previous="Tell me more, please", before=" I like colours "), later("how many credits", previous="Tell me more, please"), later("rather fine art", previous="Tell me more, please"), later("rather drawing", previous="Tell me more, please", before=" "),
        later("and poor things", "law"), later("and good things"), later("and poor good"), later("and " + "x" * 300),
    )
    assert got[:8] == [("search", "answered", "asked before"), ("fee", "answered", "and the fee? law"), ("fee", "answered", "what fee law"), ("fee", "answered", "what fee has art"), ("fee", "answered", "what fee"), ("search", "answered", "is law good"), ("which", "answered", "is this programme good"), ("search", "answered", "how many credits")]
    assert got[8:12] == [("refined", "answered", "I like colours rather drawing"), ("search", "answered", "how many credits"), ("search", "answered", "rather fine art"), ("search", "answered", "rather drawing")]
    # The rewritten question counts as it names a programme, though it scores no more; else only if it scores more.
    assert got[12:] == [("search", "out_of_scope", "poor things law"), ("search", "answered", "and good things"), ("search", "answered", "and poor good"), ("search", "answered", "and " + "x" * 300)]


def test_a_rewritten_question_may_ask_for_a_fee(spark):
    rules = C.Rules(**{**RULES.__dict__, "rewritten": lambda t, p: F.concat(F.lit("the fee of "), p)})
    df = spark.createDataFrame([("of law", 2, "assistant", "x", "what fee", "law")], "text string, n_history int, previous_role string, previous string, asked_before string, programme string")
    row = C.routed(df, rules).first()
    assert (row.step, row.query) == ("fee_later", "the fee of law")


def test_context_of_turns(spark):
    said = [(0, "user", "about art", ["art"]), (1, "assistant", "yes", []), (2, "user", "and more", []), (3, "assistant", "art or law", ["art", "law"]), (4, "user", "this one", []), (5, "assistant", "law", ["law"]), (6, "user", None, []), (7, "assistant", "", []), (100, "user", "long after", [])]
    turns = spark.createDataFrame([(1, k, 60.0 * k, role, text, named) for k, role, text, named in said], "conv long, turn long, at double, role string, text string, named array<string>")
    got = [tuple(r)[6:] for r in C.turn_context(turns, "conv", "turn", "at", "role", "text", "named", history=3).orderBy("turn").collect()]
    assert got == [(0, None, None, None, None), (2, "assistant", "yes", "about art", "art"), (3, "assistant", "art or law", "and more", None), (3, "assistant", "law", "this one", "law"), (0, None, None, None, None)]
