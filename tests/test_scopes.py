"""The scopes of questions: each list of editions is made once, whatever the number of questions."""

from pyspark.sql import functions as F

from millrace.operators import flows


def test_lists_of_years_and_their_fallback(spark):
    catalog = spark.createDataFrame(
        [(3, "Law", "Law (B.E. 2560)", True), (1, "Law", "Law (B.E. 2561)", True), (2, "Law", "Law (B.E. 2560)", True), (4, "Law", "Law (B.E. 2562)", False), (5, "Art", "Art 25256", True), (6, "Art", None, True), (7, "Dead", "Dead 2560", False)],
        "course_id long, name string, title string, is_active boolean",
    )
    asked = spark.createDataFrame([(1, "law 2560"), (2, "law"), (3, "law 2562"), (4, "art 2525 and law"), (5, "art 2556"), (6, "dead 2560"), (7, "none"), (8, None), (9, "art 2525")], "q_id long, q string")
    found = flows.scopes(asked, "q_id", "q", catalog, ["Law", "Art", "Dead"], [], "x", "y").select("q_id", "name", "ids").collect()
    # 25256 holds 2525, and 5256, which is no year.
    want = {(1, "Law", (2, 3)), (2, "Law", (1, 2, 3)), (3, "Law", (1, 2, 3)), (4, "Art", (5,)), (4, "Law", (1, 2, 3)), (5, "Art", (5, 6)), (9, "Art", (5,))}
    assert {(r.q_id, r.name, tuple(r.ids)) for r in found} == want and len(found) == len(want)


def test_a_list_is_made_once_for_all_questions(spark):
    made, n = spark.sparkContext.accumulator(0), 60

    @F.udf("string")
    def shown(ids):
        made.add(1)
        return ",".join(map(str, ids))

    catalog = spark.range(500).select(F.col("id").alias("course_id"), F.lit("Law").alias("name"), F.lit("Law 2560").alias("title"), F.lit(True).alias("is_active"))
    asked = spark.range(n).select(F.col("id").alias("q_id"), F.concat(F.lit("law 25"), F.when(F.col("id") % 2 == 0, "60").otherwise("99")).alias("q"))
    rows = flows.scopes(asked, "q_id", "q", catalog, ["Law"], [], "x", "y", shown.asNondeterministic()).select("q_id", "ids").collect()
    assert len(rows) == n and {r.ids for r in rows} == {",".join(map(str, range(500)))} and made.value <= 4
