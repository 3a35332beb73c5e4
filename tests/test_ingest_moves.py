"""How often a load moves what it reads."""

import random

from pyspark.sql import functions as F

from millrace.operators import flows as L
from millrace.sources import ingest as I
from millrace.sources import publish as P


def moved(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    listed = sc._jvm.java.util.ArrayList
    stages = sc._jsc.sc().statusStore().stageList(listed(), False, False, sc._gateway.new_array(sc._jvm.double, 0), listed())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_contents_and_pages_move_once_each(spark, tmp_path):
    rng, texts = random.Random(5), []
    for _ in range(60):
        texts.append("\n\n".join(rng.randbytes(1500).hex() for _ in range(10)))
    docs = spark.createDataFrame([(f"f{k}.{'exe' if k % 4 == 1 else 'txt'}", t) for k, t in enumerate(texts)], "path string, text string")
    docs.write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files")).withColumn("content", F.encode("text", "UTF-8")).withColumn("length", F.octet_length("content"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with tables that are too large for it
    try:
        before = moved(spark)
        L.ingest(I.described(files.drop("text")), str(tmp_path / "table"), "one")
        assert 0 < moved(spark) - before < 2.2 * sum(len(t) for k, t in enumerate(texts) if k % 4 != 1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    rows = P.published(spark, str(tmp_path / "table"), L.CHUNKS)
    assert "_error" not in rows.columns and rows.where("content is null or embedding is null").count() == 0
    assert rows.select("document_id").distinct().count() == 45
    assert {(r.status, r.error): r["count"] for r in P.statuses(spark, str(tmp_path / "table")).groupBy("status", "error").count().collect()} == {("done", None): 45, ("failed", "unknown kind"): 15}
