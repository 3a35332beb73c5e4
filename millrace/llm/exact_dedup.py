"""Exact dedup by skew-safe combining: local dedup, salted digest groups, then the winners of the salts.

Every stage groups by digest *and* whole text, so equal digests of different texts never meet. Spark's partial
aggregation is the local dedup: a map task sends each different text once, however many copies it has read. Only digests
with more than a task's share of the rows are salted, so only the few winners of hot digests are shuffled a second time,
and the texts of all others cross the network once. The last join, which gives every row its group, carries digests only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import cut, shuffle_partitions


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=lambda text: text) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after `normalise` (a function of a Column; nothing by default); null counts as empty.
    Of equal texts the row with the largest id stays, and rows that repeat that id stay with it; a null id never wins
    against another. Other columns of docs aren't returned. Empty input gives no rows.
    """
    spark = docs.sparkSession
    text: Column = normalise(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("content")).withColumn("digest", F.sha2("content", 256))

    sizes = cut(rows.groupBy("digest").agg(F.count("*").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    share = total // (4 * shuffle_partitions(spark)) + 1
    # At most 4 x shuffle partitions digests hold more than a share: a proven size to broadcast.
    hot = F.broadcast(sizes.where(F.col("n") > share).select("digest", F.ceil(F.col("n") / share).cast("int").alias("salts")))

    def combined(of: DataFrame, *keys: str) -> DataFrame:
        return of.groupBy(*keys).agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    salted = rows.join(hot, "digest", "left").select(
        "digest", "content", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).alias("salt"), F.col("salts").isNotNull().alias("hot"), F.col("id").alias("keep_id"), F.lit(1).alias("group_size")
    )
    # Only digest and length of a content leave this stage, with whether the group is final: not hot, or yet to be combined.
    winners = cut(combined(salted, "digest", "salt", "hot", "content").select(
        "digest", "hot", "keep_id", "group_size", F.when(F.col("hot"), F.col("content")).alias("content"),
    ))
    groups = winners.where("not hot").select("digest", "keep_id", "group_size").unionByName(
        combined(winners.where("hot"), "digest", "content").drop("content")
    )
    groups = cut(groups)
    answer = lambda x: x.select(
        F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )
    shared = groups.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    if shared.isEmpty():  # what whole contents have shown: each digest stands for one text, so the digest is enough to join on
        return answer(rows.select("id", "digest").join(groups, "digest"))
    split = combined(salted, "digest", "content")
    return answer(rows.join(split, ["digest", "content"]))
