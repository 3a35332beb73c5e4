"""A table of documents' rows that readers only ever see whole: loads write beside each other, and a manifest that is swapped last says which count.

    <path>/rows/load=<name>         the rows of a load's documents; those with an _error, which readers pass over, say why a document failed
    <path>/documents/load=<name>    a row for each document: status (done, failed) and error
    <path>/begun/load=<name>        a row for each document that the load set out to process
    <path>/manifest/<generation>    the names of the loads that count, in the order in which they were published

A load that dies leaves files that no manifest names; the same load, run again, replaces them. Of a document the newest published load that did it counts.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.folders import exists, names_in, read_text, write_new


def generation(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The number of the newest manifest, and the loads that it names; 0 and none at first."""
    numbers = [int(n) for n in names_in(spark, f"{path}/manifest") if n.isdigit()]
    return (max(numbers), json.loads(read_text(spark, f"{path}/manifest/{max(numbers):012d}"))) if numbers else (0, [])


def begin(documents: DataFrame, path: str, load: str, document: str = "document_id") -> None:
    """Says that a load sets out to process these documents."""
    documents.select(document).distinct().write.mode("overwrite").parquet(f"{path}/begun/load={load}")


def publish(rows: DataFrame, path: str, load: str, document: str = "document_id", failed: DataFrame | None = None, by: str | None = None, every: DataFrame | None = None, error: str | None = None) -> int:
    """Publishes a load's rows; returns the generation from which readers see them. failed: (document, error) of documents that couldn't be done; every: (document) of
    all that the load was to do, of which those without rows or errors are done too.

    error: a column of rows instead of `failed`, so that rows and errors come from one pass: where it isn't null the row is none of the document's, but says why it couldn't be done.

    by: a column by whose values the rows are parted into folders, so that readers of few values read few files.

    A load that is published already is left as it is. Two loads that are published at one time both count: who comes second takes the next generation.
    """
    spark = rows.sparkSession
    number, loads = generation(spark, path)
    if load in loads:
        return number
    rows = rows.withColumnRenamed(error, "_error") if error else rows
    writer = rows.hint("rebalance", by).write.partitionBy(by) if by else rows.write
    writer.mode("overwrite").parquet(f"{path}/rows/load={load}")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/rows/load={load}")
    reason = F.col("_error") if error else F.lit(None).cast("string")
    listed = stored.groupBy(document).agg(F.count_if(reason.isNull()).alias("n_rows"), F.min(reason).alias("error"))
    done = F.col("n_rows") > 0
    listed = listed.select(document, F.when(done, "done").otherwise("failed").alias("status"), F.when(~done, F.substring("error", 1, 500)).alias("error"), "n_rows")
    if failed is not None:
        lost = failed.groupBy(document).agg(F.min("error").alias("error")).join(listed.select(document), document, "left_anti")
        listed = listed.unionByName(lost.select(document, F.lit("failed").alias("status"), F.substring("error", 1, 500).alias("error"), F.lit(0).cast("long").alias("n_rows")))
    if every is not None:
        bare = every.select(document).distinct().join(listed.select(document), document, "left_anti")
        listed = listed.unionByName(bare.select(document, F.lit("done").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(0).cast("long").alias("n_rows")))
    listed.write.mode("overwrite").parquet(f"{path}/documents/load={load}")
    while not write_new(spark, f"{path}/manifest/{number + 1:012d}", json.dumps([*loads, load])):
        number, loads = generation(spark, path)
        if load in loads:
            return number
    return number + 1


def _documents(spark: SparkSession, path: str, document: str) -> DataFrame | None:
    """(document, status, error, n_rows, load, place) of all published loads, place: the load's place in the manifest."""
    _, loads = generation(spark, path)
    if not loads:
        return None
    read = spark.read.option("basePath", f"{path}/documents").parquet(*[f"{path}/documents/load={x}" for x in loads]).withColumn("load", F.col("load").cast("string"))
    return read.join(F.broadcast(spark.createDataFrame(list(zip(loads, range(len(loads)), strict=True)), "load string, place int")), "load")  # a row for each load


def published(spark: SparkSession, path: str, schema, document: str = "document_id", at: int | None = None) -> DataFrame:
    """The rows that count: of each document those of the newest published load that did it. at: as of an earlier generation."""
    number, loads = generation(spark, path)
    if at is not None and 0 < at < number:
        loads = json.loads(read_text(spark, f"{path}/manifest/{at:012d}"))
    if not loads or at == 0:
        return spark.createDataFrame([], schema)
    fields = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    rows = spark.read.schema(f"{fields}, _error string, load string").option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/load={x}" for x in loads])
    rows = rows.where("_error is null").drop("_error")  # null in loads without errors
    done = _documents(spark, path, document).where(F.col("status") == "done").where(F.col("load").isin(loads))
    # Only documents that several loads did need a look; rows are moved for none, as long as these are few.
    old = done.groupBy(document).agg(F.collect_list(F.struct("place", "load")).alias("all"), F.max("place").alias("newest")).where(F.size("all") > 1)
    old = old.select(document, F.explode("all").alias("one"), "newest").where("one.place < newest").select(document, F.col("one.load").alias("load"))
    return rows.join(old, [document, "load"], "left_anti").drop("load").select(*[c for c in rows.columns if c != "load"])


def statuses(spark: SparkSession, path: str, document: str = "document_id") -> DataFrame:
    """(document, status, error): done or failed by the newest load that says so (done wins over a later failure: its rows still count), processing if only a load that isn't published began it."""
    listed, kind = _documents(spark, path, document), None
    _, loads = generation(spark, path)
    out = None
    if listed is not None:
        kind = listed.schema[document].dataType.simpleString()
        best = listed.groupBy(document).agg(F.max(F.struct((F.col("status") == "done").alias("ok"), "place", "status", "error")).alias("x"))
        out = best.select(document, "x.status", "x.error")
    open_ = [n for n in names_in(spark, f"{path}/begun") if n.startswith("load=") and n.removeprefix("load=") not in loads]
    if open_:
        begun = spark.read.parquet(*[f"{path}/begun/{n}" for n in open_]).select(document).distinct()
        begun = begun.select(document, F.lit("processing").alias("status"), F.lit(None).cast("string").alias("error"))
        out = begun if out is None else out.unionByName(begun.join(out.select(document), document, "left_anti"))
    return out if out is not None else spark.createDataFrame([], f"{document} {kind or 'string'}, status string, error string")


def not_done(documents: DataFrame, path: str, document: str = "document_id") -> DataFrame:
    """documents without those that are done: what a load still has to process, those included that failed or were being processed."""
    if not exists(documents.sparkSession, f"{path}/manifest"):
        return documents
    return documents.join(statuses(documents.sparkSession, path, document).where("status = 'done'").select(document), document, "left_anti")
