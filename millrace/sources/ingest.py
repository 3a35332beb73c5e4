"""Reading documents, and loading them without doing work twice."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import strip
from millrace.sources.page_source import MAX_BYTES, pages_or_error, pdf_pages


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content, reason): every file, with why it can't be used; null if it can. Empty files have no row: Spark's readers pass over them."""
    return described(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))


def described(files: DataFrame) -> DataFrame:
    """files (path, length, content) with sha256, kind and the reason why a file can't be used."""
    kind = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    reason = (
        F.when(F.col("length") > MAX_BYTES, "too large").when(~kind.isin("txt", "pdf"), "unknown kind")
        .when((kind == "pdf") & (F.substring("content", 1, 5) != F.lit(b"%PDF-")), "not a PDF")
    )
    return files.select("path", "length", "content", F.sha2("content", 256).alias("sha256"), kind.alias("kind"), reason.alias("reason"))


def split_pages(text: Column, by: str = "\n\n") -> Column:
    """The trimmed, non-empty parts between separators, in order."""
    return F.filter(F.transform(F.split(text, by), strip), lambda x: x != "")


def pages_of(docs: DataFrame, text: Column, by: str = "\n\n") -> DataFrame:
    """A row for each page, numbered from 1."""
    return docs.select("*", F.posexplode(split_pages(text, by)).alias("page_number", "page_text")).withColumn("page_number", F.col("page_number") + 1)


def pages_and_errors(files: DataFrame, extract=None, keys: tuple[str, ...] = ("path", "sha256")) -> DataFrame:
    """(path, sha256, or other keys, page_number, page_text, error): the pages of all files, and a row with an error, without a page, for each file that can't be read.

    extract: a PDF's bytes -> its pages' texts; by default the pypdf library, where it is installed. One bad file leaves the others' pages alone.
    """

    @F.arrow_udf("array<struct<page_number: int, page_text: string, error: string>>")
    def read(paths: pa.Array, lengths: pa.Array, contents: pa.Array, reasons: pa.Array) -> pa.Array:
        out = []
        for path, length, content, reason in zip(paths, lengths, contents, reasons, strict=True):  # a file at a time is held
            rows = [(None, None, reason.as_py())] if reason.is_valid else [r[2:] for r in pages_or_error(path.as_py(), length.as_py(), content.as_py, extract or pdf_pages)]
            out.append([dict(zip(("page_number", "page_text", "error"), r, strict=True)) for r in rows])
        return pa.array(out, pa.list_(pa.struct([("page_number", pa.int32()), ("page_text", pa.string()), ("error", pa.string())])))

    content = F.when(F.col("reason").isNull(), F.col("content"))
    return files.select(*keys, F.inline(read.asNondeterministic()("path", "length", content, "reason")))


def read_pages(files: DataFrame, extract=None) -> DataFrame:
    """(path, sha256, page_number, page_text) of the files that can be read."""
    return pages_and_errors(files, extract).where("error is null").drop("error")


def with_manifest(files: DataFrame, stem: str, manifest: DataFrame, key: str, name: str) -> DataFrame:
    """files with `name` from the manifest, or the stem where that has none."""
    named = manifest.select(F.col(key).alias("_key"), F.col(name).alias("_name"))
    return files.join(named, F.col(stem) == F.col("_key"), "left").withColumn(name, F.coalesce("_name", stem)).drop("_key", "_name")


def sparse_pages(pages: DataFrame, text: str, images: str, least: int = 200) -> DataFrame:
    """Pages with an image and little text, which need character recognition."""
    return pages.where((F.length(strip(F.col(text))) < least) & (F.col(images) > 0))


def overlay_text(pages: DataFrame, found: DataFrame, keys: list[str], text: str, more: str, unreadable: str) -> DataFrame:
    """pages with recognised text after their own, unless that is empty or marked unreadable."""
    usable = found.where((F.length(F.trim(more)) > 0) & ~F.col(more).contains(unreadable)).select(*keys, F.col(more).alias("_more"))
    return pages.join(usable, keys, "left").withColumn(text, F.when(F.col("_more").isNotNull(), F.concat_ws("\n", text, "_more")).otherwise(F.col(text))).drop("_more")


def not_ingested(docs: DataFrame, done: DataFrame, sha: str = "sha256") -> DataFrame:
    """Documents whose content is not done yet: checked before anything costly."""
    return docs.join(done.where("status = 'done'").select(sha), sha, "left_anti")


def get_or_create(wanted: DataFrame, existing: DataFrame, key: str, id_col: str, new_id: Column) -> DataFrame:
    """(key, id, created): the id that a key has, or a new one."""
    return wanted.select(key).distinct().join(existing.select(key, F.col(id_col).alias("_id")), key, "left").select(
        key, F.coalesce("_id", new_id).alias(id_col), F.col("_id").isNull().alias("created")
    )


def upsert_unless_done(stored: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The table after the upsert: done rows stay, others take the incoming values and are processing; action says what happened."""
    new = incoming.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_in"))
    done = F.col("status") == "done"
    pick = lambda c: F.when(F.col("_in").isNull() | done, F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    return stored.join(new, key, "full").select(
        key, *[pick(c) for c in columns], F.when(F.col("_in").isNull() | done, F.col("status")).otherwise(F.lit("processing")).alias("status"),
        F.when(F.col("status").isNull(), "insert").when(F.col("_in").isNull() | done, "keep").otherwise("update").alias("action"),
    )


def replace_partitions(chunks: DataFrame, path: str, by: str = "document_id") -> None:
    """Writes chunks so that the partitions that they have rows for are replaced and others stay; repeating it changes nothing."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def without_result(cases: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Cases that have no stored result yet: an evaluation that was stopped goes on with these."""
    return cases.join(results.select(key), key, "left_anti")


def save_results(results: DataFrame, path: str, batch: str) -> None:
    """Stores the results of one batch: whole or not at all, and a batch that is run again replaces what it stored before."""
    replace_partitions(results.withColumn("batch", F.lit(batch)), path, "batch")


def read_json_dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)
