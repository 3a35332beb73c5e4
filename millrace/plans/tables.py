"""The tables that the registered queries run on, and views of them that look like a catalogue of programmes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """course_id, name, level, year, title, is_active, fee: a programme for each part; parts that share a name are its editions."""
    title = F.concat(F.lit("Programme of "), F.initcap("p_type"), F.lit(" field "), F.initcap("p_name"), F.lit(" (B.E. "), (F.lit(2560) + F.col("p_size") % 9).cast("string"), F.lit(")"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("course_id"), F.initcap("p_name").alias("name"), F.initcap("p_type").alias("level"), (F.lit(2560) + F.col("p_size") % 9).alias("year"),
        title.alias("title"), (F.col("p_partkey") % 7 != 3).alias("is_active"), (F.floor(F.col("p_retailprice")) * 20).cast("long").alias("fee"), F.col("p_brand").alias("brand"),
    )


#: The same in DuckDB's SQL, to begin a statement with.
COURSES = """with cap as (select *, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') as name,
                     upper(p_type[1:1]) || lower(p_type[2:]) as level, 2560 + p_size % 9 as year from part),
     courses as (select p_partkey as course_id, name, level, year, 'Programme of ' || level || ' field ' || name || ' (B.E. ' || year || ')' as title,
                        p_partkey % 7 <> 3 as is_active, cast(floor(p_retailprice) as bigint) * 20 as fee, p_brand as brand from cap)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_number, page_text: documents split at newlines."""
    from millrace.sources.ingest import pages_of

    return pages_of(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"), "\n").select("doc_id", "page_number", "page_text")


PAGES = """with lines as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
     kept as (select doc_id, i, trim(t, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as page_text from lines),
     pages_of as (select doc_id, cast(row_number() over (partition by doc_id order by i) as int) as page_number, page_text from kept where page_text <> '')"""
