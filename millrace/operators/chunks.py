"""Pages to chunks: repeated lines out, overlapping windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import strip, token_estimate


#: Fixed value: what ends a line.
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def _lines(text: Column) -> Column:
    """The lines of a text; what a last line end would begin is none."""
    return F.split(F.regexp_replace(text, f"(?:{LINE_ENDS})\\z", ""), LINE_ENDS, -1)


def repeated_lines(pages: DataFrame, doc: str, text: str, share: float = 0.6, longest: int = 120, least_pages: int = 3) -> DataFrame:
    """(doc, line, n_pages): trimmed lines, under `longest` characters, on at least max(2, floor(share x pages)) pages of a document with `least_pages` or more."""
    lines = F.array_distinct(F.filter(F.transform(_lines(F.col(text)), strip), lambda x: (x != "") & (F.length(x) < longest)))
    counted = pages.select(doc, F.explode(lines).alias("line")).groupBy(doc, "line").agg(F.count("*").alias("n_pages"))
    total = pages.groupBy(doc).agg(F.count("*").alias("_pages")).where(F.col("_pages") >= least_pages)
    return counted.join(total, doc).where(F.col("n_pages") >= F.greatest(F.lit(2), F.floor(F.col("_pages") * share))).select(doc, "line", "n_pages")


def without_repeated_lines(pages: DataFrame, doc: str, text: str, found: DataFrame | None = None, **limits) -> DataFrame:
    """pages without the lines that repeated_lines() finds, or has found (doc, line); the others are joined by a newline. Only pages of documents that have such a line are taken apart."""
    found = (repeated_lines(pages, doc, text, **limits) if found is None else found).groupBy(doc).agg(F.collect_set("line").alias("_lines"))
    joined = pages.join(found, doc, "left").withColumn("_own", F.when(F.col("_lines").isNotNull(), _lines(F.col(text))))
    joined = joined.withColumn("_gone", F.array_intersect(F.transform("_own", strip), "_lines"))  # by hash: few remain to be looked for in each line
    kept = F.array_join(F.filter("_own", lambda x: ~F.array_contains(F.col("_gone"), strip(x))), "\n")
    return joined.withColumn(text, F.when(F.size("_gone") > 0, kept).when(F.col("_own").isNotNull(), F.array_join("_own", "\n")).otherwise(F.col(text))).drop("_lines", "_own", "_gone")


def chunk_pages(pages: DataFrame, doc: str, page: str, text: str, size: int = 1000, overlap: int = 150, retreat: int = 120, least: int = 20) -> DataFrame:
    """(doc, chunk_index, page, content, token_count): windows of a page, each ended at the last space of its last `retreat` characters.

    A retreat is shorter than the overlap, so windows start at multiples of size - overlap wherever they end, and a page
    splits into windows without regard to one another. Chunks of a document are numbered in page order, short ones left out.
    """
    if retreat >= overlap or overlap > size - overlap:
        raise ValueError("a retreat must be shorter than the overlap, and the overlap at most half of the size")
    step = size - overlap
    body = pages.select(doc, page, strip(F.col(text)).alias("_t")).where(F.length("_t") > 0)
    # The text is cut once, into steps; a window is a step and the beginning of the next.
    count = F.greatest(F.lit(0), F.ceil((F.length("_t") - size) / step)).cast("int")
    cut_up = body.select(doc, page, count.alias("_n"), F.regexp_extract_all("_t", F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("_s"))
    joined = F.transform(F.slice("_s", F.lit(1), F.col("_n") + 1), lambda x, k: F.concat(x, F.substring(F.coalesce(F.get(F.col("_s"), k + 1), F.lit("")), 1, overlap)))
    windows = cut_up.select(doc, page, "_n", F.posexplode(joined).alias("_k", "_w"))
    # Characters after the last space among the last ones, and that space, counted from the end of a full window.
    back = F.instr(F.reverse(F.substring("_w", size - retreat + 1, retreat)), " ")
    cut = F.when((F.col("_k") < F.col("_n")) & (back > 0), F.substring(F.col("_w"), F.lit(1), size - back)).otherwise(F.col("_w"))
    pieces = windows.select(doc, page, "_k", strip(cut).alias("content")).where(F.length("content") >= least)
    order = Window.partitionBy(doc).orderBy(page, "_k")
    return pieces.select(doc, (F.row_number().over(order) - 1).alias("chunk_index"), page, "content", token_estimate(F.col("content")).alias("token_count"))
