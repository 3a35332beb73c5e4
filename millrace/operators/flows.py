"""Flows composed of the operators: a document's repair, a match of profiles with programmes, the scopes of a question, a request to compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import providers
from millrace.functions import text as X
from millrace.operators import entities as E
from millrace.operators import vectors as V
from millrace.operators.chunks import chunk_pages, repeated_lines, without_repeated_lines
from millrace.sources import ingest as I
from millrace.sources import publish as P


def clean_documents(pages: DataFrame, doc: str, text: str, wrong: str, right: str, rules: list[tuple[str, str]], **limits) -> DataFrame:
    """pages repaired: characters and sequences first, so that a line is the same on every page; then control characters, repeated lines and white space."""
    repaired = pages.withColumn(text, X.repair_sequences(X.repair_characters(F.col(text), wrong, right), rules))
    found = repeated_lines(repaired, doc, text, **limits)
    bare = repaired.withColumn(text, X.strip_controls(X.nfc(F.col(text))))
    return without_repeated_lines(bare, doc, text, found=found).withColumn(text, X.normalise_space(F.col(text)))


def match(scores: DataFrame, offered: DataFrame, name: str, id_col: str, limit: int = 5, margin: float | None = None, query: str = "query_id") -> DataFrame:
    """scores (query, id, name, score, ...): for each query the best programmes that are offered, one edition of each name, with rank, percent and confidence.

    margin: only programmes at most this far below the best.
    """
    rows = V.collapse(scores.join(offered, name, "left_semi"), [query, name], [F.desc("score"), id_col])
    if margin is not None:
        rows = V.relevant(rows, query, margin)
    ranked = V.ranked_in(rows, query, limit, [F.desc("score"), id_col]).withColumn("percent", V.percent(F.col("score")))
    return ranked.join(V.confidence(ranked, [query]), query)


def scopes(questions: DataFrame, id_col: str, text: str, catalog: DataFrame, names: list[str], aliases: list[tuple[str, str]], wrappers: str, leading: str, shown: Callable[[Column], Column] = lambda ids: ids, salts: int = 8) -> DataFrame:
    """(question, place, name, ids, search): for each programme that a question names, in the order they are found, the ids of its active editions.

    catalog: course_id, name, title, is_active. A year in the question narrows the editions to those whose title has it, if any. The
    search text is the question without all that named a programme, the same for all of a question's scopes. shown: what is made of the ids.

    A name's list, and that of each year in its titles, is made once, however many questions get it; questions meet the lists sorted by name and year,
    dealt out by `salts`, so that equal lists come one after another and a name that all ask for isn't one task's.
    """
    found = E.scope_state(F.col(text), names, aliases)
    asked = questions.select(id_col, F.col(text).alias("q"), found.alias("s")).select(id_col, "q", E.search_text(F.col("q"), F.col("s.targets"), wrappers, leading).alias("search"), F.posexplode("s.found").alias("place", "name"))
    # A title holds a year wherever its four characters stand, so matches may overlap; the empty year stands for all editions.
    of_title = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all("title", F.lit(r"(?=(25\d{2}))"), F.lit(1))))
    editions = catalog.where("is_active").where(F.col("name").isin(names)).select("name", "course_id", F.explode(F.coalesce(of_title, F.array(F.lit("")))).alias("_year"))
    years = editions.groupBy("name").agg(F.collect_set("_year").alias("_years"))  # a hundred at most
    lists = editions.groupBy("name", "_year").agg(F.sort_array(F.collect_list("course_id")).alias("ids")).select("name", "_year", shown(F.col("ids")).alias("ids"))
    lists = lists.withColumn("_salt", F.explode(F.array(*[F.lit(k) for k in range(salts)])))
    year = F.regexp_extract("q", r"25\d{2}", 0)
    dealt = asked.join(years, "name").select(id_col, "place", "name", "search", F.when(F.array_contains("_years", year), year).otherwise("").alias("_year"), F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int").alias("_salt"))
    return dealt.join(lists.hint("merge"), ["name", "_year", "_salt"]).select(id_col, "place", "name", "ids", "search")


def compare_request(requests: DataFrame, request: str, ids: str, catalog: DataFrame, id_col: str, least: int = 2, most: int = 4) -> DataFrame:
    """(request, error, missing): what speaks against comparing the ids of a request: their number, or those that the catalogue doesn't have."""
    asked = requests.select(request, F.size(ids).alias("_n"), F.explode_outer(ids).alias(id_col))
    known = asked.join(catalog.select(id_col, F.lit(True).alias("_known")), id_col, "left")
    listed = known.groupBy(request, "_n").agg(F.sort_array(F.collect_set(F.when(F.col("_known").isNull(), F.col(id_col)))).alias("missing"))
    wrong_number = (F.col("_n") < least) | (F.col("_n") > most)
    return listed.select(request, F.when(wrong_number, "number").when(F.size("missing") > 0, "missing").alias("error"), "missing")


def compare(requests: DataFrame, request: str, ids: str, catalog: DataFrame, id_col: str, title: str, cells: DataFrame, dimensions: list[str], fees: DataFrame, none: str = "not found", no_fee: str = "no fee stated", **limits) -> DataFrame:
    """(request, error, missing, titles, place, dimension, values): a row for each dimension of each request that can be compared, the fee first, one row with the error for any other.

    catalog: ids and titles; cells: (id, dimension, cell), what the documents say; fees: (id, cell), which come from no search. titles and values follow the order in which
    the request names its programmes.
    """
    errors = compare_request(requests, request, ids, catalog, id_col, **limits)
    asked = requests.join(errors.where("error is null").select(request), request).select(request, F.posexplode(ids).alias("_at", id_col))
    named = asked.join(catalog.select(id_col, title), id_col).groupBy(request).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", title))), lambda x: x[title]).alias("titles"))
    wanted = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(d).alias("dimension"), F.lit(x).alias("_none")) for k, (d, x) in enumerate([("fee", no_fee), *[(d, none) for d in dimensions]])])
    told = fees.select(id_col, F.lit("fee").alias("dimension"), "cell").unionByName(cells.select(id_col, "dimension", "cell"))
    filled = asked.select(request, "_at", id_col, F.inline(wanted)).join(told, [id_col, "dimension"], "left").withColumn("cell", F.coalesce("cell", "_none"))
    rows = filled.groupBy(request, "place", "dimension").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "cell"))), lambda x: x["cell"]).alias("values"))
    return errors.join(named, request, "left").join(rows, request, "left").select(request, "error", "missing", "titles", "place", "dimension", "values")


def ingest(files: DataFrame, path: str, load: str, extract=None, embed=providers.embed, wrong: str = "", right: str = "", rules: list[tuple[str, str]] = (), **limits) -> int:
    """Files, as sources.ingest.read_files() describes them, to chunks with vectors, published as one load; returns its generation.

    A document is a content (its sha256), under the first of its paths; those that are done already aren't read again. Files that can't be read become failed
    documents with their errors, the others' chunks (document_id, path, chunk_index, page_number, content, token_count, embedding) are published all at once.
    """
    spark, keyed = files.sparkSession, files.withColumn("document_id", F.coalesce("sha256", "path"))
    first = keyed.groupBy("document_id").agg(F.min("path").alias("path"))
    todo = P.not_done(first, path)
    todo.write.mode("overwrite").parquet(f"{path}/begun/load={load}")  # as P.begin() does, with the paths
    todo = spark.read.parquet(f"{path}/begun/load={load}")
    # Contents move once to meet what is to be done (those that can't be read don't), pages once to meet their document's repeated lines; document_id and path go along as one key, so that chunks needn't move.
    usable = files.withColumn("content", F.when(F.col("reason").isNull(), F.col("content")))
    keyed = usable.join(todo.select("path", F.struct("document_id", "path").alias("document")).hint("merge"), "path")
    found = I.pages_and_errors(keyed, extract, ("document",))
    clean = clean_documents(found.where("error is null").drop("error"), "document", "page_text", wrong, right, list(rules), **limits)
    chunks = chunk_pages(clean, "document", "page_number", "page_text").withColumn("embedding", embed(F.col("content")))
    rows = chunks.unionByName(found.where("error is not null").select("document", "error"), allowMissingColumns=True)
    return P.publish(rows.select("document.*", "chunk_index", "page_number", "content", "token_count", "embedding", "error"), path, load, error="error", every=todo)


#: What ingest() publishes.
CHUNKS = "document_id string, path string, chunk_index int, page_number int, content string, token_count bigint, embedding array<float>"
