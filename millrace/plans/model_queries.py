"""Queries on model calls, with stubs whose answers depend on the input alone, and on what is made of models' verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import providers as M
from millrace.operators import gates as G
from millrace.plans.store_queries import _folder
from millrace.plans.tables import table
from millrace.sources import ingest as I

TALK = lambda s, d: table(s, d, "conversations")


class UsedUp(M.Stub):
    """A model whose daily quota is used up."""

    def chat(self, prompt: str) -> str:
        raise M.QuotaUsed(True)


def fallback_replies(s, d):
    """Replies of the second model, as the first one refuses."""
    reply = M.chat(F.col("text"), lambda: M.Fallback({"main": UsedUp(), "second": M.Stub()}))
    return TALK(s, d).where("role = 'user'").select("conv_id", "turn", reply.alias("reply"))


def recognised_pages(s, d):
    """Pages as images: a first run recognises some of them, a second one the rest."""
    sink = _folder(s, "recognised")
    images = table(s, d, "pages").select(F.concat(F.lit("f"), F.floor(F.col("page_id") / 10).cast("string")).alias("file"), (F.col("page_id") % 10).cast("int").alias("page"), F.encode("html", "UTF-8").alias("image"))
    M.recognise_pages(images.where("page < 4"), sink)
    return M.recognise_pages(images, sink)


def file_checks(s, d):
    """Documents as files, with why some can't be used."""
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 1, ".PDF").when(F.col("doc_id") % 5 == 2, ".docx").otherwise(".txt"))
    content = F.encode(F.concat(F.when(F.col("doc_id") % 10 == 1, "%PDF-1.7").otherwise(""), F.col("text")), "UTF-8")
    files = table(s, d, "documents").select(name.alias("path"), content.alias("content")).withColumn("length", F.octet_length("content"))
    return I.described(files).select("path", "sha256", "kind", "reason")


def json_dimension(s, d):
    """A small table written as one JSON array and read again by its schema."""
    path = _folder(s, "dimension")
    table(s, d, "nation").agg(F.to_json(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value")).coalesce(1).write.text(path)  # 25 nations
    return I.read_json_dimension(s, path, "n_nationkey int, n_name string")


def recommended_by(s, d):
    """What a recommendation is made by: what a model took from the text, if the text has it."""
    taken = F.when(F.col("conv_id") % 3 == 0, F.replace(F.substring("text", 3, 14), F.lit(" "), F.lit("  "))).when(F.col("conv_id") % 3 == 1, " ").otherwise("nothing of the kind")
    wanted = F.when(F.col("turn") % 5 < 4, F.col("turn") % 3 != 1)
    found = G.recommendation(F.col("text"), F.col("text").contains("dor"), wanted, taken, F.col("text").contains("heit"))
    return TALK(s, d).select("conv_id", "turn", found.alias("interest"))


def support_split(s, d):
    """Conversations as sets of results, their turns as rationales."""
    said = F.when(F.col("turn") % 4 == 0, " ").when(F.col("text").contains("reon"), F.concat(F.lit("no ground for "), "text")).otherwise(F.col("text"))
    rows = TALK(s, d).withColumn("kind", G.support(said, ["no ground"]))
    return G.support_of(rows, ["conv_id"], "kind")


def compare_points(s, d):
    """Parts as programmes, some with values that aren't stated."""
    cells = F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("value")) for k, v in (("name", F.col("p_name")), ("brand", F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand"))), ("size", F.when(F.col("p_size") < 40, F.col("p_size").cast("string")).otherwise("not stated")), ("type", F.col("p_type")))])
    rows = table(s, d, "part").select("p_partkey", F.inline(cells))
    return G.as_points(rows, "p_partkey", "dimension", "value", ["type", "size", "brand"], "not stated").select("p_partkey", F.array_join("points", "|").alias("points"))


QUERIES = {f.__name__: f for f in (fallback_replies, recognised_pages, file_checks, json_dimension, recommended_by, support_split, compare_points)}

ORACLES = {
    "fallback_replies": """select conv_id, turn, '{"items": [], "seen": ' || length(text) || '}' as reply from conversations where role = 'user'""",
    "recognised_pages": "select 'f' || page_id // 10 as file, cast(page_id % 10 as int) as page, left(sha256(html), 8) as text, cast(null as varchar) as error from pages",
    "file_checks": """with f as (select 'doc-' || doc_id || case doc_id % 5 when 1 then '.PDF' when 2 then '.docx' else '.txt' end as path, case when doc_id % 10 = 1 then '%PDF-1.7' else '' end || text as t, case doc_id % 5 when 1 then 'pdf' when 2 then 'docx' else 'txt' end as kind from documents)
        select path, sha256(t) as sha256, kind, case when kind = 'docx' then 'unknown kind' when kind = 'pdf' and not starts_with(t, '%PDF-') then 'not a PDF' end as reason from f""",
    "json_dimension": "select n_nationkey, n_name from nation",
    "recommended_by": """with t as (select conv_id, turn, text, case conv_id % 3 when 0 then replace(substr(text, 3, 14), ' ', '  ') when 1 then ' ' else 'nothing of the kind' end as taken from conversations),
        i as (select *, case when contains(regexp_replace(text, '\\s+', '', 'g'), regexp_replace(taken, '\\s+', '', 'g')) and trim(taken) <> '' then taken else text end as best from t)
        select conv_id, turn, case when not contains(text, 'dor') and turn % 5 < 4 and turn % 3 <> 1 and not contains(text, 'heit') then best end as interest from i""",
    "support_split": """with k as (select conv_id, case when turn % 4 = 0 then 'empty' when contains(text, 'reon') or contains(text, 'no ground') then 'unsupported' when trim(text) = '' then 'empty' else 'supported' end as kind from conversations),
        c as (select conv_id, count(*) as n, count(*) filter (where kind = 'supported') as supported, count(*) filter (where kind = 'unsupported') as unsupported, count(*) filter (where kind = 'empty') as empty from k group by conv_id)
        select conv_id, case when supported = n then 'all_supported' when empty = n then 'none_explained' when supported = 0 then 'none_supported' else 'mixed' end as whole, supported, unsupported, empty from c""",
    "compare_points": """select p_partkey, concat_ws('|', p_type, case when p_size < 40 then cast(p_size as varchar) end, case when p_partkey % 3 > 0 then p_brand end) as points from part""",
}
