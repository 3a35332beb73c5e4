"""Queries on what is kept from run to run, each in a folder of its own, and on the rules around titles, names and prompts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.functions import assembly as A
from millrace.functions import providers
from millrace.functions import text as X
from millrace.operators import derived as D
from millrace.operators import entities as E
from millrace.operators import flows as L
from millrace.operators import gates as G
from millrace.plans.tables import COURSES, courses, table
from millrace.sources import ingest as I
from millrace.sources import publish as P
from millrace.sources.folders import shared_folder


def _folder(s, what: str) -> str:
    return f"{shared_folder(s)}/{what}-{uuid.uuid4().hex}"


def title_vectors(s, d):
    """The store knew four of five programmes, some by another title; the states of all, and the vectors after a refresh."""
    path, name = _folder(s, "titles"), E.distinctive_name(F.col("title"))
    old = F.when(F.col("course_id") % 7 == 1, F.concat("title", F.lit(" as it was"))).otherwise(F.col("title"))
    D.refresh(courses(s, d).where("course_id % 5 <> 0").withColumn("title", old), "course_id", name, path, "before", providers.embed, "stub-16")
    D.states(courses(s, d), "course_id", name, path, "stub-16").write.parquet(was := _folder(s, "title-states"))  # as they are before the refresh
    D.refresh(courses(s, d), "course_id", name, path, "now", providers.embed, "stub-16")
    now = D.vectors(courses(s, d), "course_id", name, path, "stub-16")
    return s.read.parquet(was).join(now, "course_id").select("course_id", "state", "fingerprint", F.size("vector").alias("dims"))


def publish_rows(s, d):
    """Documents in two loads, of which the second replaces some and fails at some, and a third that died before it was published."""
    path = _folder(s, "published")
    docs = table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    P.publish(docs.where("doc_id % 3 <> 0").withColumn("version", F.lit(1)), path, "a", "doc_id")
    bad = docs.where("doc_id % 4 = 2").select("doc_id", F.lit("ValueError: no pages").alias("error"))
    P.publish(docs.where("doc_id % 4 < 2").withColumn("version", F.lit(2)), path, "b", "doc_id", bad)
    P.begin(docs.where("doc_id % 2 = 0"), path, "c", "doc_id")
    docs.withColumn("version", F.lit(3)).write.parquet(f"{path}/rows/load=c")
    rows = P.published(s, path, "doc_id bigint, sha string, version int", "doc_id")
    return rows.join(P.statuses(s, path, "doc_id"), "doc_id", "full").select("doc_id", "sha", "version", "status", "error")


def ingest_files(s, d):
    """Documents as files, some of them not UTF-8, no PDF or of an unknown kind, loaded in two loads, the second of all; the status of each, its path and whether chunks of it are published."""
    path, odd = _folder(s, "ingested"), F.col("doc_id") % 7
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 11 == 4, ".exe").when(odd == 5, ".pdf").otherwise(".txt"))
    content = F.concat(F.when(odd == 3, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))), F.encode("text", "UTF-8"))
    files = table(s, d, "documents").select(name.alias("path"), content.alias("content"), "doc_id").withColumn("length", F.octet_length("content"))
    described = I.described(files.drop("doc_id"))
    L.ingest(described.where("path < 'doc-3'"), path, "first", share=0.6)
    L.ingest(described, path, "second", share=0.6)
    rows = P.published(s, path, L.CHUNKS).groupBy("document_id").agg(F.min("path").alias("path"), F.max(F.size("embedding")).alias("dims"))
    return P.statuses(s, path).join(rows, "document_id", "left").select("document_id", "path", "status", "error", "dims")


def unknown_characters(s, d):
    """Pages repaired and, in the same pass, what no repair is known for: here the characters that some languages write."""
    repaired, seen = X.repair_observed(table(s, d, "documents"), "text", "ßçñ", "scn", "ß-ÿ")
    repaired.select("doc_id", "text").write.parquet(_folder(s, "repaired"))
    return s.createDataFrame([(seen.get["unknown_pages"], seen.get["unknown"])], "unknown_pages long, unknown string")


_DEGREES = ["Programme of ", "Economy", "Promo", "field"]


def rationale_texts(s, d):
    """What a model wrote for each title: under the title, the title behind marks, a short form of it, or another programme's title."""
    key = F.element_at(F.array(F.col("title"), F.concat(F.lit("### "), "title"), F.regexp_replace("title", r"Programme of |field| \(.*", ""), F.lit("### Programme of Nothing")), (F.col("course_id") % 4 + 1).cast("int"))
    wrote = F.create_map(key, F.concat(F.lit("because of "), "name"))
    return courses(s, d).select("course_id", G.rationale_of(F.col("title"), wrote, E.rationale_key(_DEGREES)).alias("rationale"))


def short_titles(s, d):
    return courses(s, d).select("course_id", E.short_title(F.col("title")).alias("short"), E.edition_year(F.col("title")).alias("year"))


_TALK = lambda s, d: table(s, d, "conversations")


def text_without_names(s, d):
    return _TALK(s, d).select("conv_id", "turn", E.without_names(F.col("text"), ["the", "and the", "der"], ["of", "ä"]).alias("rest"))


def unknown_names(s, d):
    return _TALK(s, d).where("role = 'user'").select("conv_id", "turn", E.unknown_name(F.lower("text"), "the", "of|in|and", ["heonha"], prefixes=("that", "er"), asks=("on",)).alias("named"))


def needs_programme(s, d):
    named = E.mentions(F.col("text"), F.col("role"), ["reon", "esen", "heit"], "of ")
    return _TALK(s, d).where("role = 'user'").select("conv_id", "turn", G.needs_programme(F.col("text"), ["tz", "rou ", "edha"], named).alias("needs"))


def chat_prompt(s, d):
    """The user's turns as prompts: the conversation so far and the question, as content that is no instruction."""
    shown = F.when(F.col("conv_id") % 3 > 0, F.concat(F.lit("</question>"), "text")).otherwise(F.col("text"))
    asked = F.when(F.col("turn") > 0, F.concat(F.lit("turn "), F.col("turn").cast("string")))
    return _TALK(s, d).where("role = 'user'").select("conv_id", "turn", A.prompt("Answer from the documents alone.", [("history", asked), ("question", shown)], "Answer in the question's language.").alias("prompt"))


QUERIES = {f.__name__: f for f in (title_vectors, publish_rows, ingest_files, unknown_characters, rationale_texts, short_titles, text_without_names, unknown_names, needs_programme, chat_prompt)}

_SORTED = lambda ws: "|".join(sorted(ws, key=lambda w: (-len(w), w)))
_ALONE = lambda x, a: f"regexp_replace(regexp_replace({x}, '(^|[^a-z0-9]){a}($|[^a-z0-9])', '\\1 \\2', 'g'), '(^|[^a-z0-9]){a}($|[^a-z0-9])', '\\1 \\2', 'g')"
ORACLES = {
    "title_vectors": COURSES + """ select course_id, case when course_id % 5 = 0 then 'new' when course_id % 7 = 1 then 'stale' else 'unchanged' end as state, sha256('stub-16' || chr(10) || name) as fingerprint, 16 as dims from courses""",
    "publish_rows": """select doc_id, case when doc_id % 4 < 2 or doc_id % 3 <> 0 then sha256(text) end as sha, case when doc_id % 4 < 2 then 2 when doc_id % 3 <> 0 then 1 end as version,
            case when doc_id % 4 < 2 or doc_id % 3 <> 0 then 'done' when doc_id % 4 = 2 then 'failed' when doc_id % 2 = 0 then 'processing' end as status,
            case when doc_id % 4 = 2 and doc_id % 3 = 0 then 'ValueError: no pages' end as error
        from documents where doc_id % 4 < 3 or doc_id % 3 <> 0""",
    "ingest_files": """with f as (select 'doc-' || doc_id || case when doc_id % 11 = 4 then '.exe' when doc_id % 7 = 5 then '.pdf' else '.txt' end as path, doc_id % 7 = 3 as broken, text,
            case when doc_id % 7 = 3 then unhex('FF') || encode(text) else encode(text) end as content from documents),
        g as (select sha256(content) as document_id, broken, any_value(text) as text, min(path) filter (where path < 'doc-3') as before, min(path) as path0 from f group by 1, 2),
        p as (select document_id, broken, text, before, path0, coalesce(before, path0) as path from g),
        q as (select *, case when ends_with(path, '.exe') then 'unknown kind' when ends_with(path, '.pdf') and not starts_with(text, '%PDF-') then 'not a PDF' when broken then 'UnicodeDecodeError: ''utf-8'' codec can''t decode byte 0xff in position 0: invalid start byte'
            when trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' then 'ValueError: no pages' end as error from p)
        select document_id, case when error is null and length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) >= 20 then path end as path, case when error is null then 'done' else 'failed' end as status, error,
               case when error is null and length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) >= 20 then 16 end as dims from q""",
    "unknown_characters": """with c as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '[ß-ÿ]'))) as c from documents), u as (select * from c where c not in ('ß', 'ç', 'ñ'))
        select count(distinct doc_id) as unknown_pages, coalesce((select string_agg('U+' || lpad(upper(to_hex(unicode(c))), 4, '0'), ', ' order by c) from (select distinct c from u)), '') as unknown from u""",
    "rationale_texts": COURSES + " select course_id, case when course_id % 4 < 3 then 'because of ' || name else '' end as rationale from courses",
    "short_titles": COURSES + " select course_id, name as short, cast(year as int) as year from courses",
    "text_without_names": f"""with l as (select conv_id, turn, replace(replace(replace(lower(text), 'and the', ' '), 'der', ' '), 'the', ' ') as t from conversations)
        select conv_id, turn, replace({_ALONE("t", "of")}, 'ä', ' ') as rest from l""",
    "unknown_names": """with t as (select conv_id, turn, lower(text) as t from conversations where role = 'user'),
        f as (select *, trim(regexp_replace(regexp_extract(t, '(?i)the\\s+([^?.,\\n]+)', 1), '(?i)(^|\\s+)(of|in|and)\\b.*$', '')) as found from t),
        b as (select *, case when regexp_matches(found, '^(((that)|(er))\\b\\s*)+\\S') then trim(regexp_replace(found, '(?i)^(((that|er)\\b\\s*)+)(\\S)', '\\4')) else found end as bare from f)
        select conv_id, turn, case when length(bare) >= 4 and bare not in ('that', 'er') and not contains(t, 'heonha') and not regexp_matches(lower(found), '^(on)\\b') then bare end as named from b""",
    "needs_programme": """select conv_id, turn, (contains(lower(text), 'tz') or contains(lower(text), 'rou ') or contains(lower(text), 'edha')) and not (contains(lower(text), 'reon') or contains(lower(text), 'esen') or contains(lower(text), 'heit')) as needs
        from conversations where role = 'user'""",
    "chat_prompt": """select conv_id, turn, 'Answer from the documents alone.' || chr(10) || chr(10) || case when turn > 0 then '<history>' || chr(10) || 'turn ' || turn || chr(10) || '</history>' || chr(10) || chr(10) else '' end
            || '<question>' || chr(10) || text || chr(10) || '</question>' || chr(10) || chr(10) || 'Answer in the question''s language.' as prompt from conversations where role = 'user'""",
}
