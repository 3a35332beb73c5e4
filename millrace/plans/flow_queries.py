"""Queries on the composed flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import conversations as C
from millrace.operators import flows
from millrace.operators import vectors as V
from millrace.plans import entity_queries as EQ
from millrace.plans import vector_queries as VQ
from millrace.plans.tables import COURSES, PAGES, courses, pages, table
from millrace.sources import ingest


def clean_documents(s, d):
    split = pages(s, d).withColumn("page_text", F.regexp_replace("page_text", r"[.,] ", "\n"))
    cleaned = flows.clean_documents(split, "doc_id", "page_text", "ßçñ$", "scn", [(r"(th) (e)", "$1$2")], share=0.3)
    return cleaned.select("doc_id", "page_number", F.sha2("page_text", 256).alias("sha"))


def match_programs(s, d):
    offered = courses(s, d).where("brand in ('Brand#1', 'Brand#2')").select("name").distinct()
    scores = VQ._ranked(VQ._first(s, d, 1), VQ._moved(s, d))  # of a name's editions the best is one of these
    found = flows.match(scores, offered, "name", "course_id", margin=0.04)
    return found.select("query_id", "rank", "course_id", "title", F.round("score", 4).alias("score"), "percent", "confidence")


def scope_ids(s, d):
    asked = EQ._questions(s, d).withColumn("q", F.concat_ws(" ", "q", F.when(F.col("q_id") % 3 == 0, F.concat(F.lit("25"), (F.lit(60) + F.col("q_id") % 10).cast("string")))))
    shown = lambda ids: F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")
    return flows.scopes(asked, "q_id", "q", courses(s, d), EQ.NAMES, EQ.ALIASES, "BOLT|GEAR", "Programme of", shown).select("q_id", "name", "ids")


def compare_missing(s, d):
    """Customers ask to compare some programmes by number; not all numbers exist."""
    key = F.col("c_custkey")
    ids = F.slice(F.array(key, key * 3, key + 1, key * 7, key * 11), F.lit(1), (key % 5 + 1).cast("int"))
    found = flows.compare_request(table(s, d, "customer").select("c_custkey", ids.alias("ids")), "c_custkey", "ids", courses(s, d), "course_id")
    return found.select("c_custkey", "error", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


def compare_flow(s, d):
    """Customers compare programmes of the ten groups by four dimensions, whose questions are the embeddings of the first four hundredth rows."""
    key = F.col("c_custkey")
    ids = F.slice(F.array(key % 12, key * 3 % 10, (key + 1) % 10, key * 7 % 10, key % 10), F.lit(1), (key % 5 + 1).cast("int"))
    asked = table(s, d, "customer").select("c_custkey", F.transform(ids, lambda x: x.cast("int")).alias("ids"))
    chunks = VQ.EMB(s, d)
    catalog = chunks.select(F.col("label").alias("course_id")).distinct().withColumn("title", F.concat(F.lit("Group "), F.col("course_id").cast("string")))
    questions = chunks.where("vec_id in (0, 100, 200, 300)").select(F.concat(F.lit("d"), (F.col("vec_id") / 100).cast("int").cast("string")).alias("query_id"), F.col("embedding").alias("q"))
    best = V.ranked_in(V.similarities(chunks, questions, 3, "label"), ["query_id", "label"], 3, [F.desc("score"), "vec_id"])
    cells = best.groupBy(F.col("label").alias("course_id"), F.col("query_id").alias("dimension")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"].cast("string")), ",").alias("cell"))
    fees = courses(s, d).where("course_id < 8").select(F.col("course_id").cast("int").alias("course_id"), F.format_number("fee", 0).alias("cell"))
    found = flows.compare(asked, "c_custkey", "ids", catalog, "course_id", "title", cells, ["d0", "d1", "d2", "d3"], fees)
    return found.select("c_custkey", "error", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"), F.array_join("titles", "|").alias("titles"), "place", "dimension", F.array_join("values", "|").alias("values"))


def appended_turns(s, d):
    """Each conversation's first question is asked again, and once more; customers whose numbers have no conversation start one."""
    talk = table(s, d, "conversations")
    known = C.sessions(talk, "conv_id", "turn", "role", "text").where("first_question is not null").select("conv_id", "first_question")
    again = known.select("conv_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("asked"), F.col("first_question").alias("question"))
    fresh = table(s, d, "customer").select(F.col("c_custkey").alias("conv_id")).join(talk.select("conv_id"), "conv_id", "left_anti")
    asked = again.unionByName(fresh.select("conv_id", F.lit(1).alias("asked"), F.lit("Which programme?").alias("question")))
    answered = asked.withColumn("answer", F.concat_ws(" ", F.lit("Answer"), F.col("asked").cast("string")))
    return C.appended_turns(talk, answered, "conv_id", "turn", "role", "text", "asked", "question", "answer")


def not_evaluated(s, d):
    return ingest.without_result(table(s, d, "documents"), table(s, d, "labels"), "doc_id").select("doc_id", "lang", "source")


QUERIES = {f.__name__: f for f in (clean_documents, match_programs, scope_ids, compare_missing, compare_flow, appended_turns, not_evaluated)}

_SPACE = "regexp_replace(regexp_replace(regexp_replace({0}, '(\\w)-\\n(\\w)', '\\1\\2', 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
_YEARS = EQ._QUESTIONS.replace("questions as (", "plain as (") + ", questions as (select q_id, concat_ws(' ', q, case when q_id % 3 = 0 then '25' || (60 + q_id % 10) end) as q from plain)"
ORACLES = {
    "clean_documents": PAGES + """, split as (select doc_id, page_number, nfc_normalize(regexp_replace(replace(translate(regexp_replace(page_text, '[.,] ', chr(10), 'g'), 'ßçñ', 'scn'), '$', ''), '(th) (e)', '\\1\\2', 'g')) as page_text from pages_of),
        l as (select distinct doc_id, page_number, trim(unnest(string_split(page_text, chr(10)))) as line from split),
        n as (select doc_id, count(*) as n_pages_all from split group by doc_id having count(*) >= 3),
        rep as (select doc_id, line, count(*) as n_pages from l where line <> '' and length(line) < 120 group by doc_id, line),
        found as (select rep.doc_id, line from rep join n using (doc_id) where n_pages >= greatest(2, floor(n_pages_all * 0.3::double))),
        parts as (select doc_id, page_number, unnest(string_split(page_text, chr(10))) as line, generate_subscripts(string_split(page_text, chr(10)), 1) as i from split),
        k as (select p.*, f.line is null as keep from parts p left join found f on f.doc_id = p.doc_id and f.line = trim(p.line)),
        j as (select doc_id, page_number, coalesce(string_agg(line, chr(10) order by i) filter (where keep), '') as t from k group by doc_id, page_number)
        select doc_id, page_number, sha256(trim(""" + _SPACE.format("t") + ", ' ' || chr(9) || chr(10) || chr(13))) as sha from j",
    "match_programs": VQ._RANKED + """, o as (select *, row_number() over (partition by query_id, name order by score desc, course_id) as one from pct where name in (select name from courses where brand in ('Brand#1', 'Brand#2'))),
        m as (select *, max(score) over (partition by query_id) as best from o where one = 1),
        r as (select *, row_number() over (partition by query_id order by score desc, course_id) as rank from m where score >= best - 0.04::double),
        c as (select query_id, case when count(*) >= 3 and max(percent) filter (where rank = 1) - max(percent) filter (where rank = 3) >= 10 then 'high' else 'low' end as confidence from r where rank <= 5 group by query_id)
        select query_id, cast(rank as int) as rank, course_id, title, round(score, 4) as score, percent, confidence from r join c using (query_id) where rank <= 5""",
    "scope_ids": _YEARS + ", " + EQ._SCOPES + """, x as (select q_id, unnest(found) as name from folded),
        y as (select q_id, nullif(regexp_extract(q, '25\\d{2}', 0), '') as year from questions),
        e as (select x.q_id, name, course_id, y.year is not null and contains(title, y.year) as fits from x join courses using (name) join y on y.q_id = x.q_id where is_active),
        f as (select *, bool_or(fits) over (partition by q_id, name) as any_fits from e)
        select q_id, name, string_agg(cast(course_id as varchar), ',' order by course_id) as ids from f where fits or not any_fits group by q_id, name""",
    "compare_missing": COURSES + """, a as (select c_custkey, list_slice([c_custkey, c_custkey * 3, c_custkey + 1, c_custkey * 7, c_custkey * 11], 1, c_custkey % 5 + 1) as ids from customer),
        u as (select c_custkey, len(ids) as n, unnest(ids) as course_id from a),
        m as (select c_custkey, n, string_agg(distinct course_id, ',' order by course_id) filter (where course_id not in (select course_id from courses)) as missing from u group by c_custkey, n)
        select c_custkey, case when n < 2 or n > 4 then 'number' when missing is not null then 'missing' end as error, coalesce(missing, '') as missing from m""",
    "compare_flow": COURSES + f""", a as (select c_custkey, list_slice([c_custkey % 12, c_custkey * 3 % 10, (c_custkey + 1) % 10, c_custkey * 7 % 10, c_custkey % 10], 1, c_custkey % 5 + 1) as ids from customer),
        u as (select c_custkey, len(ids) as n, unnest(ids) as course_id, generate_subscripts(ids, 1) as pos from a),
        g as (select distinct label as course_id from embeddings),
        er as (select c_custkey, n, string_agg(distinct course_id, ',' order by course_id) filter (where course_id not in (select course_id from g)) as missing from u group by c_custkey, n),
        er2 as (select c_custkey, case when n < 2 or n > 4 then 'number' when missing is not null then 'missing' end as error, coalesce(missing, '') as missing from er),
        ok as (select u.* from u join er2 using (c_custkey) where error is null),
        sc as (select 'd' || (q.vec_id // 100) as dimension, e.label, e.vec_id, round({VQ._COS.format("e.embedding", "q.embedding")}, 9) as score from embeddings e, embeddings q where q.vec_id in (0, 100, 200, 300)),
        rk as (select *, row_number() over (partition by dimension, label order by score desc, vec_id) as rn from sc),
        cell as (select label as course_id, dimension, string_agg(cast(vec_id as varchar), ',' order by rn) as cell from rk where rn <= 3 group by 1, 2
                 union all select course_id, 'fee', format('{{:,}}', fee) from courses where course_id < 8),
        dims(place, dimension, absent) as (values (0, 'fee', 'no fee stated'), (1, 'd0', 'not found'), (2, 'd1', 'not found'), (3, 'd2', 'not found'), (4, 'd3', 'not found')),
        f as (select c_custkey, place, dims.dimension, string_agg(coalesce(cell, absent), '|' order by pos) as "values", string_agg('Group ' || ok.course_id, '|' order by pos) as titles
              from ok cross join dims left join cell on cell.course_id = ok.course_id and cell.dimension = dims.dimension group by 1, 2, 3)
        select c_custkey, error, missing, titles, place, f.dimension, f."values" from er2 left join f using (c_custkey)""",
    "appended_turns": """with l as (select conv_id, max(turn) as last, arg_min(text, turn) filter (where role = 'user') as question from conversations group by conv_id),
        a as (select conv_id, last, asked, question from l, (values (1), (2)) v(asked) where question is not null
              union all select c_custkey, -1, 1, 'Which programme?' from customer where c_custkey not in (select conv_id from conversations))
        select conv_id, cast(last + 2 * asked - 1 as bigint) as turn, 'user' as role, question as text from a
        union all select conv_id, cast(last + 2 * asked as bigint), 'assistant', 'Answer ' || asked from a""",
    "not_evaluated": "select doc_id, lang, source from documents where doc_id not in (select doc_id from labels)",
}
