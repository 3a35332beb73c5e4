"""Queries on sources, text repair and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators.chunks import chunk_pages, repeated_lines, without_repeated_lines
from millrace.plans.tables import PAGES, pages, table
from millrace.sources import ingest as I

DOCS = lambda s, d: table(s, d, "documents")


def page_split(s, d):
    return pages(s, d)


def manifest_join(s, d):
    files = DOCS(s, d).select("doc_id", F.concat(F.lit("file-"), F.col("doc_id").cast("string")).alias("stem"))
    titles = table(s, d, "benchmark").select(F.concat(F.lit("file-"), F.col("item_id").cast("string")).alias("stem"), F.col("text").alias("title"))
    return I.with_manifest(files, "stem", titles, "stem", "title")


def sparse_pages(s, d):
    return I.sparse_pages(DOCS(s, d).join(table(s, d, "labels"), "doc_id"), "text", "toxic").select("doc_id", F.length("text").cast("long").alias("n"))


def overlay_text(s, d):
    found = table(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("more"))
    return I.overlay_text(DOCS(s, d).select("doc_id", "text"), found, ["doc_id"], "text", "more", "the the").select("doc_id", F.sha2("text", 256).alias("sha"), F.length("text").cast("long").alias("n"))


def _hashed(s, d):
    return DOCS(s, d).select("doc_id", "source", F.sha2("text", 256).alias("sha256"))


def _done(s, d):
    return _hashed(s, d).join(table(s, d, "labels"), "doc_id").select("doc_id", "sha256", F.when(F.col("quality") == 1, "done").otherwise("failed").alias("status"))


def ingest_anti(s, d):
    return I.not_ingested(_hashed(s, d), _done(s, d)).select("doc_id", "sha256")


def get_or_create(s, d):
    existing = table(s, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("source"), F.col("s_suppkey").cast("string").alias("course_id"))
    return I.get_or_create(DOCS(s, d), existing, "source", "course_id", F.substring(F.sha2("source", 256), 1, 12))


def upsert_docs(s, d):
    stored = _done(s, d).withColumn("title", F.lit("old"))  # a label says that a document is stored, and how that went
    incoming = DOCS(s, d).select("doc_id", F.lit("new").alias("title"))
    return I.upsert_unless_done(stored, incoming, "doc_id", ["title"])


def char_repair(s, d):
    return DOCS(s, d).select("doc_id", F.sha2(X.repair_characters(F.col("text"), "ßçñ$", "scn"), 256).alias("sha"))


_SEQUENCES = [(r"é(a)", "$1́"), (r"(th) (e)", "$1$2"), (r"\|\s*", "; ")]


def seq_repair(s, d):
    return DOCS(s, d).select("doc_id", F.sha2(X.repair_sequences(F.col("text"), _SEQUENCES), 256).alias("sha"))


def ctrl_strip(s, d):
    marked = F.concat(F.col("text"), F.lit("\x01é\x1f\tx"))
    return DOCS(s, d).select("doc_id", F.sha2(X.strip_controls(X.nfc(marked)), 256).alias("sha"))


def ws_normalize(s, d):
    broken = F.regexp_replace(F.col("text"), r"\. ", ".  \t")
    broken = F.regexp_replace(F.regexp_replace(broken, r"tion", "ti-\non"), r"\n", "\n\n")
    return DOCS(s, d).select("doc_id", F.sha2(X.normalise_space(broken), 256).alias("sha"))


def repeated_lines_query(s, d):
    return repeated_lines(pages(s, d).withColumn("page_text", F.regexp_replace("page_text", r"[.,] ", "\n")), "doc_id", "page_text", share=0.3)


def strip_repeated(s, d):
    split = pages(s, d).withColumn("page_text", F.regexp_replace("page_text", r"[.,] ", "\n"))
    return without_repeated_lines(split, "doc_id", "page_text", share=0.3).select("doc_id", "page_number", F.sha2("page_text", 256).alias("sha"))


def chunk_documents(s, d):
    docs = DOCS(s, d).select("doc_id", F.lit(1).alias("page_number"), "text")
    return chunk_pages(docs, "doc_id", "page_number", "text").withColumn("token_count", F.col("token_count"))


def token_estimate(s, d):
    return DOCS(s, d).select("doc_id", X.token_estimate(F.col("text"), "a-m").alias("tokens"))


def toc_filter(s, d):
    listed = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", r"\. ", " ....... 12 ")).when(F.col("doc_id") % 3 == 1, F.regexp_replace("text", r"e ", " 8.1 ")).otherwise(F.regexp_replace("text", r"[eun] ", " 14. "))
    return DOCS(s, d).select("doc_id", X.looks_like_contents(listed).alias("contents"))


def script_detect(s, d):
    return DOCS(s, d).select("doc_id", X.has_script(F.col("text"), "ßäöü").alias("german"))


def session_title(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", X.short_title(F.col("text")).alias("title"))


def question_key(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", X.question_key(F.col("text")).alias("key"))


QUERIES = {
    f.__name__: f
    for f in (page_split, manifest_join, sparse_pages, overlay_text, ingest_anti, get_or_create, upsert_docs, char_repair, seq_repair, ctrl_strip, ws_normalize, strip_repeated, chunk_documents, token_estimate, toc_filter, script_detect, session_title, question_key)
} | {"repeated_lines": repeated_lines_query}

_HASHED = "with h as (select doc_id, source, sha256(text) as sha256 from documents), done as (select doc_id, sha256, case when quality = 1 then 'done' else 'failed' end as status from h join labels using (doc_id))"
_TRIM = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"
_LINES = PAGES + """, split as (select doc_id, page_number, regexp_replace(page_text, '[.,] ', chr(10), 'g') as page_text from pages_of),
     l as (select distinct doc_id, page_number, trim(unnest(string_split(page_text, chr(10)))) as line from split),
     n as (select doc_id, count(*) as n_pages_all from split group by doc_id having count(*) >= 3),
     rep as (select doc_id, line, count(*) as n_pages from l where line <> '' and length(line) < 120 group by doc_id, line),
     found as (select rep.doc_id, line, n_pages from rep join n using (doc_id) where n_pages >= greatest(2, floor(n_pages_all * 0.3::double)))"""
ORACLES = {
    "page_split": PAGES + " select * from pages_of",
    "manifest_join": "select doc_id, 'file-' || doc_id as stem, coalesce(b.text, 'file-' || doc_id) as title from documents d left join benchmark b on b.item_id = d.doc_id",
    "sparse_pages": "select doc_id, length(text) as n from documents join labels using (doc_id) where length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < 200 and toxic > 0",
    "overlay_text": """with o as (select d.doc_id, case when length(trim(b.text)) > 0 and not contains(b.text, 'the the') then d.text || chr(10) || b.text else d.text end as t
        from documents d left join benchmark b on b.item_id = d.doc_id) select doc_id, sha256(t) as sha, length(t) as n from o""",
    "ingest_anti": _HASHED + " select doc_id, sha256 from h where sha256 not in (select sha256 from done where status = 'done')",
    "get_or_create": """with w as (select distinct source from documents), e as (select 'src' || s_suppkey as source, cast(s_suppkey as varchar) as course_id from supplier where s_acctbal > 0)
        select source, coalesce(course_id, left(sha256(source), 12)) as course_id, course_id is null as created from w left join e using (source)""",
    "upsert_docs": _HASHED + """, st as (select doc_id, status, 'old' as title from done), inc as (select doc_id, 'new' as title from documents)
        select coalesce(st.doc_id, inc.doc_id) as doc_id, case when inc.doc_id is null or status = 'done' then st.title else inc.title end as title,
               case when inc.doc_id is null or status = 'done' then status else 'processing' end as status,
               case when status is null then 'insert' when inc.doc_id is null or status = 'done' then 'keep' else 'update' end as action
        from st full join inc on st.doc_id = inc.doc_id""",
    "char_repair": "select doc_id, sha256(replace(translate(text, 'ßçñ', 'scn'), '$', '')) as sha from documents",
    "seq_repair": "select doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, 'é(a)', '\\1́', 'g'), '(th) (e)', '\\1\\2', 'g'), '\\|\\s*', '; ', 'g')) as sha from documents",
    "ctrl_strip": "select doc_id, sha256(regexp_replace(nfc_normalize(text || chr(1) || 'e' || chr(769) || chr(31) || chr(9) || 'x'), '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) as sha from documents",
    "ws_normalize": """with b as (select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\. ', '.  ' || chr(9), 'g'), 'tion', 'ti-' || chr(10) || 'on', 'g'), chr(10), chr(10) || chr(10), 'g') as t from documents),
        c as (select doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(\\w)-\\n(\\w)', '\\1\\2', 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') as t from b)
        select doc_id, sha256(trim(t, ' ' || chr(9) || chr(10) || chr(13))) as sha from c""",
    "repeated_lines": _LINES + " select * from found",
    "strip_repeated": _LINES + """, parts as (select doc_id, page_number, unnest(string_split(page_text, chr(10))) as line, generate_subscripts(string_split(page_text, chr(10)), 1) as i from split),
        k as (select p.*, f.line is null as keep from parts p left join found f on f.doc_id = p.doc_id and f.line = trim(p.line))
        select doc_id, page_number, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where keep), '')) as sha from k group by doc_id, page_number""",
    "chunk_documents": """with b as (select doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as t from documents),
        w as (select doc_id, t, unnest(range(0, 1 + greatest(0, cast(ceil((length(t) - 1000) / 850.0) as bigint)))) as k from b where length(t) > 0),
        x as (select *, substr(t, k * 850 + 1, 1000) as piece, length(t) > k * 850 + 1000 as cut from w),
        c as (select doc_id, k, trim(case when cut and contains(substr(piece, 881, 120), ' ') then left(piece, 1000 - instr(reverse(piece), ' ')) else piece end, ' ' || chr(9) || chr(10) || chr(13)) as content from x)
        select doc_id, cast(row_number() over (partition by doc_id order by k) - 1 as int) as chunk_index, 1 as page_number, content, cast(round_even(length(content) / 4.0, 0) as bigint) as token_count from c where length(content) >= 20""",
    "token_estimate": "select doc_id, cast(round_even(length(regexp_replace(text, '[^a-m]', '', 'g')) / 2.0 + (length(text) - length(regexp_replace(text, '[^a-m]', '', 'g'))) / 4.0, 0) as bigint) as tokens from documents",
    "toc_filter": """with t as (select doc_id, case doc_id % 3 when 0 then regexp_replace(text, '\\. ', ' ....... 12 ', 'g') when 1 then regexp_replace(text, 'e ', ' 8.1 ', 'g') else regexp_replace(text, '[eun] ', ' 14. ', 'g') end as x from documents),
        w as (select doc_id, x, list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y <> '') as ws from t)
        select doc_id, len(ws) > 0 and (len(regexp_extract_all(x, '[.…]{5,}')) >= 3 or len(list_filter(ws, lambda y: regexp_matches(trim(y, '.…'), '^[0-9]+$'))) / greatest(len(ws), 1) >= 0.33) as contents from w""",
    "script_detect": "select doc_id, regexp_matches(text, '[ßäöü]') as german from documents",
    "session_title": """with l as (select conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) as t from conversations)
        select conv_id, turn, case when t = '' then 'New conversation' when length(t) <= 60 then t else rtrim(left(t, 59)) || '…' end as title from l""",
    "question_key": "select conv_id, turn, case when length(text) <= 300 then nullif(lower(regexp_replace(text, '[\\s\\x{200B}?!.,;:\"''()\\[\\]{}\\-–—]+', '', 'g')), '') end as key from conversations",
}
