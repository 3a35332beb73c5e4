"""Queries on conversations, routing, state, listings and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import assembly as A
from millrace.functions.text import question_key as key_of
from millrace.operators import conversations as C
from millrace.operators import entities as E
from millrace.operators import gates as G
from millrace.operators.vectors import ranked_in
from millrace.plans.tables import COURSES, courses, table
from millrace.streaming import state as S

TALK = lambda s, d: table(s, d, "conversations")


def session_list(s, d):
    listed = C.sessions(TALK(s, d), "conv_id", "turn", "role", "text")
    return C.page_of(listed, [F.desc("last_at"), "conv_id"], 10, 20).select("conv_id", "n_messages", "last_at", "first_question")


def session_total(s, d):
    return TALK(s, d).agg(F.countDistinct("conv_id").alias("total")).select("total", (F.col("total") > 30).alias("has_more"))


def corpus_version(s, d):
    return C.corpus_version(table(s, d, "documents"), "doc_id", 25, "v3")


def last_n_turns(s, d):
    return C.last_turns(TALK(s, d), "conv_id", "turn", 6).select("conv_id", "turn", "place", "role")


def ordered_turns(s, d):
    pairs = TALK(s, d).withColumn("pair", F.floor(F.col("turn") / 2))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("pair", C.role_order(F.col("role")), "turn"))
    return pairs.select("conv_id", "turn", "role", place.alias("place"))


def newest_edition_list(s, d):
    return courses(s, d).where("is_active").groupBy("level", "name").agg(F.max("title").alias("title"))


def latest_edition(s, d):
    return ranked_in(courses(s, d), "name", 1, [F.desc("year"), "course_id"]).select("name", "year", "course_id")


def program_list(s, d):
    offered = courses(s, d).where("brand in ('Brand#1', 'Brand#2', 'Brand#3')").select("name").distinct()
    listed = courses(s, d).where("is_active").join(offered, "name", "left_semi").select("level", "name").distinct()
    return listed.groupBy("level").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), "\n- ").alias("names"))


def priority_text(s, d):
    """Orders as a customer's requirements: the most urgent first, then as they came."""
    needs = table(s, d, "orders").select("o_custkey", "o_orderkey", (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), F.concat_ws(": ", "o_orderstatus", "o_orderpriority").alias("need"))
    listed = F.sort_array(F.collect_list(F.struct((-F.col("priority")).alias("p"), "o_orderkey", "need")))
    return needs.groupBy("o_custkey").agg(F.array_join(F.transform(listed, lambda x: x["need"]), "; ").alias("needs"))


def dedupe_first(s, d):
    return ranked_in(table(s, d, "lineitem"), ["l_partkey", "l_suppkey"], 1, [F.desc("l_quantity"), "l_orderkey", "l_linenumber"]).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


def course_page(s, d):
    return C.page_of(courses(s, d).select("course_id", "title"), ["course_id"], 100, 50)


def context_entity(s, d):
    found = E.mentions(F.col("text"), F.col("role"), ["ing", "der ", "que ", "para"], "of ")
    return C.context_entity(TALK(s, d).withColumn("found", found), "conv_id", "turn", "found")


def refined_questions(s, d):
    factual = F.col("text").rlike("^[A-M]")
    return C.refined_question(TALK(s, d), "conv_id", "turn", "role", "text", "the", factual).select("conv_id", "turn", "refined")


def catalog_search(s, d):
    return courses(s, d).where(F.lower(F.concat_ws(" ", "title", "level", "brand")).contains("blue g")).select("course_id", "title")


def known_names(s, d):
    return courses(s, d).select(E.distinctive_name(F.col("title")).alias("name")).distinct().where(F.length("name") >= 9).orderBy("name")


def _replies(s, d):
    status = F.element_at(F.array(*[F.lit(x) for x in ("answered", "answered", "not_found", "out_of_scope", "answered", "small_talk")]), (F.col("turn") % 6 + 1).cast("int"))
    return TALK(s, d).where("role = 'assistant'").select("conv_id", "turn", "text", status.alias("status"))


def reply_class(s, d):
    return _replies(s, d).select("conv_id", "turn", G.reply_class(F.col("text"), F.col("status"), ["ing th", "der "], ["est ", "est."]).alias("got"))


def eval_tally(s, d):
    rows = _replies(s, d).select((F.col("conv_id") % 5).alias("grp"), F.col("status").alias("expect"), G.reply_class(F.col("text"), F.col("status"), ["ing th", "der "], ["est ", "est."]).alias("got"))
    hit = F.when(F.col("expect") == F.col("got"), 1).otherwise(0)
    return rows.groupBy("grp").agg(F.sum(hit).alias("hits"), F.count("*").alias("n"), F.sum(F.when(F.col("got") == "hallucinated", 1).otherwise(0)).alias("hallucinated"))


def match_eval(s, d):
    """Profiles are customers, programmes nations ranked by a score; the expected one is the customer's own."""
    cases = table(s, d, "customer").select("c_custkey", "c_nationkey")
    scored = cases.join(table(s, d, "nation"), F.pmod(F.col("n_nationkey") - F.col("c_nationkey"), F.lit(25)) < 6).withColumn("score", F.pmod(F.col("n_nationkey") * 37 + F.col("c_custkey") * 11, F.lit(101)).cast("int"))
    top = ranked_in(scored, "c_custkey", 3, [F.desc("score"), "n_nationkey"])
    case = top.groupBy("c_custkey").agg(F.max(F.when((F.col("rank") == 1) & (F.col("n_nationkey") == F.col("c_nationkey")), 1).otherwise(0)).alias("top1"), F.max(F.when(F.col("n_nationkey") == F.col("c_nationkey"), 1).otherwise(0)).alias("top3"), (F.max(F.when(F.col("rank") == 1, F.col("score"))) - F.max(F.when(F.col("rank") == 3, F.col("score")))).alias("gap"))
    return case.groupBy("top1").agg(F.count("*").alias("cases"), F.sum("top3").alias("top3"), F.round(F.avg("gap"), 6).alias("mean_gap"))


def offered_missing(s, d):
    wanted = table(s, d, "part").select(F.concat_ws(" ", F.initcap("p_name"), F.when(F.col("p_partkey") % 2 == 0, "")).alias("name")).distinct()
    return wanted.join(courses(s, d).select("name").distinct(), "name", "left_anti")


def profile_query_text(s, d):
    parts = [A.labelled("segment: ", F.nullif("c_mktsegment", F.lit("BUILDING"))), A.labelled("balance: ", F.when(F.col("c_acctbal") > 5000, F.lit("high"))), A.labelled("likes: ", A.joined(F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("a"), "c_name"))))]
    return table(s, d, "customer").select("c_custkey", A.profile_text(parts).alias("q"))


def match_query_text(s, d):
    wish = F.concat(F.lit("please find "), F.when(F.col("c_custkey") % 4 > 0, F.lower("c_mktsegment")).otherwise(F.lit("")))
    parts = [A.labelled("enjoys ", A.joined(F.when(F.col("c_nationkey") > 12, F.array("c_mktsegment", "c_name")))), A.without_prefixes(F.trim(wish), "please find")]
    return table(s, d, "customer").select("c_custkey", A.profile_text(parts, " ").alias("q"))


def context_block(s, d):
    rows = ranked_in(TALK(s, d), "conv_id", 3, ["turn"]).withColumn("line", F.format_string("[%s #%d] %s", "role", "turn", "text"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("block"))


def fee_text(s, d):
    weekend = F.when(F.col("course_id") % 2 == 0, F.col("fee") + 1500)
    return courses(s, d).select("course_id", A.fee_text(F.col("fee"), weekend).alias("fee"))


_EXACT, _HINTS = {"greeting": ["hello", "hi"], "thanks": ["thanks", "thank you"], "bye": ["bye"]}, ["who are you", "what can you do"]


def small_talk(s, d):
    said = F.element_at(F.array(*[F.lit(x) for x in ("Hello!", "hi there", " Thanks. ", "bye ?", "So, who are you?", "hello, I want to ask about the blue bolt")]), (F.col("event_id") % 6 + 1).cast("int"))
    return table(s, d, "events").select("event_id", G.small_talk(said, _EXACT, _HINTS).alias("kind"))


def _gated(s, d):
    return table(s, d, "events").select("event_id", (F.col("value") / 100).alias("best"), (F.col("user_id") % 3 == 0).alias("named"), F.when(F.col("user_id") % 5 > 0, F.col("user_id") % 2 == 0).alias("in_scope"), F.when(F.col("user_id") % 7 > 0, F.col("event_id") % 4 > 0).alias("answerable"))


def scope_gate(s, d):
    return _gated(s, d).select("event_id", G.scope_gate(*[F.col(c) for c in ("best", "named", "in_scope", "answerable")]).alias("status"))


def route_questions(s, d):
    low = F.lower("text")
    rules = [("small_talk", F.length("text") < 12), ("list", G.contains_any(low, ["the and", "les des"])), ("fee", G.contains_any(F.col("text"), ["ing.", "tion."])), ("which_programme", low.rlike("^(the|of)") & (F.col("turn") > 2))]
    return TALK(s, d).where("role = 'user'").select("conv_id", "turn", G.route(rules, "search").alias("route"))


def validate_output(s, d):
    """Events' replies as a model's JSON: some malformed, with unknown ids, scores out of range or no number."""
    score = F.element_at(F.array(*[F.lit(x) for x in ('"abc"', "1.7", "-1", "0.25", "null")]), (F.col("event_id") % 5 + 1).cast("int"))
    raw = F.when(F.col("event_id") % 11 == 0, F.lit("{oops")).otherwise(F.concat(F.lit('{"items": [{"course_id": "'), F.col("user_id").cast("string"), F.lit('", "score": '), score, F.lit(', "rationale": "'), F.repeat(F.lit("r"), F.col("event_id").cast("int") % 30), F.lit('", "cited_chunk_ids": ["c1", "x"]}, {"course_id": "1", "score": 0.5}, {"course_id": "2"}]}')))
    allowed = F.transform(F.sequence(F.lit(1), F.lit(75)), lambda x: x.cast("string"))
    items = table(s, d, "events").select("event_id", F.posexplode(G.validated_items(raw, allowed, F.array(F.lit("c1"), F.lit("c2")), 2, 20)).alias("pos", "x"))
    return items.select("event_id", "pos", "x.course_id", "x.score", "x.rationale", F.array_join("x.cited", ",").alias("cited"))


def _dense(s, d):
    """Events on a faster clock, so that limits bite."""
    at = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 20000))
    return table(s, d, "events").select(F.col("user_id").alias("user"), "event_id", at.alias("at"))


def rate_limit_log(s, d):
    return S.rate_limited(_dense(s, d), "user", "at", "event_id", S.PER_ACCOUNT)


def dual_window(s, d):
    return S.rate_limited(_dense(s, d), "user", "at", "event_id", S.PER_ADDRESS)


def rate_window_count(s, d):
    return S.window_count(_dense(s, d), "user", "at").select("event_id", "user", "recent")


def _answers(s, d):
    return TALK(s, d).where("role = 'user'").select(key_of(F.col("text")).alias("question_key"), F.col("text").alias("answer"), F.when(F.col("turn") % 3 == 0, "not_found").otherwise("answered").alias("status"), (F.col("conv_id") * 100 + F.col("turn")).alias("at"), (F.col("turn") == 0).alias("first_turn"))


def _cache(s, d):
    """What was asked before: the questions whose key has a hash in the lower half."""
    asked = TALK(s, d).where("role = 'user'").withColumn("key", key_of(F.col("text"))).where("left(md5(key), 1) < '8'")
    return asked.groupBy(F.col("key").alias("question_key")).agg(F.min("text").alias("answer"), F.when(F.max("conv_id") % 4 == 0, "v1").otherwise("v2").alias("version"), F.count("*").alias("hits"))


def cache_lookup(s, d):
    return S.cache_lookup(_answers(s, d).select("question_key", "at", "first_turn"), _cache(s, d), "question_key", "v1").select(F.col("at").alias("asked"), "answer", "hit")


def cache_upsert(s, d):
    return S.cache_upsert(_cache(s, d).where("question_key is not null"), _answers(s, d), "v3")


QUERIES = {f.__name__: f for f in (session_list, session_total, corpus_version, last_n_turns, ordered_turns, newest_edition_list, latest_edition, program_list, priority_text, dedupe_first, course_page, context_entity, refined_questions, catalog_search, known_names, reply_class, eval_tally, match_eval, offered_missing, profile_query_text, match_query_text, context_block, fee_text, small_talk, scope_gate, route_questions, validate_output, rate_limit_log, dual_window, rate_window_count, cache_lookup, cache_upsert)}

_MENTION = ["der ", "ing", "para", "que "]
_ORDER = sorted(_MENTION, key=lambda n: (-len(n), n))


def _mentions() -> str:
    out = ["s0 as (select conv_id, turn, role, lower(text) as rest, cast([] as varchar[]) as found from conversations)"]
    for k, n in enumerate(_ORDER):
        test = f"case when role = 'user' then contains(rest, '{n}') else regexp_matches(rest, '(?m)(of |^[-*•]\\s*){n}\\s*(\\(|$)') end"
        out.append(f"s{k + 1} as (select conv_id, turn, role, case when {test} then replace(rest, '{n}', ' ') else rest end as rest, case when {test} then list_append(found, '{n}') else found end as found from s{k})")
    return "with " + ", ".join(out)


_REPLIES = """with r as (select conv_id, turn, text, ['answered', 'answered', 'not_found', 'out_of_scope', 'answered', 'small_talk'][turn % 6 + 1] as status from conversations where role = 'assistant'),
    f as (select *, contains(text, 'ing th') or contains(text, 'der ') as den, contains(text, 'est ') or contains(text, 'est.') as gue from r),
    c as (select *, case when status = 'small_talk' then 'small_talk' when status = 'out_of_scope' then 'refuse' when status = 'not_found' then 'not_found'
                         when den and (length(text) > 250 or gue) then 'hallucinated' when den then 'not_found' when gue then 'hallucinated' else 'answered' end as got from f)"""
_KEY = "case when length(text) <= 300 then nullif(lower(regexp_replace(text, '[\\s\\x{200B}?!.,;:\"''()\\[\\]{}\\-–—]+', '', 'g')), '') end"
_CACHED = f"""with a as (select {_KEY} as question_key, text as answer, case when turn % 3 = 0 then 'not_found' else 'answered' end as status, conv_id * 100 + turn as asked, turn = 0 as first_turn from conversations where role = 'user'),
    c as (select {_KEY} as question_key, min(text) as answer, case when max(conv_id) % 4 = 0 then 'v1' else 'v2' end as version, count(*) as hits from conversations where role = 'user' and left(md5({_KEY}), 1) < '8' group by 1)"""
_DENSE = "with recursive e as (select user_id as user, event_id, cast(floor(epoch_us(ts) / 20000) as bigint) as us from events)"


def _limiter(limits) -> str:
    """A recursion over each user's events that keeps the list of accepted times."""
    longest = int(max(w for w, _ in limits) * 1e6)
    ok = " and ".join(f"len(list_filter(log, lambda t: n.us - t < {int(w * 1e6)})) < {m}" for w, m in limits)
    return _DENSE + f""", n as (select *, row_number() over (partition by user order by us, event_id) as i from e),
        g(user, i, event_id, accepted, log) as (select user, i, event_id, true, [us] from n where i = 1
            union all select n.user, n.i, n.event_id, {ok}, case when {ok} then list_append(list_filter(log, lambda t: n.us - t < {longest}), n.us) else log end from g join n on n.user = g.user and n.i = g.i + 1)
        select user, event_id, accepted from g"""


ORACLES = {
    "session_list": """select conv_id, count(*) as n_messages, max(turn) as last_at, arg_min(text, turn) filter (where role = 'user') as first_question
        from conversations group by conv_id order by last_at desc, conv_id limit 20 offset 10""",
    "session_total": "select count(distinct conv_id) as total, count(distinct conv_id) > 30 as has_more from conversations",
    "corpus_version": "select count(*) || '-' || max(doc_id) || '-k25-v3' as version from documents",
    "last_n_turns": """with b as (select *, row_number() over (partition by conv_id order by turn desc) as b from conversations)
        select conv_id, turn, cast(row_number() over (partition by conv_id order by turn) as int) as place, role from b where b <= 6""",
    "ordered_turns": "select conv_id, turn, role, cast(row_number() over (partition by conv_id order by turn // 2, case when role = 'user' then 0 else 1 end, turn) as int) as place from conversations",
    "newest_edition_list": COURSES + " select level, name, max(title) as title from courses where is_active group by level, name",
    "latest_edition": COURSES + " select name, cast(year as int) as year, course_id from (select *, row_number() over (partition by name order by year desc, course_id) as rn from courses) where rn = 1",
    "program_list": COURSES + """, l as (select distinct level, name from courses where is_active and name in (select name from courses where brand in ('Brand#1', 'Brand#2', 'Brand#3')))
        select level, count(*) as n, string_agg(name, chr(10) || '- ' order by name) as names from l group by level""",
    "priority_text": "select o_custkey, string_agg(o_orderstatus || ': ' || o_orderpriority, '; ' order by cast(left(o_orderpriority, 1) as int), o_orderkey) as needs from orders group by o_custkey",
    "dedupe_first": "select l_partkey, l_suppkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_partkey, l_suppkey order by l_quantity desc, l_orderkey, l_linenumber) as rn from lineitem) where rn = 1",
    "course_page": COURSES + " select course_id, title from courses order by course_id limit 50 offset 100",
    "context_entity": _mentions() + f", l as (select conv_id, arg_max(found, turn) as f from s{len(_ORDER)} where len(found) > 0 group by conv_id) select conv_id, case when len(f) = 1 then f[1] end as entity from l",
    "refined_questions": """with t as (select conv_id, turn, role, text from conversations),
        w as (select *, lag(text) over o as pt, lag(role) over o as pr, last_value(case when role = 'user' then text end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as bu from t window o as (partition by conv_id order by turn))
        select conv_id, turn, case when role = 'user' and pr = 'assistant' and contains(pt, 'the') and not regexp_matches(text, '^[A-M]') and bu is not null then bu || ' ' || text else text end as refined from w""",
    "catalog_search": COURSES + " select course_id, title from courses where contains(lower(concat_ws(' ', title, level, brand)), 'blue g')",
    "known_names": COURSES + " select distinct name from courses where length(name) >= 9 order by name",
    "reply_class": _REPLIES + " select conv_id, turn, got from c",
    "eval_tally": _REPLIES + " select conv_id % 5 as grp, cast(sum(case when status = got then 1 else 0 end) as bigint) as hits, count(*) as n, cast(sum(case when got = 'hallucinated' then 1 else 0 end) as bigint) as hallucinated from c group by 1",
    "match_eval": """with sc as (select c_custkey, c_nationkey, n_nationkey, (n_nationkey * 37 + c_custkey * 11) % 101 as score from customer join nation on ((n_nationkey - c_nationkey) % 25 + 25) % 25 < 6),
        r as (select *, row_number() over (partition by c_custkey order by score desc, n_nationkey) as rank from sc),
        k as (select c_custkey, max(case when rank = 1 and n_nationkey = c_nationkey then 1 else 0 end) as top1, max(case when n_nationkey = c_nationkey then 1 else 0 end) as top3, max(score) filter (where rank = 1) - max(score) filter (where rank = 3) as gap from r where rank <= 3 group by c_custkey)
        select top1, count(*) as cases, cast(sum(top3) as bigint) as top3, round(avg(gap), 6) as mean_gap from k group by top1""",
    "offered_missing": COURSES + ", w as (select distinct name || case when course_id % 2 = 0 then ' ' else '' end as name from courses) select name from w where name not in (select name from courses)",
    "profile_query_text": """select c_custkey, coalesce(nullif(concat_ws(' | ', case when c_mktsegment <> 'BUILDING' then 'segment: ' || c_mktsegment end, case when c_acctbal > 5000 then 'balance: high' end, case when c_custkey % 3 = 0 then 'likes: a, ' || c_name end), ''), 'any programme') as q from customer""",
    "match_query_text": """select c_custkey, concat_ws(' ', case when c_nationkey > 12 then 'enjoys ' || c_mktsegment || ', ' || c_name end, case when c_custkey % 4 > 0 then lower(c_mktsegment) else 'please find' end) as q from customer""",
    "context_block": """with r as (select *, row_number() over (partition by conv_id order by turn) as rn from conversations)
        select conv_id, string_agg('[' || role || ' #' || turn || '] ' || text, chr(10) order by rn) as block from r where rn <= 3 group by conv_id""",
    "fee_text": COURSES + " select course_id, format('{:,}', fee) || ' per term' || case when course_id % 2 = 0 then format(', weekend {:,}', fee + 1500) else '' end || case when fee >= 20000 then ' (special programme)' else '' end as fee from courses",
    "small_talk": "select event_id, ['greeting', null, 'thanks', 'bye', 'identity', null][event_id % 6 + 1] as kind from events",
    "scope_gate": """with g as (select event_id, value / 100 as best, user_id % 3 = 0 as named, case when user_id % 5 > 0 then user_id % 2 = 0 end as in_scope, case when user_id % 7 > 0 then event_id % 4 > 0 end as answerable from events)
        select event_id, case when (best < 0.50::double and not named) or (best < 0.65::double and not named and not coalesce(in_scope, true)) then 'out_of_scope' when not coalesce(answerable, true) then 'not_found' else 'answered' end as status from g""",
    "route_questions": """select conv_id, turn, case when length(text) < 12 then 'small_talk' when contains(lower(text), 'the and') or contains(lower(text), 'les des') then 'list' when contains(text, 'ing.') or contains(text, 'tion.') then 'fee'
        when regexp_matches(lower(text), '^(the|of)') and turn > 2 then 'which_programme' else 'search' end as route from conversations where role = 'user'""",
    "validate_output": """with e as (select event_id, user_id from events where event_id % 11 <> 0),
        i as (select event_id, 0 as pos, cast(user_id as varchar) as course_id, [0.0, 1.0, 0.0, 0.25, 0.0][event_id % 5 + 1]::double as score, left(repeat('r', event_id % 30), 20) as rationale, 'c1' as cited from e where user_id between 1 and 75
              union all select event_id, case when user_id between 1 and 75 then 1 else 0 end, '1', 0.5::double, '', '' from e) select event_id, cast(pos as int) as pos, course_id, score, rationale, cited from i""",
    "rate_limit_log": _limiter(S.PER_ACCOUNT),
    "dual_window": _limiter(S.PER_ADDRESS),
    "rate_window_count": _DENSE + " select event_id, user, count(*) over (partition by user order by us range between 59999999 preceding and current row) as recent from e",
    "cache_lookup": _CACHED + " select asked, c.answer, c.question_key is not null as hit from a left join c on a.first_turn and c.version = 'v1' and a.question_key = c.question_key",
    "cache_upsert": _CACHED + """, f as (select question_key, arg_max(answer, asked) as answer from a where question_key is not null and status = 'answered' and trim(answer) <> '' group by 1)
        select question_key, answer, version, hits from c where question_key is not null and question_key not in (select question_key from f) union all select question_key, answer, 'v3', 0 from f""",
}
