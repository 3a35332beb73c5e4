"""Queries on whole chat turns, with stand-ins for a deployment's phrases and models that depend on the text alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import chat as C
from millrace.operators import entities as E
from millrace.operators import gates as G
from millrace.plans.entity_queries import _folded
from millrace.plans.tables import table

PROGRAMMES = ["reon", "esen", "heit", "mente", "inth", "chie"]
_has = lambda *words: lambda t: G.contains_any(F.lower(t), list(words))
RULES = C.Rules(
    small_talk=lambda t: G.small_talk(t, {"bye": ["in nicht ü einachie"]}, ["ein", "er"]),
    lists=_has("edha", "bes"), fee=_has("dor", "zug"), specific=_has("tz", "rou "), names=lambda t: E.mentions(t, F.lit("user"), PROGRAMMES, "of "), known=_has("heit", "mente"),
    unknown=lambda t: F.when(t.contains("ly of"), F.regexp_extract(t, r"ly of (\S+)", 1)), interest=lambda t: F.when(t.contains("est ") & (F.length(t) < 200), F.substring(t, 1, 30)),
    cached=lambda t: F.when(F.length(t) % 11 == 0, "answered"), rewritten=lambda t, p: F.when(F.length(t) % 3 == 0, F.concat_ws(" ", F.substring(t, 1, 50), p)).when(F.length(t) % 3 == 1, F.concat(F.substring(t, 1, 60), F.lit(" dor"))),
    translated=lambda t: F.when(t.rlike("[éèñ]"), F.substring(t, 1, 20)), score=lambda t: (F.length(t) * 37 % 101) / 100, in_scope=lambda t: F.length(t) % 5 != 0, answerable=lambda t: F.length(t) % 7 != 0,
    reference="erst", offer="onin",
)


def talk(s, d):
    """Turns with a clock that lets a conversation be silent for more than an hour after every fifth turn, and the programmes they name."""
    at = (F.col("turn") * 60 + F.floor(F.col("turn") / 5) * 4000).cast("double")
    return table(s, d, "conversations").withColumn("at", at).withColumn("named", E.mentions(F.col("text"), F.col("role"), PROGRAMMES, "of "))


def turn_context(s, d):
    found = C.turn_context(talk(s, d), "conv_id", "turn", "at", "role", "text", "named")
    return found.select("conv_id", "turn", *C.CONTEXT)


def chat_flow(s, d):
    turns = C.turn_context(talk(s, d), "conv_id", "turn", "at", "role", "text", "named")
    return C.routed(turns, RULES).select("conv_id", "turn", "step", "status", "query", "interpreted", F.round("best_score", 4).alias("best_score"))


QUERIES = {f.__name__: f for f in (turn_context, chat_flow)}

_ORDER = sorted(PROGRAMMES, key=lambda n: (-len(n), n))
_NAMED = _folded("talk", "conv_id, turn, role", [(f"case when role = 'user' then contains(rest, '{n}') else regexp_matches(rest, '(?m)(of |^[-*•]\\s*){n}\\s*(\\(|$)') end", f"replace(rest, '{n}', ' ')", [n]) for n in _ORDER])
_CONTEXT = "with talk as (select conv_id, turn, role, text as q, turn * 60 + (turn // 5) * 4000 as sent from conversations), " + _NAMED + """,
    t as (select talk.*, found from talk join folded using (conv_id, turn)),
    b as (select *, case when sent - lag(sent) over (partition by conv_id order by sent, turn) <= 1800 then 0 else 1 end as begins from t),
    p as (select *, sum(begins) over (partition by conv_id order by sent, turn) as part from b),
    w as (select conv_id, turn, role, q,
        cast(count(*) over (o rows between 6 preceding and 1 preceding) as int) as n_history, lag(role) over o as previous_role, lag(q) over o as previous,
        last_value(case when role = 'user' then q end ignore nulls) over (o rows between 6 preceding and 2 preceding) as asked_before,
        last_value(case when len(found) > 0 then found end ignore nulls) over (o rows between 6 preceding and 1 preceding) as about
        from p window o as (partition by conv_id, part order by sent, turn)),
    ctx as (select conv_id, turn, q, n_history, previous_role, previous, asked_before, case when len(about) = 1 then about[1] end as programme from w where role = 'user')"""


def _any(x: str, *words: str) -> str:
    return "coalesce(" + " or ".join(f"contains(lower({x}), '{w}')" for w in words) + ", false)"


def _score(x: str) -> str:
    return f"(length({x}) * 37 % 101) / 100"


ORACLES = {
    "turn_context": _CONTEXT + " select conv_id, turn, n_history, previous_role, previous, asked_before, programme from ctx",
    "chat_flow": _CONTEXT + f""",
    f1 as (select *, {_any("q", *PROGRAMMES)} as names, case when length(trim(q)) <= 40 and trim(q) <> '' then case when regexp_replace(lower(trim(q)), '[ \\t!?.,]+$', '') = 'in nicht ü einachie' then 'bye' when {_any("trim(q)", "ein", "er")} then 'identity' end end as kind from ctx),
    f2 as (select *, not names and contains(q, 'erst') as refers from f1),
    f3 as (select *, case when refers and programme is not null then replace(q, 'erst', programme) else q end as asked from f2),
    f4 as (select *, case when n_history > 0 and asked = q then case length(q) % 3 when 0 then concat_ws(' ', left(q, 50), programme) when 1 then left(q, 60) || ' dor' end end as re0 from f3),
    f5 as (select *, case when trim(re0) <> '' and length(re0) <= 200 and re0 <> q then re0 end as re from f4),
    f6 as (select *, re is not null and (({_any("re", *PROGRAMMES)} and not names) or {_score("re")} > {_score("asked")}) as taken from f5),
    f7 as (select *, case when taken then re else asked end as interpreted, case when regexp_matches(q, '[éèñ]') then left(q, 20) end as other from f6),
    f8 as (select *, coalesce({_score("other")} > {_score("interpreted")}, false) as better from f7),
    f9 as (select *, case when better then other else interpreted end as search from f8),
    g as (select *, {_score("search")} as best, {_any("interpreted", "heit", "mente")} or {_any("search", "heit", "mente")} as named,
          n_history >= 2 and previous_role = 'assistant' and contains(previous, 'onin') and trim(coalesce(asked_before, '')) <> '' and not {_any("q", "tz", "rou ")} and not {_any("q", "heit", "mente")} as follows from f9),
    s as (select *, case when n_history = 0 and length(q) % 11 = 0 then 'cached' when kind is not null then 'small_talk' when {_any("q", "edha", "bes")} then 'list' when {_any("q", "dor", "zug")} then 'fee' when coalesce(follows, false) then 'refined'
          when contains(q, 'est ') and length(q) < 200 then 'recommended' when contains(q, 'ly of') then 'unknown' when n_history = 0 and {_any("q", "tz", "rou ")} and not names then 'which' when refers and programme is null then 'which'
          when {_any("re", "dor", "zug")} then 'fee_later' else 'search' end as step from g)
    select conv_id, turn, step, interpreted,
        case step when 'cached' then 'answered' when 'small_talk' then 'small_talk' when 'search' then
            case when (best < 0.5::double and not named) or (best < 0.65::double and not named and length(interpreted) % 5 = 0) then 'out_of_scope' when length(interpreted) % 7 = 0 then 'not_found' else 'answered' end else 'answered' end as status,
        case step when 'fee' then case when n_history > 0 and not names and programme is not null then q || ' ' || programme else q end when 'refined' then trim(asked_before) || ' ' || trim(q) when 'recommended' then left(q, 30)
            when 'fee_later' then re when 'search' then search else q end as query,
        case when step = 'search' then round(best, 4) end as best_score from s""",
}
