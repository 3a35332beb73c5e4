"""Queries on names, aliases and titles. Questions are conversation turns; programmes are made of parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import entities as E
from millrace.plans.tables import COURSES, courses, table

#: Stand-ins for a deployment's tables: short forms and what they mean, in this order.
ALIASES = [("th", "Blue Bolt"), ("edsh", "Red Widget studies"), ("on", "Hot Gear"), ("que", "Cold Gizmo"), ("of the", "Small Ring and Red Widget"), ("ä", "Large Nut")]
NAMES = ["Blue Bolt", "Red Widget", "Hot Gear", "Small Ring", "Cold Gizmo", "the", "and the", "der", "die"]
WRAPPERS, LIGHT = ["Programme of ", "Economy", "Standard", "Economy field", "field"], ["Programme of "]
TALK = lambda s, d: table(s, d, "conversations")


def distinctive_name(s, d):
    return courses(s, d).select("course_id", E.distinctive_name(F.col("title")).alias("name"))


def normalise_title(s, d):
    return courses(s, d).select("course_id", E.normalise_title(F.col("title"), WRAPPERS, LIGHT).alias("key"))


def name_variants(s, d):
    return courses(s, d).select("course_id", F.explode(E.name_variants(F.col("name"), ["Small ", "Red ", "Hot "], F.array("brand"), 3)).alias("variant"))


def _questions(s, d):
    """A turn's text with a programme's name put behind it, in turns whose number is twice a programme's."""
    named = courses(s, d).select((F.col("course_id") * 2).alias("q_id"), "name")
    talk = TALK(s, d).withColumn("q_id", F.col("conv_id") * 100 + F.col("turn"))
    return talk.join(named, "q_id", "left").select("q_id", F.concat_ws(" ", "text", "name").alias("q"))


_QUESTIONS = COURSES + """, questions as (select conv_id * 100 + turn as q_id, concat_ws(' ', t.text, n.name) as q from conversations t
    left join courses n on n.course_id * 2 = conv_id * 100 + turn)"""


def longest_match_join(s, d):
    names = courses(s, d).groupBy("name").agg(F.min("fee").alias("fee")).withColumn("variants", E.name_variants(F.col("name"), ["Small ", "Red ", "Hot "]))
    return E.longest_match(_questions(s, d), "q_id", "q", names, "name", "variants", ["fee"]).select("q_id", "matched", F.coalesce("fee", F.lit(-1)).alias("fee"))


def programme_of_question(s, d):
    """Questions with their aliases' terms behind them, normalised as the programmes' names are."""
    names = courses(s, d).groupBy("name").agg(F.min("fee").alias("fee"))
    found = E.find_programme(_questions(s, d), "q_id", "q", names, "name", ["fee"], ALIASES, WRAPPERS, LIGHT, ["Small", "Red", "Hot"])
    return found.select("q_id", "matched", F.coalesce("fee", F.lit(-1)).alias("fee"))


def alias_match(s, d):
    low = F.lower("text")
    return TALK(s, d).select("conv_id", "turn", *[E.alias_present(a, low).alias(f"a{k}") for k, (a, _) in enumerate(ALIASES)])


def expand_query(s, d):
    return TALK(s, d).select("conv_id", "turn", E.expand_query(F.col("text"), ALIASES).alias("expanded"))


def expand_only(s, d):
    return TALK(s, d).select("conv_id", "turn", E.only_terms(F.col("text"), ALIASES).alias("terms"))


def resolve_scope(s, d):
    return _questions(s, d).select("q_id", E.resolve_scope(F.col("q"), NAMES, ALIASES).alias("scope"))


def resolve_scopes(s, d):
    return _questions(s, d).select("q_id", F.array_join(E.resolve_scopes(F.col("q"), NAMES, ALIASES), "|").alias("scopes"))


def _editions(s, d):
    return courses(s, d).groupBy("name").agg(F.array_sort(F.collect_set("title")).alias("titles"))


def narrow_by_year(s, d):
    asked = _editions(s, d).withColumn("q", F.concat(F.lit("about "), (F.lit(2556) + F.length("name")).cast("string")))
    return asked.select("name", F.array_join(E.narrow_by_year(F.col("titles"), F.col("q")), "|").alias("titles"))


def search_text(s, d):
    asked = courses(s, d).select("course_id", "name", F.concat(F.lit("Programme of "), F.upper("name"), F.lit(" "), F.col("year").cast("string"), F.lit(" "), F.substring("brand", 1, F.col("course_id").cast("int") % 9 + 1)).alias("q"))
    return asked.select("course_id", E.search_text(F.col("q"), F.array("name"), "BOLT|GEAR", "Programme of").alias("search"))


def mentions(s, d):
    return TALK(s, d).select("conv_id", "turn", F.array_join(E.mentions(F.col("text"), F.col("role"), ["the", "and the", "der", "que", "on the"], "of "), "|").alias("names"))


def title_reconcile(s, d):
    wanted = table(s, d, "nation").select(F.concat(F.element_at(F.array(*[F.lit(x) for x in ("Blue", "Red", "Hot", "Odd")]), F.col("n_nationkey") % 4 + 1), F.lit(" "), F.element_at(F.array(*[F.lit(x) for x in ("Bolt", "Gear", "Ring")]), F.col("n_nationkey") % 3 + 1)).alias("wanted")).distinct()
    return E.reconcile(wanted, "wanted", courses(s, d), "name", "year", "course_id").select("wanted", F.coalesce("course_id", F.lit(-1)).alias("course_id"), F.coalesce("year", F.lit(0)).alias("year"), "matched")


def decode_labels(s, d):
    answers = table(s, d, "events").select("event_id", F.col("event_type").alias("field"), (F.col("user_id") % 5).cast("string").alias("code"))
    labels = s.createDataFrame([("click", "1", "one click"), ("click", "2", "two clicks"), ("view", "1", "one view"), ("error", "0", "no error")], "field string, code string, label string")
    return E.decode_labels(answers, F.broadcast(labels)).select("event_id", "field", "code", "label")


def facts_lookup(s, d):
    facts = courses(s, d).groupBy("name").agg(F.min("fee").alias("fee"), F.max("level").alias("language"))
    return _questions(s, d).select("q_id", E.resolve_scope(F.col("q"), NAMES, []).alias("name")).join(facts, "name", "left").select("q_id", "name", F.format_number("fee", 0).alias("fee"), "language")


def rank_backmap(s, d):
    """For each brand its best priced programme and two alternatives, by external name, repeats skipped."""
    ranked = courses(s, d).withColumn("_n", F.row_number().over(Window.partitionBy("brand", "name").orderBy(F.desc("fee"), "course_id"))).where("_n = 1")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("fee"), "course_id"))).where("rank <= 3")
    return ranked.select("brand", "rank", F.when(F.col("rank") == 1, "primary").otherwise("alternative").alias("kind"), "name", "course_id")


QUERIES = {f.__name__: f for f in (distinctive_name, normalise_title, name_variants, longest_match_join, programme_of_question, alias_match, expand_query, expand_only, resolve_scope, resolve_scopes, narrow_by_year, search_text, mentions, title_reconcile, decode_labels, facts_lookup, rank_backmap)}


def _present(alias: str, text: str) -> str:
    return f"regexp_matches({text}, '(^|[^a-z0-9]){alias}($|[^a-z0-9])')" if alias.isascii() else f"contains({text}, '{alias}')"


_FOUND = "list_filter([" + ", ".join(f"case when {_present(a, 'lower(q)')} and not contains(q, '{f}') then '{f}' end" for a, f in ALIASES) + "], lambda x: x is not null)"
#: A term is left out if the earlier ones hold it.
def _terms(source: str, key: str) -> str:
    return f"""f as (select {key}, q, {_FOUND} as found from {source}),
    fold({key}, q, found, i, got) as (select {key}, q, found, 1, '' from f
        union all select {key}, q, found, i + 1, case when contains(got, found[i]) then got when got = '' then found[i] else got || ' ' || found[i] end from fold where i <= len(found)),
    terms as (select {key}, q, got from fold where i = len(found) + 1)"""


_TERMS = "with recursive t as (select conv_id, turn, text as q from conversations), " + _terms("t", "conv_id, turn")


def _normal(x: str) -> str:
    bare = f"regexp_replace({x}, '\\s*\\([^)]*\\)\\s*', '', 'g')"
    return f"coalesce(nullif(replace(regexp_replace({bare}, 'Economy field|Programme of |Standard|Economy|field', '', 'g'), ' ', ''), ''), replace(regexp_replace({bare}, 'Programme of ', '', 'g'), ' ', ''))"


_ORDERED = sorted(NAMES, key=lambda n: (-len(n), n))
_SCOPE = "coalesce(" + ", ".join([f"case when contains(lower(q), '{n.lower()}') then '{n}' end" for n in _ORDERED] + [f"case when {_present(a, 'lower(q)')} then '{[n for n in NAMES if n in f][0]}' end" for a, f in ALIASES if any(n in f for n in NAMES)]) + ")"


def _folded(source: str, key: str, steps: list[tuple[str, str, list[str]]]) -> str:
    """SQL that goes through steps (test of rest, new rest, names to add), a common table expression for each."""
    out = [f"s0 as (select {key}, lower(q) as rest, cast([] as varchar[]) as found from {source})"]
    for k, (test, rest, names) in enumerate(steps):
        more = "[" + ", ".join(f"'{n}'" for n in names) + "]"
        out.append(f"s{k + 1} as (select {key}, case when {test} then {rest} else rest end as rest, case when {test} then list_concat(found, list_filter({more}, lambda x: not list_contains(found, x))) else found end as found from s{k})")
    return ", ".join(out) + f", folded as (select {key}, found from s{len(steps)})"


def _blank_alias(a: str) -> str:
    # RE2 has no look-around: neighbours are captured and put back; twice, as they may be shared.
    one = f"regexp_replace({{0}}, '(^|[^a-z0-9]){a}($|[^a-z0-9])', '\\1 \\2', 'g')"
    return one.format(one.format("rest")) if a.isascii() else f"replace(rest, '{a}', ' ')"


_SCOPES = _folded("questions", "q_id", [(f"contains(rest, '{n.lower()}')", f"replace(rest, '{n.lower()}', ' ')", [n]) for n in _ORDERED] + [(_present(a, "rest"), _blank_alias(a), [n for n in NAMES if n in f]) for a, f in ALIASES if any(n in f for n in NAMES)])
_MENTIONED = sorted(["the", "and the", "der", "que", "on the"], key=lambda n: (-len(n), n))
_MENTIONS = _folded("talk", "conv_id, turn, role", [(f"case when role = 'user' then contains(rest, '{n}') else regexp_matches(rest, '(?m)(of |^[-*•]\\s*){n}\\s*(\\(|$)') end", f"replace(rest, '{n}', ' ')", [n]) for n in _MENTIONED])
ORACLES = {
    "distinctive_name": COURSES + " select course_id, name from courses",
    "normalise_title": COURSES + " select course_id, replace(regexp_replace(regexp_replace(title, '\\s*\\([^)]*\\)\\s*', '', 'g'), 'Economy field|Programme of |Standard|Economy|field', '', 'g'), ' ', '') as key from courses",
    "name_variants": COURSES + """, b as (select course_id, unnest([name, brand]) as v from courses),
        a as (select course_id, v from b union select course_id, substr(v, length(p) + 1) from b, (values ('Small '), ('Red '), ('Hot ')) as x(p) where starts_with(v, p) and length(v) - length(p) > 3)
        select course_id, v as variant from a where v <> ''""",
    "longest_match_join": _QUESTIONS + """, n as (select name, min(fee) as fee from courses group by name),
        v as (select name, fee, name as v from n union select name, fee, substr(name, length(p) + 1) from n, (values ('Small '), ('Red '), ('Hot ')) as x(p) where starts_with(name, p) and length(name) - length(p) > 3),
        h as (select q_id, name, fee, row_number() over (partition by q_id order by length(name) desc, name, fee) as rn from questions join v on contains(q, v))
        select q_id, name as matched, coalesce(fee, -1) as fee from questions left join (select * from h where rn = 1) using (q_id)""",
    "programme_of_question": _QUESTIONS.replace("with ", "with recursive ", 1) + ", " + _terms("questions", "q_id") + f""", n as (select name, {_normal("name")} as base, min(fee) as fee from courses group by name),
        v as (select name, fee, base as v from n union select name, fee, substr(base, length(p) + 1) from n, (values ('Small'), ('Red'), ('Hot')) as x(p) where starts_with(base, p) and length(base) - length(p) > 3),
        a as (select q_id, {_normal("case when got = '' then q else q || ' ' || got end")} as target from terms),
        h as (select q_id, name, fee, row_number() over (partition by q_id order by length(name) desc, name, fee) as rn from a join v on contains(target, v))
        select q_id, name as matched, coalesce(fee, -1) as fee from questions left join (select * from h where rn = 1) using (q_id)""",
    "alias_match": "select conv_id, turn, " + ", ".join(f"{_present(a, 'lower(text)')} as a{k}" for k, (a, _) in enumerate(ALIASES)) + " from conversations",
    "expand_query": _TERMS + " select conv_id, turn, case when got = '' then q else q || ' ' || got end as expanded from terms",
    "expand_only": _TERMS + " select conv_id, turn, got as terms from terms",
    "resolve_scope": _QUESTIONS + f" select q_id, {_SCOPE} as scope from questions",
    "resolve_scopes": _QUESTIONS + ", " + _SCOPES + " select q_id, array_to_string(found, '|') as scopes from folded",
    "narrow_by_year": COURSES + """, e as (select name, list_sort(list(distinct title)) as titles, cast(2556 + length(name) as varchar) as y from courses group by name),
        k as (select name, titles, list_filter(titles, lambda t: contains(t, y)) as kept from e)
        select name, array_to_string(case when len(kept) > 0 then kept else titles end, '|') as titles from k""",
    "search_text": COURSES + """, a as (select course_id, name, 'Programme of ' || upper(name) || ' ' || year || ' ' || left(brand, cast(course_id % 9 + 1 as int)) as q from courses),
        r as (select course_id, q, trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(replace(q, upper(name), ' '), '25\\d{2}', ' ', 'g'), 'BOLT|GEAR', ' ', 'g'), '\\s{2,}', ' ', 'g')), '^Programme of\\s*', '')) as r from a)
        select course_id, case when length(r) >= 8 then r else q end as search from r""",
    "mentions": "with talk as (select conv_id, turn, role, text as q from conversations), " + _MENTIONS + " select conv_id, turn, array_to_string(found, '|') as names from folded",
    "title_reconcile": COURSES + """, w as (select distinct ['Blue', 'Red', 'Hot', 'Odd'][n_nationkey % 4 + 1] || ' ' || ['Bolt', 'Gear', 'Ring'][n_nationkey % 3 + 1] as wanted from nation),
        n as (select *, row_number() over (partition by name order by year desc, course_id) as rn from courses)
        select wanted, coalesce(course_id, -1) as course_id, coalesce(year, 0) as year, course_id is not null as matched from w left join (select * from n where rn = 1) c on c.name = wanted""",
    "decode_labels": """with l(field, code, label) as (values ('click', '1', 'one click'), ('click', '2', 'two clicks'), ('view', '1', 'one view'), ('error', '0', 'no error')),
        a as (select event_id, event_type as field, cast(user_id % 5 as varchar) as code from events) select event_id, field, code, coalesce(label, code) as label from a left join l using (field, code)""",
    "facts_lookup": _QUESTIONS + ", f as (select name, min(fee) as fee, max(level) as language from courses group by name), r as (select q_id, coalesce(" + ", ".join(f"case when contains(lower(q), '{n.lower()}') then '{n}' end" for n in _ORDERED) + ") as name from questions) select q_id, name, format('{:,}', fee) as fee, language from r left join f using (name)",
    "rank_backmap": COURSES + """, o as (select *, row_number() over (partition by brand, name order by fee desc, course_id) as n from courses),
        r as (select *, row_number() over (partition by brand order by fee desc, course_id) as rank from o where n = 1)
        select brand, cast(rank as int) as rank, case when rank = 1 then 'primary' else 'alternative' end as kind, name, course_id from r where rank <= 3""",
}
