"""Names, aliases and titles: normalising them, finding them in questions, and reconciling two lists.

Alias and name tables are parameters: small DataFrames, or Python lists where they become part of an expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.automaton import best_pattern


def distinctive_name(title: Column, marker: str = " field ", wrappers: str = r"^Programme of ") -> Column:
    """The title without a trailing parenthesis: what follows the first marker, else what the wrappers leave."""
    name = F.trim(F.regexp_replace(title, r"\s*\([^)]*\)\s*$", ""))
    return F.when(F.instr(name, marker) > 0, F.trim(F.substring(name, F.instr(name, marker) + len(marker), F.length(name)))).otherwise(F.trim(F.regexp_replace(name, wrappers, "")))


def normalise_title(title: Column, wrappers: list[str], light: list[str]) -> Column:
    """The title without parentheses, wrapper words (the longest first) and spaces; if nothing is left, only without the light wrappers."""
    bare = F.regexp_replace(title, r"\s*\([^)]*\)\s*", "")
    words = lambda ws: "|".join(re.escape(w) for w in sorted(ws, key=lambda w: (-len(w), w)))
    clean = lambda ws: F.replace(F.regexp_replace(bare, words(ws), ""), F.lit(" "), F.lit(""))
    return F.coalesce(F.nullif(clean(wrappers), F.lit("")), clean(light))


def rationale_key(wrappers: list[str]):
    """A function of a title: without parentheses, wrapper words and spaces, which may leave nothing: what a model's keys are compared by when they aren't the titles."""
    pattern = "|".join(re.escape(w) for w in sorted(wrappers, key=lambda w: (-len(w), w)))
    return lambda title: F.replace(F.regexp_replace(F.regexp_replace(title, r"\s*\([^)]*\)\s*", ""), pattern, ""), F.lit(" "), F.lit(""))


def short_title(title: Column, marker: str = " field ", before: str = r"^Programme of\s*", after: str = r"$^") -> Column:
    """For a list on a screen: the title without its year, what follows the last marker, else without what stands before and after names."""
    bare = F.trim(F.regexp_replace(title, r"\s*\([^()]*\d{4}\)\s*", ""))
    return F.when(F.instr(bare, marker) > 0, F.trim(F.substring_index(bare, marker, -1))).otherwise(F.trim(F.regexp_replace(F.regexp_replace(bare, before, ""), after, "")))


def edition_year(title: Column) -> Column:
    """The first 25xx year in a title, 0 if none."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(title, r"25\d{2}", 0), F.lit("")), F.lit("9999")).cast("int"), F.lit(0))


def name_variants(name: Column, prefixes: list[str], aliases: Column | None = None, least: int = 3) -> Column:
    """The name and its aliases, and each of them without a prefix where more than `least` characters remain."""
    base = F.array(name) if aliases is None else F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>")))
    shorter = [F.filter(F.transform(base, _after(p)), lambda x: F.length(x) > least) for p in prefixes]
    return F.array_distinct(F.filter(F.concat(base, *shorter), lambda x: x != ""))


def _after(prefix: str):
    return lambda x: F.when(F.startswith(x, F.lit(prefix)), F.substring(x, F.lit(len(prefix) + 1), F.length(x))).otherwise(F.lit(""))


def longest_match(questions: DataFrame, id_col: str, text: str, names: DataFrame, name: str, variants: str, payload: list[str], target: Column | None = None, **limits) -> DataFrame:
    """questions with the programme whose longest name has a variant in the text (ties by name, then payload); null where none has.

    target: what of the question is looked at, by default the text as it is. limits: those of the automaton's size.
    """
    listed = names.select(F.col(name).alias("_name"), F.explode(variants).alias("_v"), *payload)
    order = F.struct((-F.length("_name")).alias("_l"), "_name", *payload)
    best = listed.where("_v <> ''").groupBy("_v").agg(F.min(order).alias("_o"))
    found = best_pattern(questions, F.col(text) if target is None else target, best, "_v", "_o", "_v", **limits)
    return found.join(best, "_v", "left").select(*questions.columns, F.col("_o._name").alias("matched"), *[F.col(f"_o.{c}").alias(c) for c in payload])


def find_programme(questions: DataFrame, id_col: str, text: str, names: DataFrame, name: str, payload: list[str], aliases: list[tuple[str, str]], wrappers: list[str], light: list[str], prefixes: list[str], expand: bool = True, other_names: str | None = None, **limits) -> DataFrame:
    """longest_match() of normalised names in the normalised question, which first gets the terms of the aliases in it behind it (expand).

    Without expand it is for full titles: the aliases' terms would lead them to other programmes. other_names: a column of names, an array of further names of a programme.
    """
    normal = lambda x: normalise_title(x, wrappers, light)
    more = F.transform(other_names, normal) if other_names else None
    listed = names.withColumn("_variants", name_variants(normal(F.col(name)), prefixes, more))
    target = normal(expand_query(F.col(text), aliases) if expand else F.col(text))
    return longest_match(questions, id_col, text, listed, name, "_variants", payload, target, **limits)


def alias_present(alias: str, lowered: Column) -> Column:
    """An ASCII alias must stand alone between characters that are neither letters nor digits; another may be anywhere."""
    if alias.isascii():
        return lowered.rlike(rf"(?<![a-z0-9])\Q{alias.lower()}\E(?![a-z0-9])")
    return lowered.contains(alias.lower())


def matched_terms(query: Column, aliases: list[tuple[str, str]]) -> Column:
    """The full terms of aliases found in the query, in table order, that the query and earlier terms don't hold yet."""
    lowered = F.lower(query)
    found = F.array(*[F.when(alias_present(a, lowered) & ~query.contains(full), F.lit(full)) for a, full in aliases])
    return F.aggregate(F.filter(found, lambda x: x.isNotNull()), F.array().cast("array<string>"), lambda got, x: F.when(F.array_join(got, " ").contains(x), got).otherwise(F.concat(got, F.array(x))))


def expand_query(query: Column, aliases: list[tuple[str, str]]) -> Column:
    """The query with its matched terms after it."""
    return F.concat_ws(" ", query, F.nullif(F.array_join(matched_terms(query, aliases), " "), F.lit("")))


def only_terms(query: Column, aliases: list[tuple[str, str]]) -> Column:
    return F.array_join(matched_terms(query, aliases), " ")


def resolve_scopes(question: Column, names: list[str], aliases: list[tuple[str, str]]) -> Column:
    """The names that a question mentions, longest first, each blanked out before the next is looked for; then by alias, in what remains."""
    return scope_state(question, names, aliases)["found"]


def scope_state(question: Column, names: list[str], aliases: list[tuple[str, str]]) -> Column:
    """A struct of found, the names as in resolve_scopes(), and targets, the names and aliases by which they were found; and rest, what remains."""
    ordered = sorted((n for n in names if n), key=lambda n: (-len(n), n))
    none = F.array().cast("array<string>")
    start = F.struct(F.lower(question).alias("rest"), none.alias("found"), none.alias("targets"))
    state_of = lambda hit, rest, found, targets, old: F.struct(F.when(hit, rest).otherwise(old["rest"]).alias("rest"), F.when(hit, found).otherwise(old["found"]).alias("found"), F.when(hit, targets).otherwise(old["targets"]).alias("targets"))

    def by_name(state: Column, name: Column) -> Column:
        hit = state["rest"].contains(F.lower(name))
        return state_of(hit, F.replace(state["rest"], F.lower(name), F.lit(" ")), F.concat(state["found"], F.array(name)), F.concat(state["targets"], F.array(name)), state)

    state = F.aggregate(F.array(*[F.lit(n) for n in ordered]), start, by_name) if ordered else start
    table = [(a, [n for n in names if n and n in full]) for a, full in aliases]
    table = [(a, rf"(?<![a-z0-9])\Q{a.lower()}\E(?![a-z0-9])" if a.isascii() else rf"\Q{a.lower()}\E", ns) for a, ns in table if ns]
    if not table:
        return state
    entries = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(p).alias("p"), F.array(*[F.lit(n) for n in ns]).alias("ns")) for a, p, ns in table])

    def by_alias(state: Column, entry: Column) -> Column:
        hit = F.regexp_like(state["rest"], entry["p"])
        more = F.array_except(entry["ns"], state["found"])
        named = F.when(F.size(more) > 0, F.concat(state["targets"], F.array(entry["a"]))).otherwise(state["targets"])
        return state_of(hit, F.regexp_replace(state["rest"], entry["p"], F.lit(" ")), F.concat(state["found"], more), named, state)

    return F.aggregate(entries, state, by_alias)


def resolve_scope(question: Column, names: list[str], aliases: list[tuple[str, str]]) -> Column:
    """The longest name in the question; else a name held by the term of the first alias in it; else null."""
    lowered = F.lower(question)
    ordered = sorted((n for n in names if n), key=lambda n: (-len(n), n))
    picks = [F.when(lowered.contains(n.lower()), F.lit(n)) for n in ordered]
    for a, full in aliases:
        inside = [n for n in names if n and n in full]
        if inside:
            picks.append(F.when(alias_present(a, lowered), F.lit(inside[0])))
    return F.coalesce(*picks) if picks else F.lit(None).cast("string")


def narrow_by_year(titles: Column, question: Column) -> Column:
    """Of titles those with the question's 25xx year; all of them if it has none, or no title has it."""
    year = F.nullif(F.regexp_extract(question, r"25\d{2}", 0), F.lit(""))
    kept = F.filter(titles, lambda t: t.contains(year))
    return F.when(year.isNotNull() & (F.size(kept) > 0), kept).otherwise(titles)


def search_text(question: Column, targets: Column, wrappers: str, leading: str, least: int = 8) -> Column:
    """The question without the targets (an array of names), the year and the wrapper words; the question itself if fewer than `least` characters remain."""
    quoted = lambda name: F.concat(F.lit(r"(?iu)\Q"), name, F.lit(r"\E"))
    rest = F.aggregate(F.array_compact(targets), question, lambda t, name: F.regexp_replace(t, quoted(name), F.lit(" ")))
    rest = F.regexp_replace(F.regexp_replace(rest, r"25\d{2}", " "), wrappers, " ")
    rest = F.trim(F.regexp_replace(F.trim(F.regexp_replace(rest, r"\s{2,}", " ")), f"^{leading}\\s*", ""))
    return F.when(F.length(rest) >= least, rest).otherwise(question)


def without_names(text: Column, names: list[str], aliases: list[str] = ()) -> Column:
    """Lower-case text without the names, longest first, then without the aliases; an ASCII one goes only where it stands alone."""
    text = F.lower(text)
    for n in sorted(names, key=lambda n: (-len(n), n)):
        text = F.replace(text, F.lit(n.lower()), F.lit(" "))
    for a in sorted(aliases, key=lambda a: (-len(a), a)):
        text = F.regexp_replace(text, rf"(?<![a-z0-9])\Q{a.lower()}\E(?![a-z0-9])" if a.isascii() else rf"\Q{a.lower()}\E", " ")
    return text


def mentions(text: Column, role: Column, names: list[str], prefix: str = "programme of ") -> Column:
    """Names in a turn: anywhere in a user's; in another's only after a title's prefix, or as a list item ended by a parenthesis or the line's end."""
    lowered = F.lower(text)
    ordered = sorted(names, key=lambda n: (-len(n), n))
    start = F.struct(lowered.alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, name: Column) -> Column:
        low = F.lower(name)
        strict = F.concat(F.lit(f"(?m)(?:{prefix}|^[-*•]\\s*)\\Q"), low, F.lit(r"\E(?=\s*(?:\(|$))"))
        hit = F.when(role == "user", state["rest"].contains(low)).otherwise(F.regexp_like(state["rest"], strict))
        return F.struct(F.when(hit, F.replace(state["rest"], low, F.lit(" "))).otherwise(state["rest"]).alias("rest"), F.when(hit, F.concat(state["found"], F.array(name))).otherwise(state["found"]).alias("found"))

    return F.aggregate(F.array(*[F.lit(n) for n in ordered]), start, step)["found"]


def unknown_name(text: Column, marker: str, stop: str, known: list[str], least: int = 4, prefixes: tuple[str, ...] = (), asks: tuple[str, ...] = ()) -> Column:
    """What follows the marker up to a stop word, without prefixes, however many follow one another; null if it is short or a prefix, begins with a question word, or the text holds a known name."""
    found = F.trim(F.regexp_replace(F.regexp_extract(text, f"(?i){marker}\\s+([^?.,\\n]+)", 1), f"(?i)(?:^|\\s+)(?:{stop})\\b.*$", ""))
    words = lambda ws: "|".join(re.escape(w) for w in sorted(ws, key=lambda w: (-len(w), w)))
    bare = F.trim(F.regexp_replace(found, rf"(?i)^(?:(?:{words(prefixes)})\b\s*)+(?=\S)", "")) if prefixes else found
    is_known = F.lit(False)
    for k in known:
        is_known = is_known | F.lower(text).contains(k.lower())
    asked = F.lower(found).rlike(rf"^(?:{words(asks)})\b") if asks else F.lit(False)
    return F.when((F.length(bare) >= least) & ~F.lower(bare).isin([p.lower() for p in prefixes]) & ~is_known & ~asked, bare)


def reconcile(wanted: DataFrame, key: str, catalog: DataFrame, catalog_key: str, year: str, id_col: str) -> DataFrame:
    """wanted with the newest catalogue entry of its key (ties: the smallest id) and whether there is one."""
    newest = catalog.withColumn("_r", F.row_number().over(Window.partitionBy(catalog_key).orderBy(F.desc(year), id_col))).where("_r = 1")
    return wanted.join(newest.select(F.col(catalog_key).alias("_k"), id_col, year), F.col(key) == F.col("_k"), "left").drop("_k").withColumn("matched", F.col(id_col).isNotNull())


def decode_labels(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """answers (field, code) with the label of the code in its field; unknown codes stay as they are."""
    return answers.join(labels, ["field", "code"], "left").withColumn("label", F.coalesce("label", "code"))
