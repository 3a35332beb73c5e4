"""Rules that route a question and gates that hold an answer back, as ordered expressions.

Phrase lists are parameters. Verdicts of a model come in as columns, so that everything here is reproducible without one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed values, as defaults below: small talk has 40 characters at most; a best score under 0.50 is off topic, one under 0.65 in doubt; a denial that
# goes on for more than 250 characters is made up; rationales are cut at 2,000.


def contains_any(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases], F.lit(False))


def small_talk(text: Column, exact: dict[str, list[str]], hints: list[str], longest: int = 40) -> Column:
    """The kind of small talk that the whole of a short text is, `identity` if it holds a hint, else null."""
    low = F.lower(F.trim(text))
    core = F.regexp_replace(low, r"[ \t!?.,]+$", "")
    kind = F.lit(None).cast("string")
    kind = F.when(contains_any(low, hints), "identity").otherwise(kind)
    for name, texts in reversed(exact.items()):
        kind = F.when(core.isin(texts), name).otherwise(kind)
    return F.when((low != "") & (F.length(low) <= longest), kind)


def scope_gate(best: Column, named: Column, in_scope: Column, answerable: Column, off_topic: float = 0.50, ambiguous: float = 0.65) -> Column:
    """out_of_scope, not_found or answered. Missing verdicts of the model let a question through."""
    out = ((best < off_topic) & ~named) | ((best < ambiguous) & ~named & ~F.coalesce(in_scope, F.lit(True)))
    return F.when(out, "out_of_scope").when(~F.coalesce(answerable, F.lit(True)), "not_found").otherwise("answered")


def route(rules: list[tuple[str, Column]], default: str) -> Column:
    """The first rule that holds."""
    return reduce(lambda c, r: F.when(F.coalesce(r[1], F.lit(False)), r[0]).otherwise(c), reversed(rules), F.lit(default))


def reply_class(reply: Column, status: Column, denials: list[str], guesses: list[str], longest: int = 250) -> Column:
    """What a reply is: its status, but an answer that denies and goes on, or guesses, is hallucinated."""
    denied, guessed = contains_any(reply, denials), contains_any(reply, guesses)
    return (
        F.when(status == "small_talk", "small_talk").when(status == "out_of_scope", "refuse").when(status == "not_found", "not_found")
        .when(denied & ((F.length(reply) > longest) | guessed), "hallucinated").when(denied, "not_found").when(guessed, "hallucinated").otherwise("answered")
    )


#: A model's reply.
ITEMS = "struct<items: array<struct<course_id: string, score: string, rationale: string, cited_chunk_ids: array<string>>>>"


def validated_items(raw: Column, courses: Column, chunks: Column, top_n: int, longest: int = 2000) -> Column:
    """The reply's first top_n items whose course was retrieved: score within 0..1 (0 if no number), cut rationale, retrieved chunks only; null for malformed JSON."""
    items = F.slice(F.from_json(raw, ITEMS)["items"], 1, top_n)
    kept = F.filter(items, lambda x: F.array_contains(courses, x["course_id"]))
    return F.transform(kept, lambda x: F.struct(
        x["course_id"].alias("course_id"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x["score"].try_cast("double"), F.lit(0.0)))).alias("score"),
        F.substring(F.coalesce(x["rationale"], F.lit("")), 1, longest).alias("rationale"), F.filter(F.coalesce(x["cited_chunk_ids"], F.array().cast("array<string>")), lambda c: F.array_contains(chunks, c)).alias("cited"),
    ))


def rationale_of(title: Column, rationales: Column, normalise) -> Column:
    """The text for a title in a map: by the title, by the title behind marks (`#`), by the normalised title; else empty."""
    entries = F.map_entries(rationales)
    pick = lambda same: F.get(F.filter(entries, same), F.lit(0))["value"]
    bare = lambda x: F.trim(F.regexp_replace(x, r"^#+\s*", ""))
    return F.coalesce(pick(lambda e: e["key"] == title), pick(lambda e: bare(e["key"]) == title), pick(lambda e: normalise(bare(e["key"])) == normalise(title)), F.lit(""))


def needs_programme(text: Column, specific: list[str], mentioned: Column) -> Column:
    """A question that only makes sense for one programme, but names none."""
    return contains_any(F.lower(text), specific) & (F.size(mentioned) == 0)


def resolve_reference(text: Column, pattern: str, entity: Column) -> Column:
    """`this programme` becomes the programme that the conversation is about; a text without the phrase gets it behind; without one nothing changes."""
    quoted = F.regexp_replace(entity, r"([\\$])", r"\\$1")
    named = F.when(text.rlike(pattern), F.regexp_replace(text, F.lit(pattern), quoted)).otherwise(F.concat_ws(" ", text, entity))
    return F.when(entity.isNull(), text).otherwise(named)


def recommendation(text: Column, vetoed: Column, wanted: Column, interest: Column, only_names: Column) -> Column:
    """The interest to recommend by, or null: not if a rule vetoes it or the model doesn't see the wish (or failed). An interest that isn't
    in the text, whatever the spaces, is replaced by the text; one that is nothing but names gives null."""
    packed = lambda x: F.regexp_replace(x, r"\s+", "")
    found = F.when(packed(text).contains(packed(interest)) & (F.length(F.trim(interest)) > 0), interest).otherwise(text)
    return F.when(~F.coalesce(vetoed, F.lit(False)) & F.coalesce(wanted, F.lit(False)) & ~F.coalesce(only_names, F.lit(False)), found)


def support(rationale: Column, unsupported: list[str]) -> Column:
    """empty, unsupported (the text says that there is no ground) or supported."""
    return F.when(F.coalesce(F.trim(rationale), F.lit("")) == "", "empty").when(contains_any(rationale, unsupported), "unsupported").otherwise("supported")


def support_of(rows, keys: list[str], kind: str):
    """What a set of results is as a whole: all_supported, none_explained (all empty), none_supported or mixed, with counts."""
    counts = {k: F.count_if(F.col(kind) == k) for k in ("supported", "unsupported", "empty")}
    n = F.count("*")
    whole = F.when(counts["supported"] == n, "all_supported").when(counts["empty"] == n, "none_explained").when(counts["supported"] == 0, "none_supported").otherwise("mixed")
    return rows.groupBy(*keys).agg(whole.alias("whole"), *[c.alias(k) for k, c in counts.items()])


def as_points(rows, key: str, dimension: str, value: str, wanted: list[str], missing: str):
    """A comparison as a list of points for each programme: the wanted rows in this order, missing values left out."""
    order = F.array_position(F.array(*[F.lit(w) for w in wanted]), F.col(dimension))
    kept = rows.where(F.col(dimension).isin(wanted) & F.col(value).isNotNull() & (F.col(value) != missing)).withColumn("_o", order)
    return kept.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_o", value))), lambda x: x[value]).alias("points"))
