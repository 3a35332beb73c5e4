"""Text repair and text tests as Spark column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


# Fixed value: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.btrim(text, F.lit(WHITE))


def repair_characters(text: Column, wrong: str, right: str) -> Column:
    """Each character of `wrong` becomes the one at the same place of `right`."""
    return F.translate(text, wrong, right)


def repair_sequences(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Regular-expression replacements, one after another."""
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, new)
    return text


def unknown_characters(text: Column, known: str, private: str = r"\x{E000}-\x{F8FF}") -> Column:
    """The different characters of the private range that a text has and no repair is known for, an array; they are reported, never guessed."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(f"[{private}]"), F.lit(0))), F.array(*[F.lit(c) for c in known]).cast("array<string>"))


def repair_observed(pages: DataFrame, text: str, wrong: str, right: str, private: str = r"\x{E000}-\x{F8FF}") -> tuple[DataFrame, Observation]:
    """pages with repaired characters, and an observation that has, once the pages are computed, unknown_pages and unknown, the characters (as U+XXXX) that stayed.

    They are counted in the pass that repairs. The range bounds how many there can be.
    """
    seen = Observation()
    unknown = unknown_characters(F.col(text), wrong, private)
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_set(unknown))))
    # A character's code point: that of its UTF-32 bytes.
    named = F.transform(every, lambda c: F.concat(F.lit("U+"), F.lpad(F.ltrim(F.hex(F.encode(c, "UTF-32")), F.lit("0")), 4, "0")))
    watched = pages.observe(seen, F.count_if(F.size(unknown) > 0).alias("unknown_pages"), F.array_join(named, ", ").alias("unknown"))
    return watched.withColumn(text, repair_characters(F.col(text), wrong, right)), seen


def nfc(text: Column) -> Column:
    """Unicode NFC, which Spark has no function for."""

    @F.arrow_udf("string")
    def normal(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())

    return normal(text)


def strip_controls(text: Column) -> Column:
    """Without C0 controls but tab, newline and carriage return."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def normalise_space(text: Column) -> Column:
    """Joins words hyphenated at a line end, makes runs of spaces and tabs one space and 3 or more newlines 2, and trims."""
    text = F.regexp_replace(text, r"(\w)-\n(\w)", "$1$2")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


# Fixed values, which the functions below have as they are or as defaults: half a token for a character of the dense script and a quarter for
# others; 3 leaders of 5 dots or more, or 0.33 of the words being numbers, make a table of contents; titles of 60 characters; keys of questions of up to 300.


def token_estimate(text: Column, dense: str = r"\x{0E00}-\x{0E7F}") -> Column:
    """Half a token for a character of the dense script, a quarter for others, rounded half to even."""
    n = F.length(F.regexp_replace(text, f"[^{dense}]", ""))
    return F.bround(n / 2 + (F.length(text) - n) / 4, 0).cast("long")


def looks_like_contents(text: Column) -> Column:
    """A table of contents: 3 or more dot leaders, or a third (0.33) of the words are numbers once dots are taken off."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    numbers = F.filter(words, lambda w: F.regexp_replace(w, r"^[.…]+|[.…]+$", "").rlike(r"^\d+$"))
    leaders = F.regexp_count(text, F.lit(r"[.…]{5,}"))
    return (F.size(words) > 0) & ((leaders >= 3) | (F.size(numbers) / F.greatest(F.size(words), F.lit(1)) >= 0.33))


def has_script(text: Column, characters: str = r"\x{0E00}-\x{0E7F}") -> Column:
    return text.rlike(f"[{characters}]")


def short_title(text: Column, empty: str = "New conversation", longest: int = 60) -> Column:
    """One line of at most `longest` characters; a longer one ends in an ellipsis."""
    line = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    cut = F.concat(F.rtrim(F.substring(line, 1, longest - 1)), F.lit("…"))
    return F.when(line == "", F.lit(empty)).when(F.length(line) <= longest, line).otherwise(cut)


def question_key(text: Column, longest: int = 300) -> Column:
    """The question without spaces and punctuation, lower case; null if empty before or after, or too long."""
    key = F.lower(F.regexp_replace(text, r"[\s\x{200B}?!.,;:\"'()\[\]{}\-–—]+", ""))
    return F.when(F.length(text) <= longest, F.nullif(key, F.lit("")))
