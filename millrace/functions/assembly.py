"""Texts put together from fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def labelled(label: str, value: Column) -> Column:
    """`label: value`, or null for a null or empty value, so that concat_ws leaves it out."""
    return F.when(F.length(value) > 0, F.concat(F.lit(label), value))


def joined(values: Column, by: str = ", ") -> Column:
    """An array as text; null if it is null or empty."""
    return F.when(F.size(values) > 0, F.array_join(values, by))


def profile_text(parts: list[Column], by: str = " | ", empty: str = "any programme") -> Column:
    """The parts that are there; a default if none is."""
    return F.coalesce(F.nullif(F.concat_ws(by, *parts), F.lit("")), F.lit(empty))


def without_prefixes(text: Column, pattern: str) -> Column:
    """Text without a leading request phrase; unchanged if nothing would be left."""
    rest = F.trim(F.regexp_replace(text, f"^(?:{pattern})\\s*", ""))
    return F.coalesce(F.nullif(rest, F.lit("")), text)


def fee_text(regular: Column, weekend: Column, high: int = 20_000) -> Column:
    """A fee as text, with the weekend fee if there is one, and a note on high fees."""
    money = lambda x: F.format_number(x, 0)
    note = F.when(regular >= high, F.lit(" (special programme)")).otherwise(F.lit(""))
    return F.concat(money(regular), F.lit(" per term"), F.when(weekend.isNotNull(), F.concat(F.lit(", weekend "), money(weekend))).otherwise(F.lit("")), note)


def delimited(name: str, body: Column) -> Column:
    """Content that a model must not take as instructions, between markers that the content can't close."""
    safe = F.regexp_replace(body, f"</?{name}>", "")
    return F.concat(F.lit(f"<{name}>\n"), safe, F.lit(f"\n</{name}>"))


def prompt(instructions: str, parts: list[tuple[str, Column]], reminder: str = "") -> Column:
    """Instructions, then each part that is there as delimited() content, then a reminder, which weighs most at the end; blank lines between them."""
    shown = [F.when(F.length(body) > 0, delimited(name, body)) for name, body in parts]
    return F.concat_ws("\n\n", F.lit(instructions), *shown, *([F.lit(reminder)] if reminder else []))
