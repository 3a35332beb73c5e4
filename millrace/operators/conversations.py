"""Conversation analytics: sessions, their last turns, and the programme that a conversation is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def role_order(role: Column) -> Column:
    return F.when(role == "user", 0).otherwise(1)


def sessions(turns: DataFrame, session: str, at: str, role: str, text: str) -> DataFrame:
    """(session, n_messages, last_at, first_question): one aggregation; sessions without messages have no row."""
    first = F.min_by(F.when(F.col(role) == "user", F.col(text)), F.when(F.col(role) == "user", F.col(at)))
    return turns.groupBy(session).agg(F.count("*").alias("n_messages"), F.max(at).alias("last_at"), first.alias("first_question"))


def page_of(rows: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(size)


def last_turns(turns: DataFrame, session: str, at: str, n: int = 6) -> DataFrame:
    """The last n turns of each session, with their place from the first of them."""
    back = turns.withColumn("_b", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(at)))).where(F.col("_b") <= n)
    return back.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy(at))).drop("_b")


def context_entity(turns: DataFrame, session: str, at: str, found: str) -> DataFrame:
    """(session, entity): of the last turn that mentions any the one it mentions; null if it mentions several."""
    last = turns.where(F.size(found) > 0).groupBy(session).agg(F.max_by(found, at).alias("_f"))
    return last.select(session, F.when(F.size("_f") == 1, F.col("_f")[0]).alias("entity"))


def refined_question(turns: DataFrame, session: str, at: str, role: str, text: str, lead: str, factual: Column) -> DataFrame:
    """turns with `refined`: a user turn that answers an assistant's offer (its text has the lead phrase) and asks no fact, put behind the user turn before."""
    w = Window.partitionBy(session).orderBy(at)
    previous = F.lag(text).over(w)
    before_user = F.last(F.when(F.col(role) == "user", F.col(text)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    follows = (F.col(role) == "user") & (F.lag(role).over(w) == "assistant") & previous.contains(lead) & ~factual & before_user.isNotNull()
    return turns.withColumn("refined", F.when(follows, F.concat_ws(" ", before_user, F.col(text))).otherwise(F.col(text)))


def appended_turns(turns: DataFrame, exchanges: DataFrame, session: str, at: str, role: str, text: str, asked: str, question: str, answer: str) -> DataFrame:
    """The rows that exchanges (session, asked, question, answer) add to turns: a user and an assistant row each, numbered on after the session's last.

    Both rows of an exchange come of one row, so appending the result stores both or neither. Exchanges of one session follow each
    other by `asked`; a session without turns starts at 0.
    """
    last = turns.groupBy(session).agg(F.max(at).alias("_last"))
    place = F.row_number().over(Window.partitionBy(session).orderBy(asked, question, answer)) - 1
    numbered = exchanges.select(session, asked, question, answer, place.alias("_place")).join(last, session, "left")
    rows = F.array(*[F.struct((2 * F.col("_place") + k).alias("_k"), F.lit(who).alias(role), F.col(said).alias(text)) for k, (who, said) in enumerate((("user", question), ("assistant", answer)))])
    one = numbered.select(session, "_last", F.explode(rows).alias("_row"))
    return one.select(session, (F.coalesce("_last", F.lit(-1)) + 1 + F.col("_row._k")).cast("long").alias(at), f"_row.{role}", f"_row.{text}")


def corpus_version(docs: DataFrame, at: str, k: int, logic: str) -> DataFrame:
    """(version): changes when documents are added or the search changes."""
    return docs.agg(F.concat_ws("-", F.count("*").cast("string"), F.coalesce(F.max(at).cast("string"), F.lit("epoch")), F.lit(f"k{k}"), F.lit(logic)).alias("version"))
