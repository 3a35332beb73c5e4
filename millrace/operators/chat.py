"""A whole chat turn: what a conversation gives a turn to go by, and the ordered flow that decides how the turn is answered.

Rules and verdicts of models are parameters, functions from a text's column to a column, so that the flow itself is one plan over all turns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import gates as G

# Turns that are looked back on, and characters of a rewritten question; a longer one is an explanation, not a question.
HISTORY, LONGEST = 6, 200
#: Seconds after which a silent conversation starts anew.
IDLE = 1800.0
#: What turn_context() and the stream's state tell of a user's turn.
CONTEXT = ("n_history", "previous_role", "previous", "asked_before", "programme")

Of = Callable[[Column], Column]


@dataclass(frozen=True)
class Rules:
    """Of a text: small_talk: its kind, or null; lists: it asks what is on offer; fee: it asks for a fee; specific: it makes sense for one
    programme only; names: the programmes in it, an array; known: it names one that there is, by its full name; unknown: the name in it of one that there isn't, or null;
    interest: what a recommendation is wanted for, or null; cached: the status of a stored answer, or null; translated: what to search by in
    the documents' language, or null; score, in_scope, answerable: what a search and the models behind it say.
    rewritten: of the text and the conversation's programme, the model's complete question, or null.
    """

    small_talk: Of
    lists: Of
    fee: Of
    specific: Of
    names: Of
    known: Of
    unknown: Of
    interest: Of
    cached: Of
    rewritten: Callable[[Column, Column], Column]
    translated: Of
    score: Of
    in_scope: Of
    answerable: Of
    #: A phrase that stands for the programme in question, a regular expression, and the phrase by which an offer to refine a recommendation is known.
    reference: str
    offer: str


def turn_context(turns: DataFrame, conv: str, turn: str, at: str, role: str, text: str, named: str, history: int = HISTORY, idle: float = IDLE) -> DataFrame:
    """The user's turns with CONTEXT, from the `history` turns before each: their number, the last one's role and text, the last user's text before
    that one, and the programme, that of the latest turn that names any, null if that names several.

    at: seconds; a turn more than `idle` seconds after the one before starts anew. named: the programmes that a turn names, an array.
    """
    order = [F.col(at), F.col(turn)]
    in_conv = Window.partitionBy(conv).orderBy(*order)
    begins = F.coalesce(F.col(at) - F.lag(at).over(in_conv) > idle, F.lit(True)).cast("int")
    parted = turns.withColumn("_begins", begins).withColumn("_part", F.sum("_begins").over(in_conv))
    w = Window.partitionBy(conv, "_part").orderBy(*order)
    before = w.rowsBetween(-history, -1)
    earlier_user = F.last(F.when(F.col(role) == "user", F.col(text)), ignorenulls=True).over(w.rowsBetween(-history, -2))
    last_named = F.last(F.when(F.size(named) > 0, F.col(named)), ignorenulls=True).over(before)
    found = parted.select(
        *turns.columns, F.count("*").over(before).cast("int").alias("n_history"), F.lag(role).over(w).alias("previous_role"), F.lag(text).over(w).alias("previous"),
        earlier_user.alias("asked_before"), F.when(F.size(last_named) == 1, last_named[0]).alias("programme"),
    )
    return found.where(F.col(role) == "user")


def routed(turns: DataFrame, rules: Rules, text: str = "text") -> DataFrame:
    """turns with CONTEXT -> all columns, step (what decided), status, query (what is searched or answered) and interpreted (the question as understood).

    In this order, the first that holds: a stored answer, for a conversation's first turn; small talk; a wish for the list of
    programmes; a fee, of the programme in the conversation if the text names none; an answer to the offer to refine a recommendation; a wish
    for a recommendation; a programme that there isn't; a first question that lacks its programme; a reference to a programme that isn't known.
    All else is searched for: the text, its reference replaced by the programme; in a conversation also the rewritten question, which may turn out to
    ask for a fee, and which counts if it names a programme where the text didn't or scores more; the translation, if that scores more. Then the gate says
    answered, not_found or out_of_scope.
    """
    message, history, programme = F.col(text), F.col("n_history"), F.col("programme")
    no = lambda c: F.coalesce(c, F.lit(False))
    scored = lambda c: F.when(F.col(c).isNotNull(), rules.score(F.col(c)))
    out = turns.withColumn("_names", F.size(rules.names(message)) > 0).withColumn("_cached", F.when(history == 0, rules.cached(message))).withColumn("_kind", rules.small_talk(message)).withColumn("_interest", rules.interest(message))
    refers = ~F.col("_names") & message.rlike(rules.reference)
    resolved = F.when(refers & programme.isNotNull(), G.resolve_reference(message, rules.reference, programme)).otherwise(message)
    follows = (history >= 2) & (F.col("previous_role") == "assistant") & F.col("previous").contains(rules.offer) & (F.trim(F.coalesce("asked_before", F.lit(""))) != "")
    follows = no(follows & ~no(rules.specific(message)) & ~no(rules.known(message)))
    rewritten = F.when((history > 0) & (F.col("_query") == message), rules.rewritten(message, programme))
    usable = F.when((F.length(F.trim(rewritten)) > 0) & (F.length(rewritten) <= LONGEST) & (rewritten != message), rewritten)
    out = out.withColumn("_refers", no(refers)).withColumn("_query", resolved).withColumn("_rewritten", usable)
    # The search: the question, then what else there is to search by.
    out = out.withColumn("_score", scored("_query")).withColumn("_again", scored("_rewritten"))
    gains = (F.size(rules.names(F.col("_rewritten"))) > 0) & ~F.col("_names")
    out = out.withColumn("_taken", no(F.col("_rewritten").isNotNull() & (gains | (F.col("_again") > F.col("_score")))))
    out = out.withColumn("interpreted", F.when(F.col("_taken"), F.col("_rewritten")).otherwise(F.col("_query"))).withColumn("_best", F.when(F.col("_taken"), F.col("_again")).otherwise(F.col("_score")))
    out = out.withColumn("_translated", rules.translated(message)).withColumn("_other", scored("_translated"))
    out = out.withColumn("_better", no(F.col("_other") > F.col("_best")))
    out = out.withColumn("_search", F.when(F.col("_better"), F.col("_translated")).otherwise(F.col("interpreted"))).withColumn("_best", F.when(F.col("_better"), F.col("_other")).otherwise(F.col("_best")))
    named = no(rules.known(F.col("interpreted"))) | no(rules.known(F.col("_search")))
    gate = G.scope_gate(F.col("_best"), named, rules.in_scope(F.col("interpreted")), rules.answerable(F.col("interpreted")))
    of_fee = F.when((history > 0) & ~F.col("_names") & programme.isNotNull(), F.concat_ws(" ", message, programme)).otherwise(message)
    needs = no(rules.specific(message)) & ~F.col("_names")
    step = G.route([
        ("cached", F.col("_cached").isNotNull()), ("small_talk", F.col("_kind").isNotNull()), ("list", rules.lists(message)), ("fee", rules.fee(message)), ("refined", follows), ("recommended", F.col("_interest").isNotNull()),
        ("unknown", rules.unknown(message).isNotNull()), ("which", (history == 0) & needs), ("which", F.col("_refers") & programme.isNull()), ("fee_later", rules.fee(F.col("_rewritten"))),
    ], "search")
    out = out.withColumn("step", step).withColumn("_gate", gate)
    by_step = {"fee": of_fee, "refined": F.concat_ws(" ", F.trim("asked_before"), F.trim(message)), "recommended": F.col("_interest"), "fee_later": F.col("_rewritten"), "search": F.col("_search")}
    query = message
    for name, q in by_step.items():
        query = F.when(F.col("step") == name, q).otherwise(query)
    status = F.when(F.col("step") == "cached", F.col("_cached")).when(F.col("step") == "small_talk", "small_talk").when(F.col("step") == "search", F.col("_gate")).otherwise("answered")
    return out.select(*turns.columns, "step", status.alias("status"), query.alias("query"), "interpreted", F.when(F.col("step") == "search", F.col("_best")).alias("best_score"))
