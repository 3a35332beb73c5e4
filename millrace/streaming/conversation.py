"""A conversation as state: what operators.chat.turn_context() tells of a user's turn, over a stream of turns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from millrace.operators.chat import CONTEXT, HISTORY, IDLE


class Conversation(StatefulProcessor):
    """State of a conversation: the last turns, the programme that it is about and since which turn, the time and number of its last turn; a timer ends it."""

    def __init__(self, history: int = HISTORY, idle: float = IDLE):
        self.history, self.idle = history, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "role string, text string")
        self.about = handle.getValueState("about", "programme string, number bigint")
        self.last = handle.getValueState("last", "at double, number bigint")

    def handleInputRows(self, key, rows, timerValues):
        turns = [tuple(t) for t in self.turns.get()]
        about = tuple(self.about.get()) if self.about.exists() else None
        at, number = tuple(self.last.get()) if self.last.exists() else (None, 0)
        for frame in rows:
            out = []
            for row in frame.sort_values(["at", "turn"]).itertuples():
                if at is not None and row.at - at > self.idle:
                    turns, about, number = [], None, 0
                if row.role == "user":
                    previous = turns[-1] if turns else (None, None)
                    earlier = next((t for r, t in reversed(turns[:-1]) if r == "user" and t is not None), None)
                    programme = about[0] if about and number - about[1] < self.history else None
                    out.append((key[0], row.turn, row.text, len(turns), *previous, earlier, programme))
                at, number = row.at, number + 1
                if row.named is not None and len(row.named):
                    about = (row.named[0] if len(row.named) == 1 else None, number)
                turns = [*turns, (row.role, row.text)][-self.history :]
            yield pd.DataFrame(out, columns=["conv_id", "turn", "text", *CONTEXT])
        self.turns.put(turns)
        self.last.update((at, number))
        self.about.update(about) if about else self.about.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((at + self.idle) * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        for state in (self.turns, self.about, self.last):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def context_stream(turns: DataFrame, history: int = HISTORY, idle: float = IDLE, delay: str = "0 seconds") -> DataFrame:
    """turns (conv_id, turn, sent timestamp, role, text, named), a stream -> its user turns (conv_id, turn, text) with CONTEXT.

    Turns of a conversation come in their order; turns more than `delay` behind the latest of all count as late, and Spark leaves them out. A conversation
    that is silent for `idle` seconds holds no state. The result can go through operators.chat.routed() like that of a batch.
    """
    rows = turns.withWatermark("sent", delay).withColumn("at", F.unix_micros("sent") / 1e6).select("conv_id", "turn", "sent", "at", "role", "text", "named")
    schema = "conv_id long, turn long, text string, n_history int, previous_role string, previous string, asked_before string, programme string"
    return rows.groupBy("conv_id").transformWithStateInPandas(Conversation(history, idle), schema, "Append", "EventTime")
