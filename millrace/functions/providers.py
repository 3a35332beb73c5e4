"""Model calls behind one interface: embedding, JSON replies and character recognition, with a deterministic stub.

A provider is made once in each Python worker, from a function that is sent to it; calls are made for an Arrow batch of texts at a time.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.folders import exists


class Provider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def chat(self, prompt: str) -> str: ...

    def recognise(self, image: bytes) -> str: ...


class Stub:
    """Answers that depend on the input alone: for tests, and for runs without a model."""

    def __init__(self, size: int = 16):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            raw = hashlib.shake_256(t.encode()).digest(2 * self.size)
            v = [int.from_bytes(raw[k : k + 2], "big") / 32768 - 1 for k in range(0, len(raw), 2)]
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out

    def chat(self, prompt: str) -> str:
        return json.dumps({"items": [], "seen": len(prompt)})

    def recognise(self, image: bytes) -> str:
        return hashlib.sha256(image).hexdigest()[:8]


# Seconds for which a model is left alone once its daily quota is used up, the least for one that counts by the minute, what is
# added to the time that it asks for, and the longest that a call waits for the next free model; and the words by which a refusal tells its kind.
DAILY, LEAST, MARGIN, WAIT = 4 * 3600.0, 45.0, 2.0, 75.0
PER_DAY, PER_MINUTE, RETRY = r"PerDay|(?i:per day)", r"PerMinute|(?i:per minute)", r'"retryDelay"\s*:\s*"(\d+(?:\.\d+)?)s"'


class QuotaUsed(Exception):
    """A model refuses because a quota is used up."""

    def __init__(self, per_day: bool, retry_after: float = 0.0):
        super().__init__(f"429: {'daily' if per_day else 'short'} quota used up")
        self.per_day, self.retry_after = per_day, retry_after

    @staticmethod
    def of(body: str) -> QuotaUsed:
        """By a refusal's text. One that doesn't tell its kind counts as daily: another model costs less than waiting in vain."""
        asked = re.search(RETRY, body)
        daily = bool(re.search(PER_DAY, body)) or not (asked or re.search(PER_MINUTE, body))
        return QuotaUsed(daily, float(asked[1]) if asked else 0.0)

    @property
    def rest(self) -> float:
        return DAILY if self.per_day else max(self.retry_after + MARGIN, LEAST)


class Fallback:
    """Several models as one provider. A call goes to the first, in order of preference, that isn't resting; one whose quota is used up rests, and the call goes on.

    If all rest, the call waits for the one that is free soonest where that is soon; else all are tried again, as their times are guesses. A Python
    worker has one of its own. Errors other than a used-up quota are the caller's.
    """

    def __init__(self, models: dict[str, Provider], clock: Callable[[], float] = time.monotonic, pause: Callable[[float], None] = time.sleep):
        self.models, self.clock, self.pause = models, clock, pause
        self.free_at: dict[str, float] = {}  # of resting models
        self.calls: Counter = Counter()

    def _waken(self) -> None:
        """Leaves in free_at what still rests, at least one model being free."""
        now = self.clock()
        self.free_at = {m: t for m, t in self.free_at.items() if t > now}
        if len(self.free_at) == len(self.models):
            left = min(self.free_at.values()) - now
            if left > WAIT:
                self.free_at.clear()
            else:
                self.pause(left + 1)
                self._waken()

    def _call(self, method: str, *args):
        self._waken()
        refused = None
        for name in [m for m in self.models if m not in self.free_at]:
            self.calls[name] += 1
            try:
                return getattr(self.models[name], method)(*args)
            except QuotaUsed as e:
                self.free_at[name] = self.clock() + e.rest
                refused = e
        raise refused

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self._call("embed", texts)

    def chat(self, prompt: str) -> str:
        return self._call("chat", prompt)

    def recognise(self, image: bytes) -> str:
        return self._call("recognise", image)


def embed(text: Column, make: Callable[[], Provider] = Stub) -> Column:
    """Vectors of texts; null for null."""

    @F.arrow_udf("array<float>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for batch in batches:
            texts = batch.to_pylist()
            vectors = iter(model.embed([t for t in texts if t is not None]))
            yield pa.array([None if t is None else next(vectors) for t in texts], pa.list_(pa.float32()))

    return of(text)


def chat(prompt: Column, make: Callable[[], Provider] = Stub) -> Column:
    """Replies to prompts; null where the model fails, so that a gate behind it decides what that means."""

    @F.arrow_udf("string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for batch in batches:
            out = []
            for p in batch.to_pylist():
                try:
                    out.append(None if p is None else model.chat(p))
                except Exception:  # whatever a remote model raises
                    out.append(None)
            yield pa.array(out, pa.string())

    return of(prompt)


def recognise_pages(pages: DataFrame, sink: str, make: Callable[[], Provider] = Stub, tries: int = 5, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """(file, page, text, error) of pages (file, page, image), from the sink; pages that it has a text of are not asked for again.

    A page that fails `tries` times has a null text and the last error; the next call asks for it again, and a text then replaces the error.
    """
    spark = pages.sparkSession

    def ask(batches):
        model = make()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for k in range(1, tries + 1):
                    try:
                        rows.append({"file": r["file"], "page": r["page"], "text": model.recognise(r["image"]), "error": None})
                        break
                    except Exception as e:  # whatever a remote model raises
                        if k < tries:
                            pause(60.0 * k if "429" in str(e) else 3.0)
                        else:
                            rows.append({"file": r["file"], "page": r["page"], "text": None, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("error", pa.string())]))

    schema = "file string, page int, text string, error string"
    done = spark.read.schema(schema).parquet(sink) if exists(spark, sink) else spark.createDataFrame([], schema)
    pages.join(done.where("error is null").select("file", "page"), ["file", "page"], "left_anti").select("file", "page", "image").mapInArrow(ask, schema).write.mode("append").parquet(sink)
    every = spark.read.schema(schema).parquet(sink)
    return every.groupBy("file", "page").agg(F.max("text").alias("text"), F.when(F.max("text").isNull(), F.max("error")).alias("error"))

