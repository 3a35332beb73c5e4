"""Vectors of texts, kept from run to run: a text is embedded again only when it, or the model, has changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources import publish as P


def fingerprint(text: Column, model: str) -> Column:
    """A digest of all that a vector depends on."""
    return F.sha2(F.concat_ws("\n", F.lit(model), text), 256)


def _held(inputs: DataFrame, id_col: str, path: str) -> DataFrame:
    kind = inputs.schema[id_col].dataType.simpleString()
    return P.published(inputs.sparkSession, path, f"`{id_col}` {kind}, fingerprint string, vector array<float>", id_col)


def states(inputs: DataFrame, id_col: str, text: Column, path: str, model: str) -> DataFrame:
    """(id, text, fingerprint, state) of inputs (id, ...): unchanged, if the store has the vector of this fingerprint, stale, if it has another one of the id, else new."""
    now = inputs.select(id_col, text.alias("text")).withColumn("fingerprint", fingerprint(F.col("text"), model))
    held = _held(inputs, id_col, path).select(id_col, F.col("fingerprint").alias("_held"))
    state = F.when(F.col("_held") == F.col("fingerprint"), "unchanged").when(F.col("_held").isNotNull(), "stale").otherwise("new")
    return now.join(held, id_col, "left").select(id_col, "text", "fingerprint", state.alias("state"))


def refresh(inputs: DataFrame, id_col: str, text: Column, path: str, load: str, embed: Callable[[Column], Column], model: str) -> int:
    """Embeds what is stale or new and publishes it as a load of the store; readers see all of it or none. Ids are different; a null text is embedded as null. Returns the generation."""
    wanted = states(inputs, id_col, text, path, model).where("state <> 'unchanged'")
    # Embedding is costly: not to be repeated for a later use of the column.
    return P.publish(wanted.select(id_col, "fingerprint", embed(F.col("text")).alias("vector")), path, load, id_col)


def vectors(inputs: DataFrame, id_col: str, text: Column, path: str, model: str) -> DataFrame:
    """(id, vector) of the inputs whose vectors the store has as they are now; vectors of ids that are gone, or have changed since, stay out."""
    now = inputs.select(id_col, fingerprint(text, model).alias("fingerprint"))
    return now.join(_held(inputs, id_col, path), [id_col, "fingerprint"]).select(id_col, "vector")
