"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1; rotating it by a position permutes it. A letter n-gram is the product
(binding) of its letters' permuted vectors, a text the sum (bundle) of its n-grams' vectors, and a language the bundle of
its training texts, each scaled to length one so that long ones don't outweigh the rest. A text gets the language whose
prototype has the greatest cosine with it.

What all languages share (spaces, common endings) points every prototype the same way, so the mean prototype is taken off
prototypes and texts before the cosine. Bundles are computed by Spark tasks for batches of texts, as counts of the
batch's different n-grams times their vectors, some n-grams at a time; a task holds one batch and the prototypes.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import small_batches, stored

#: Texts are worked on in groups of about so many code points.
_CHUNK = 1 << 18
#: Numbers in a working array at most.
_CELLS = 1 << 22


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 32 (a space) where it is none."""
    table = np.full(0x110000, 32, np.uint32)
    for k in range(0x110000):
        if (0x41 <= k < 0x80 or k > 0xA0) and unicodedata.category(chr(k))[0] == "L":
            low = chr(k).lower()
            table[k] = ord(low) if len(low) == 1 else k
    return table


@lru_cache(1 << 16)
def _letter_vector(letter: int, size: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, letter)).choice(np.array([-1, 1], np.int8), size)


def gram_vectors(grams: np.ndarray, size: int, seed: int) -> np.ndarray:
    """grams: n x 3 letters -> n x size, +1 or -1, of float32: the letters' vectors, rotated by 2, 1 and 0, multiplied."""
    letters, at = np.unique(grams, return_inverse=True)
    base = np.stack([_letter_vector(int(x), size, seed) for x in letters]) if len(letters) else np.zeros((0, size), np.int8)
    at = at.reshape(grams.shape)
    return (np.roll(base, 2, 1)[at[:, 0]] * np.roll(base, 1, 1)[at[:, 1]] * base[at[:, 2]]).astype(np.float32)


def bundles(texts: list[str], size: int, seed: int) -> np.ndarray:
    """A row of `size` numbers for each text; zeros where it has no letter. Runs of other characters count as one space."""
    out = np.zeros((len(texts), size), np.float32)
    joined = "\n".join(texts)
    code = np.frombuffer(f"\n{joined}\n".encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))  # of the line end after each text
    of = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=-1))
    letters = _letters()[code]
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] != 32) | (letters[:-1] != 32)
    keep[0], keep[ends] = True, True
    letters, of = letters[keep], of[keep]
    alphabet = np.unique(letters)
    code = np.searchsorted(alphabet, letters)
    k = len(alphabet)
    first, second, third = code[:-2].astype(np.int64), code[1:-1], code[2:]
    valid = letters[1:-1] != 32  # such a letter has a neighbour of its own text, or the line end, on both sides
    gram, of = ((first * k + second) * k + third)[valid], of[1:-1][valid]
    if not len(gram):
        return out
    if k**3 <= 1 << 23:  # few letters: their n-grams are numbered by a table, else by sorting
        seen = np.zeros(k**3, bool)
        seen[gram] = True
        kinds = np.flatnonzero(seen)
        kind = (np.cumsum(seen) - 1)[gram]
    else:
        kinds, kind = np.unique(gram, return_inverse=True)
    letters_of = lambda x: alphabet[np.stack([x // (k * k), x // k % k, x % k], 1)]
    # Counts times vectors, for some kinds at a time. The counts are a matrix where many texts share kinds; where each has
    # its own, only the pairs that occur are looked at.
    if len(texts) * len(kinds) <= 16 * len(gram):
        for lo in range(0, len(kinds), step := max(1, _CELLS // max(size, len(texts)))):
            some = (kind >= lo) & (kind < lo + step)
            part = kinds[lo : lo + step]
            counts = np.bincount(of[some] * len(part) + kind[some] - lo, minlength=len(texts) * len(part)).reshape(len(texts), len(part))
            out += counts.astype(np.float32) @ gram_vectors(letters_of(part), size, seed)
        return out
    pairs, n = np.unique(of * len(kinds) + kind, return_counts=True)
    for lo in range(0, len(pairs), step := max(1, _CELLS // size)):
        row, each = pairs[lo : lo + step] // len(kinds), n[lo : lo + step, None].astype(np.float32)
        used, at = np.unique(pairs[lo : lo + step] % len(kinds), return_inverse=True)
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[starts]] += np.add.reduceat(gram_vectors(letters_of(kinds[used]), size, seed)[at] * each, starts)
    return out


def _in_chunks(texts: pa.Array):
    """Lists of about _CHUNK code points; a longer text is a list of its own."""
    sizes = pc.utf8_length(texts).to_pylist()
    group, total = [], 0
    for text, n in zip(texts, sizes, strict=True):
        if group and total + n > _CHUNK:
            yield group
            group, total = [], 0
        group.append(text.as_py())
        total += n
    if group:
        yield group


def _bundle_all(texts: pa.Array, size: int, seed: int):
    """Arrays of bundles; of a text longer than a chunk, the sum of its parts' bundles (n-grams across a cut are counted)."""
    for group in _in_chunks(pc.fill_null(texts, "")):
        if len(group) > 1 or len(group[0]) <= 2 * _CHUNK:
            yield bundles(group, size, seed)
            continue
        total, text, at = np.zeros((1, size), np.float32), group[0], 0
        while at < len(text):
            end = at + _CHUNK
            while end < len(text) and (text[end].isalpha() or text[end - 1].isalpha()) and end < at + 2 * _CHUNK:
                end += 1
            total += bundles([text[at:end]], size, seed)
            at = end
        yield total


def prototypes(labelled: DataFrame, text_col: str, lang_col: str, size: int, seed: int) -> tuple[list[str], np.ndarray]:
    """Languages and their bundles of unit-length texts: a sum for each language and task, then for each language."""

    def add(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, at = batch.column(1).to_pylist(), 0
            for rows in _bundle_all(batch.column(0), size, seed):
                norm = np.linalg.norm(rows, axis=1, keepdims=True)
                for lang, row in zip(langs[at : at + len(rows)], rows / np.maximum(norm, 1e-9), strict=True):
                    sums[lang] = sums.get(lang, 0) + row.astype(np.float64)
                at += len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], ["lang", "sums"])

    parts = labelled.select(text_col, lang_col).mapInArrow(add, "lang string, sums array<double>")
    rows = parts.select("lang", F.posexplode("sums").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x")).orderBy("lang", "k").collect()  # languages x size
    langs = sorted({r.lang for r in rows})
    made = np.zeros((len(langs), size))
    for r in rows:
        made[langs.index(r.lang), r.k] = r.x
    return langs, made


def training_rows(rows: DataFrame, train_rows: int) -> DataFrame:
    """Of rows (id, text, lang, held_out) about `train_rows` at most for each language, chosen by a hash of id and text, all of a language that has no more.

    Null texts and langs, and rows held out, aren't chosen.
    """
    usable = rows.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    whole = 1 << 62
    rates = usable.groupBy("lang").count().withColumn("below", F.floor(F.least(F.lit(1.0), F.lit(float(train_rows)) / F.col("count")) * whole))
    # A row for each language: so small that Spark broadcasts it.
    chosen = usable.join(stored(rates.drop("count")), "lang")
    return chosen.where(F.pmod(F.xxhash64("id", "text", F.lit("train")), F.lit(whole)) < F.col("below"))


def identify(docs: DataFrame, held_out: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = 1024, train_rows: int = 5_000, seed: int = 7) -> DataFrame:
    """One row for each row of docs: id, held_out, lang_pred, score (0 to 1: (1 + cosine) / 2).

    held_out: SQL condition on columns of docs; such rows are never learned from. Prototypes come from the training_rows() of the
    others, so a rare language is learned from too. A null text, or one without a letter, is `und` with score
    0, as is everything when there is nothing to learn from. Of equal cosines the first language by name wins. lang,
    source and id are no inputs of a prediction; other columns of docs aren't returned. Repeated rows are judged alike. Texts are
    read whole, long ones piece by piece. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    held = F.coalesce(F.expr(held_out), F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held.alias("held_out"))
    chosen = training_rows(rows, train_rows)
    langs, made = prototypes(chosen, "text", "lang", size, seed)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    made = unit(made)
    mean = made.mean(0) if len(langs) > 1 else np.zeros(size)
    centred = unit(made - mean).astype(np.float32)

    @F.arrow_udf("struct<lang: string, score: double>")
    def nearest(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        for x in _bundle_all(texts, size, seed):
            empty = ~x.any(1)
            if not langs:
                empty[:] = True
            cos = unit(unit(x) - mean.astype(np.float32)) @ centred.T if langs else np.zeros((len(x), 1))
            best = cos.argmax(1)
            names += ["und" if e else langs[b] for e, b in zip(empty, best, strict=True)]
            scores += np.where(empty, 0.0, np.clip((1 + cos[np.arange(len(x)), best]) / 2, 0, 1)).astype(float).tolist()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return rows.select("id", "held_out", nearest("text").alias("found")).select(
        F.col("id").alias(id_col), "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score")
    )
