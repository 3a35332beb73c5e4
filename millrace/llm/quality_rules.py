"""Quality rules: counts of a text as native expressions, and a decision list learned by sequential covering.

Learning: on a bounded sample of labelled rows, rules that reject are grown one at a time. A rule is a conjunction of
thresholds (`feature >= t` or `feature < t`, t from quantiles), grown by FOIL gain on two thirds of the sample and
pruned on the other third; rows that a finished rule covers are taken out, and the next rule is learned from the rest.
It stops when a pruned rule is not precise enough. All counting is done by Spark aggregations that return at most
features x bins rows. The list is applied as one ordered CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import SPACE, cut, words

#: What a rule may test, from the counts below; each is defined (0) for empty texts.
FEATURES = {
    "mean_word": "if(n_words > 0, word_chars / n_words, 0D)",
    "symbol_ratio": "if(word_chars > 0, n_symbols / word_chars, 0D)",
    "dup_line_ratio": "if(n_lines > 0, n_dup_lines / n_lines, 0D)",
    "repeat_ratio": "if(n_words > 0, n_repeat_words / n_words, 0D)",
    "words_a_line": "if(n_lines > 0, n_words / n_lines, 0D)",
    "distinct_ratio": "if(n_words > 0, n_distinct_words / n_words, 0D)",
}
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def _once(value: Column, then) -> Column:
    """then(value), with value computed once: an expression that a lambda names more than once is else computed each time."""
    return F.transform(F.array(value), then)[0]


def _repeat_words(w: Column) -> Column:
    """How many words lie in a 3-word window that the text holds twice or more; each word counts once.

    Windows are compared by a 64-bit hash of their three words. Sorting (hash, position) puts equal windows side by side;
    the positions of repeated windows, in order, then cover min(3, distance to the next) words each.
    """

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def repeated(s: Column) -> Column:
        return F.filter(s, lambda x, k: (x["h"] == F.get(s, k + 1)["h"]) | (x["h"] == F.get(s, k - 1)["h"]))

    def reach(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.get(at, k + 1) - p, F.lit(3))), F.lit(0), lambda x, y: x + y)

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        at = _once(pairs, lambda s: F.sort_array(F.transform(repeated(s), lambda x: x["i"])))
        return _once(at, reach)

    some = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0))
    return _once(w, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(_once(hashed(w), some))).cast("long")


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the counts that the rules are made of, in whole texts (null: no words); columns of these names are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.withColumn("_w", words(F.col(text_col))).withColumn("_l", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return counted.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("_w")),
        "n_lines": F.size("_l").cast("long"),
        "n_distinct_words": F.size(F.array_distinct("_w")).cast("long"),
    }).drop("_w", "_l")


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def sql(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def rule_sql(rule: Rule) -> str:
    return " and ".join(c.sql() for c in rule)


def _grow(rows: DataFrame, cuts: dict[str, list[float]], most: int) -> Rule:
    """The conjunction with the best FOIL gain, a condition at a time, on rows (bad boolean, features)."""
    reached = lambda f, ts: F.size(F.filter(F.array(*[F.lit(t) for t in ts]), lambda t: t <= F.col(f)))
    bins = F.array(*[
        F.struct(F.lit(f).alias("feature"), reached(f, ts).alias("bin")) for f, ts in cuts.items()
    ])
    binned = cut(rows.select("bad", *cuts, F.explode(bins).alias("b")).groupBy(*cuts, "b").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")))
    rule: Rule = ()
    for _ in range(most):
        covered = binned.where(rule_sql(rule)) if rule else binned
        table: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in cuts}
        for r in covered.groupBy("b").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect():  # features x bins rows at most
            table[r.b.feature][r.b.bin] = (r.bad, r.good)
        p0, n0 = (sum(x[i] for x in table[next(iter(cuts))].values()) for i in (0, 1))
        if not p0 or not n0:
            break
        best, best_gain = None, 0.0
        for f, ts in cuts.items():
            for k, t in enumerate(ts):
                above = [sum(x[i] for b, x in table[f].items() if b > k) for i in (0, 1)]
                for at_least, (p, n) in ((True, above), (False, [p0 - above[0], n0 - above[1]])):
                    gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0
                    if gain > best_gain + 1e-9 and p + n < p0 + n0:
                        best, best_gain = Condition(f, at_least, t), gain
        if best is None:
            break
        rule += (best,)
    return rule


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The prefix of the rule with the best (bad - good) / (bad + good) on rows; the shorter of equals. With its counts."""
    prefixes = [rule[: k + 1] for k in range(len(rule))]
    counts = rows.agg(*[F.count_if(F.expr(f"{'' if bad else 'not '}bad and {rule_sql(x)}")).alias(f"{k}_{bad}") for k, x in enumerate(prefixes) for bad in (0, 1)]).first()
    worth = lambda k: (counts[f"{k}_1"] - counts[f"{k}_0"]) / max(1, counts[f"{k}_1"] + counts[f"{k}_0"])
    k = max(range(len(prefixes)), key=lambda k: (worth(k), -k))
    return prefixes[k], counts[f"{k}_1"], counts[f"{k}_0"]


def learn_rules(labelled: DataFrame, max_rules: int = 8, max_conditions: int = 3, precision: float = 0.95, least: int = 3) -> list[Rule]:
    """An ordered list of rejecting rules from labelled (bad boolean, split double in 0..1, FEATURES).

    A rule is taken when, pruned, at least `precision` of the rows that it covers on the pruning split, and on the
    growing split, are bad, and it covers `least` bad ones there. No labels, or labels of one class, give no rules.
    """
    rows, rules = labelled, []
    grid = labelled.agg(*[F.percentile_approx(f, [k / 16 for k in range(1, 16)] + [0.97, 0.985, 0.995], 10_000).alias(f) for f in FEATURES]).first()
    cuts = {f: ts for f in FEATURES if (ts := sorted({float(t) for t in grid[f] or [] if t is not None}))}
    # Between the quantiles of a ratio that is mostly 0 lie few cuts: the smallest value above 0 is one too.
    lows = labelled.agg(*[F.min(F.when(F.col(f) > 0, F.col(f))).alias(f) for f in FEATURES]).first()
    for f in FEATURES:
        if lows[f] is not None:
            cuts[f] = sorted({*cuts.get(f, []), float(lows[f])})
    while cuts and len(rules) < max_rules:
        rule = _grow(rows.where("split < 0.67"), cuts, max_conditions)
        if not rule:
            break
        rule, bad, good = _prune(rows.where("split >= 0.67"), rule)
        _, grown_bad, grown_good = _prune(rows.where("split < 0.67"), rule) if len(rule) == 1 else (None, *rows.where("split < 0.67").agg(F.count_if(F.expr(f"bad and {rule_sql(rule)}")), F.count_if(F.expr(f"not bad and {rule_sql(rule)}"))).first())
        if bad + grown_bad < least or bad < precision * (bad + good) or grown_bad < precision * (grown_bad + grown_good):
            break
        rules.append(rule)
        rows = rows.where(f"not ({rule_sql(rule)})")
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The first rule that holds, as text; null if none does."""
    fires = F.lit(None).cast("string")
    for rule in reversed(rules):
        fires = F.when(F.expr(rule_sql(rule)), F.lit(rule_sql(rule))).otherwise(fires)
    return fires


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 10_000) -> DataFrame:
    """quality_rules() with the columns of docs together in one, doc: whatever their names, none is lost."""
    labels = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("quality"))
    n, whole = labels.count(), 1 << 62
    chosen = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(whole)) < min(whole, whole * train_rows // max(1, n))
    features = {k: F.expr(v) for k, v in FEATURES.items()}
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(labels.where(chosen)), "id")  # about train_rows rows of 16 bytes
    labelled = cut(text_counts(sample).select(
        F.expr(BASE_FAILED).alias("base_failed"), (F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64("id", F.lit("split")), F.lit(1000)) / 1000).alias("split"), *[v.alias(k) for k, v in features.items()]
    ))
    rules = learn_rules(labelled.where("not base_failed"))
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(text_col).alias("text"))
    found = text_counts(boxed).withColumn("base_failed", F.expr(BASE_FAILED)).withColumns(features)
    found = found.withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return found.select("doc", *RESULTS)


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """All columns of docs, with the counts, base_failed, kept and rule (what rejected it beyond the base; null if nothing).

    options: those of judged(). Rules are learned from at most about `train_rows` rows of labels (id, quality 0 or 1), chosen by a hash of their id;
    of repeated labels of an id the worst counts, null ones don't. Without usable labels only the base rule rejects. Null and empty texts have no words, so the
    base rule rejects them. Texts are counted whole, however long. Repeated rows are judged alike. Empty tables are fine. Columns of docs named like a result are replaced.
    """
    names = [f"doc.`{c}`" for c in docs.columns if c not in RESULTS]
    return judged(docs, labels, **options).select(*names, *RESULTS)
