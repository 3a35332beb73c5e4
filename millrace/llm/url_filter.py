"""URL filters: a sort-merge range join of canonical keys with rule intervals.

A rule is a host and a path prefix; it fits the host and all its subdomains when the url's path starts with the rule's
path. With the labels of a host reversed (``a.example.net`` becomes ``net|example|a|``, as bytes) "host and subdomains" is one
interval of keys, and "path prefix" is one interval of paths. Intervals of prefixes are nested or apart, so a sweep over
sorted keys only needs the stack of rules that are open at each boundary.

The join runs in two sweeps, each sorted by Spark inside window partitions:

1. distinct hosts against rule hosts, grouped by top label, giving the stack of rule hosts above each host;
2. (rule host, path) against the path intervals of that rule host.

The longest of the fitting rules decides. A group (a top label, a rule host) with more than its share of keys is split
into salts, and its boundaries are repeated in each; a salt is never smaller than the group's number of boundaries, so
the repeated rows stay fewer than the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.shared import ascii_lower, cut, shuffle_partitions

#: Keys are bytes. These two occur in no UTF-8: the end of a label, and what sorts after every key that a prefix covers.
_END = "X'FE'"
_LAST = "X'FF'"
#: The rules of the registered query: host, path, verdict.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path (up to ``?`` or ``#``); both empty without ``://`` or for null."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """rules (host, path, verdict) as a table that Spark makes of literals."""
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    return spark.range(1).select(F.inline(rows))


def host_key(host: Column) -> Column:
    """The labels in reverse, each with the end of a label behind it."""
    labels = F.transform(F.reverse(F.split(host, r"\.", -1)), lambda x: F.concat(x.cast("binary"), F.expr(_END)))
    return F.aggregate(labels, F.expr("X''"), lambda sofar, x: F.concat(sofar, x))


def _top(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _boundaries(rules: DataFrame) -> DataFrame:
    """rules (grp, key, payload), one row a key -> (grp, key, stack): the rules open from this key on, outermost first.

    The rules above a rule are found by joining its prefixes, only of the lengths that occur in its group.
    """
    lengths = rules.groupBy("grp").agg(F.collect_set(F.length("key")).alias("lengths"))
    prefixes = rules.join(lengths, "grp").select(
        "grp", "key", F.explode(F.filter("lengths", lambda n: n <= F.length("key"))).alias("n")
    ).withColumn("prefix", F.substring(F.col("key"), F.lit(1), F.col("n")))
    above = rules.select("grp", F.col("key").alias("prefix"), "payload")
    stacks = prefixes.join(above, ["grp", "prefix"]).groupBy("grp", "key").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("n", "payload"))), lambda x: x.payload).alias("stack")
    )
    opened = stacks.select("grp", "key", "stack")
    closed = stacks.select("grp", F.concat("key", F.expr(_LAST)).alias("key"), F.slice("stack", F.lit(1), F.size("stack") - 1).alias("stack"))
    return opened.unionByName(closed)


def sweep(points: DataFrame, rules: DataFrame) -> DataFrame:
    """points (grp, key), distinct, each with the stack of rules (grp, key, payload) whose key is a prefix of its own; null or empty where none is."""
    spark = points.sparkSession
    bounds = _boundaries(rules)
    sizes = points.groupBy("grp").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    share = total // (2 * shuffle_partitions(spark)) + 1
    of_rules = bounds.groupBy("grp").agg(F.count("*").alias("bounds"))
    # At most 2 x shuffle partitions groups hold more than a share: a proven size to broadcast.
    hot = F.broadcast(
        sizes.where(F.col("n") > share).join(of_rules, "grp", "left")
        .select("grp", F.ceil(F.col("n") / F.greatest(F.lit(share), F.coalesce("bounds", F.lit(0)))).cast("int").alias("salts"))
    )
    salts = F.coalesce("salts", F.lit(1))
    events = points.join(hot, "grp", "left").select(
        "grp", F.pmod(F.xxhash64("key"), salts).cast("int").alias("salt"), "key", F.lit(True).alias("point"), F.lit(None).cast(bounds.schema["stack"].dataType).alias("stack")
    ).unionByName(
        bounds.join(hot, "grp", "left").select("grp", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "key", F.lit(False).alias("point"), "stack")
    )
    swept = Window.partitionBy("grp", "salt").orderBy("key", "point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("stack", F.last("stack", ignorenulls=True).over(swept)).where("point").select("grp", "key", "stack")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row for each row of pages: id, host, path, rule (host + path of the longest fitting rule, else null), verdict.

    rules: host, path, verdict. Of rules with equal host and path, block wins; of fitting rules with equal length, the
    one with the longer host. Without a fitting rule the verdict is `default`. A null url, or one without ``://``, has an
    empty host and path, which no rule fits. Repeated rows give repeated rows; other columns of pages aren't returned,
    so their names can't clash. Empty pages or rules are fine. Any character may be in an url, however long it is: it is
    judged whole. An empty label is a label, so ``net.`` is no host of ``net``.
    """
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rules = rules.where("host is not null and path is not null").groupBy(ascii_lower(F.col("host")).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    keys = cut(urls.select("host", "path").distinct())

    hosts = keys.select("host").distinct().withColumn("key", host_key(F.col("host")))
    top = _top(F.col("host")).alias("grp")
    stacks = sweep(
        hosts.select(top, "key"),
        rules.select("host").distinct().withColumn("key", host_key(F.col("host"))).select(top, "key", F.col("host").alias("payload")),
    )
    ruled = hosts.join(stacks, "key").select("host", F.explode("stack").alias("rule_host"))

    pairs = cut(keys.join(ruled, "host").select("host", "path", "rule_host"))
    fitting = sweep(
        pairs.select(F.col("rule_host").alias("grp"), F.col("path").cast("binary").alias("key")).distinct(),
        rules.select(F.col("host").alias("grp"), F.col("path").cast("binary").alias("key"), F.struct(F.concat("host", "path").alias("rule"), "verdict").alias("payload")),
    ).where(F.size("stack") > 0).select(F.col("grp").alias("rule_host"), F.col("key").cast("string").alias("path"), F.element_at("stack", -1).alias("best"))
    won = pairs.join(fitting, ["rule_host", "path"]).groupBy("host", "path").agg(
        F.max(F.struct(F.length("best.rule").alias("n"), F.length("rule_host").alias("m"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))).alias("best")
    )
    return urls.join(won, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
