"""URL rules, quality rules and mixing against plain definitions."""

import collections
import math
import random
import re

import pytest

from millrace.llm.mixing import mix_sources, plan
from millrace.llm.quality_rules import BASE_FAILED, quality_rules, text_counts
from millrace.llm.url_filter import RULES, judge_urls, rule_table
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({i: i + 32 for i in range(65, 91)})
    fitting = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fitting)[2:] if fitting else (None, "allow")))


def test_urls(spark):
    random.seed(1)
    rules = [*RULES, ("a.example.net", "/en/x", "block"), ("a.example.net", "/en/xy", "allow"), ("b.a.example.net", "/", "allow"), ("com", "/q", "block"), ("com", "/q/w/e", "allow")]
    urls = [None, "", "nothing", "://", "http://", "HTTP://EXAMPLE.NET", "http://net/", "http://Net/x", "http://xnet/", "x://a.net:80/", "http://u@example.net/en/", "ftp://example.net/en/?q://y/", "http://.net/", "http://a..net/", "http://net./", "http://\u00c4.net/\u00e4", "x://net\x01x", "x://a\x01b.net", "x://example.net/en/\U0010ffff/a", "x://example.net/en/\x01", "x://net\x00/", "x://\U0010ffff.net/", "x" * 100_000 + "://net/" + "y" * 100_000]
    urls += [f"http://{h}{p}" for h in ("net", "org", "example.com", "b.a.example.net", "a.example.net", "z.b.a.example.net", "org.com") for p in ("", "/", "/en", "/en/", "/en/x?", "/en/xyz#", "/de/1", "/fr/", "/q", "/q/w/e/r", "/en/w")]
    urls += [random.choice(urls) for _ in range(100)]
    pages = spark.createDataFrame([(k, u, "c", "h", "g") for k, u in enumerate(urls)], "page_id int, url string, grp string, host string, key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {k: plain_verdict(u, rules) for k, u in enumerate(urls)}


def test_urls_repeated_rules_and_empty(spark):
    rules = spark.createDataFrame([("NET", "/", "allow"), ("net", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "x://net/"), (1, "x://net/"), (None, "x://org/")], "page_id int, url string")
    assert sorted((r.page_id or 0, r.rule, r.verdict) for r in judge_urls(pages, rules).collect()) == [(0, None, "allow"), (1, "net/", "block"), (1, "net/", "block")]
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert [r.verdict for r in judge_urls(pages, rules.limit(0)).collect()] == ["allow"] * 3


def plain_counts(text):
    t = text or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    n = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    random.seed(4)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a a a a", "a b c a b c", "x\nx\n x\nx", "é# 日本 |<", "a\u00a0b c", "w " * 30_000, " ".join(str(k % 5000) for k in range(20_000))]
    texts += [" ".join(random.choice("abc") + random.choice(["", "\n"]) for _ in range(random.randint(1, 40))) for _ in range(60)]
    docs = spark.createDataFrame([(k, t, 0, "w") for k, t in enumerate(texts)], "doc_id int, text string, n_words int, _quality string")
    counted = text_counts(docs).selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", f"{BASE_FAILED} as failed").collect()
    for r in counted:
        want = plain_counts(texts[r.doc_id])
        assert tuple(r)[1:6] == want, texts[r.doc_id][:50]
        assert r.failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_rules_are_learned(spark):
    random.seed(6)
    clean = lambda: " ".join("".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    dirty = lambda: " ".join("".join(random.choice("abcdefgh") for _ in range(5)) + "##" for _ in range(80))
    rows = [(k, dirty() if k % 5 == 0 else clean(), "old") for k in range(400)] + [(1000, None, "old"), (1001, "", "old"), (3, clean(), "old")]
    docs = spark.createDataFrame([(*r, 0, "x", 5) for r in rows], "doc_id int, text string, kept string, n_lines int, id string, n_words int")
    labels = spark.createDataFrame([(k, int(k % 5 > 0)) for k in range(300)] + [(0, 1), (7, None), (None, 0)], "doc_id int, quality int")
    got = quality_rules(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.kept == (bool(r.text) and r.doc_id % 5 > 0 or r.doc_id == 3), r.doc_id
        assert (r.rule is not None) == (not r.base_failed and not r.kept)
    assert all(r.kept != r.base_failed for r in quality_rules(docs, labels.limit(0)).collect())
    assert quality_rules(docs.limit(0), labels).count() == 0


def test_good_documents_stay(spark, sf):
    from millrace.llm.queries import op2_quality_rules

    judged = op2_quality_rules(spark, sf.replace("sf0.001", "sf0.01")).join(spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/labels.parquet"), "doc_id").where("not base_failed")
    good, bad = judged.where("quality = 1"), judged.where("quality = 0")
    assert good.where("kept").count() >= 0.99 * good.count() and bad.where("not kept").count() >= 0.9 * bad.count()


def sums_of(tokens):
    total = sum(tokens)
    return lambda exponents: [(sum((n / total) ** a for n in tokens), sum((n / total) ** a * math.log2(n / total) for n in tokens)) for a in exponents]


def plan_of(tokens, **options):
    return plan((min(tokens), max(tokens), sum(tokens)), sums_of(tokens), **options)


def test_plan():
    tokens = [900, 100]
    assert plan_of(tokens).exponent == 1 and plan_of(tokens).budget == 1000
    halved = plan_of(tokens, max_repeats=2.0)
    assert abs(halved.budget * halved.weight(0.1) / 100 - 2) < 0.02 and abs(halved.budget * halved.weight(0.9) - 900) < 1 and halved.weight(0.0) == 0
    assert abs(plan_of(tokens, target_entropy=1.0).weight(0.9) - 0.5) < 1e-6
    between = plan_of(tokens, target_entropy=0.8)
    p = between.weight(0.9)
    assert 0 < between.exponent < 1 and abs(-p * math.log2(p) - (1 - p) * math.log2(1 - p) - 0.8) < 1e-6
    assert plan((None, None, 0), None, max_repeats=2).budget == 0 and plan_of([100], budget=250).budget == 250
    both = plan_of(tokens, target_entropy=1.0, max_repeats=2.0)
    assert abs(both.exponent - halved.exponent) < 1e-9


@pytest.mark.parametrize("budget", [None, 3000, 20_000])
def test_mix(spark, budget, monkeypatch):
    """Every row of the result, from the hashes that order blocks and documents."""
    from millrace.llm import mixing

    monkeypatch.setattr(mixing, "_SLICE", 3)  # several slices of blocks
    random.seed(8)
    rows = [(k, " ".join(["w"] * random.randint(1, 30)), "big" if k % 3 else ("small" if k % 2 else None), "p") for k in range(600)] + [(5000, "", "big", "p"), (5001, None, "void", "p"), (3, "w w", "big", "p"), (3, "w w", "big", "p"), (None, "w", "big", "p")]
    docs = spark.createDataFrame([(*r, "a", 0, 1) for r in rows], "doc_id int, text string, source string, turn string, last string, s int, pass int")
    repeats = None if budget else 3.0
    got = mix_sources(docs, max_repeats=repeats, budget=budget, block_docs=20)
    assert got.columns == ["doc_id", "text", "source", "turn", "last", "s", "n_tokens", "pass", "block", "position"]

    tokens, number = collections.Counter(), collections.Counter()
    for _, t, s, _ in rows:
        tokens[s] += len((t or "").split())
        number[s] += 1
    mix = plan_of([n for n in tokens.values() if n], max_repeats=repeats, budget=budget)
    total, hashed = sum(tokens.values()), lambda df, *of: {tuple(r)[:-1]: r.h for r in df.select(*of[0], F.xxhash64(*of[1]).alias("h")).collect()}
    block_hash = {d: h for (d,), h in hashed(docs, ["doc_id"], ["doc_id", F.lit(11)]).items()}
    key_hash = {d: h for (d,), h in hashed(docs, ["doc_id"], ["doc_id", F.lit(13)]).items()}
    blocks = {s: max(1, round(n / 20)) for s, n in number.items()}
    grid = spark.createDataFrame([(s, b, p) for s, n in blocks.items() for b in range(n) for p in range(60)], "source string, block int, pass int")
    turn = hashed(grid, ["source", "block", "pass"], ["block", "source", "pass", F.lit(12)])
    want = []
    for s, total_s in tokens.items():
        owed = int(mix.budget * mix.weight(total_s / total) + 1e-6)
        passes, rest = divmod(owed, total_s) if total_s else (1, 0)
        members = collections.defaultdict(list)
        for d, t, source, _ in rows:
            if source == s:
                members[block_hash[d] % blocks[s]].append((key_hash[d], -1 if d is None else d, len((t or "").split()), d))
        for p in range(passes + (rest > 0)):
            left = rest if p == passes else math.inf
            for position, b in enumerate(sorted(members, key=lambda b: turn[s, b, p])):
                size = sum(n for _, _, n, _ in members[b])
                if left <= 0:
                    break
                if size <= left:
                    want += [(d, s, n, p, b, position) for _, _, n, d in members[b]]
                else:
                    for k, d in sorted({(k, d) for k, d, _, _ in members[b]}):
                        here = [(d0, s, n, p, b, position) for k1, d1, n, d0 in members[b] if (k1, d1) == (k, d)]
                        if sum(x[2] for x in here) > left:
                            break
                        left -= sum(x[2] for x in here)
                        want += here
                    left = 0
                    break
                left -= size
    have = [(r.doc_id, r.source, r.n_tokens, r["pass"], r.block, r.position) for r in got.collect()]
    assert sorted(map(repr, have)) == sorted(map(repr, want))
    if budget is None:
        assert {r[0] for r in have} == {r[0] for r in rows}


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id int, text string, source string")
    assert sorted((r.doc_id, r["pass"]) for r in mix_sources(docs).collect()) == [(1, 0), (2, 0)] and mix_sources(docs.limit(0)).count() == 0
    many = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', 1 + cast(id % 7 as int)) as text", "cast(id as string) as source")  # a source for each document
    assert mix_sources(many, max_repeats=2.0).groupBy("doc_id").count().agg(F.min("count"), F.max("count")).first() == (1, 2)
