"""Ranked search against SQL and a plain version."""

import math
import re
from collections import Counter

from compare import same_rows
from pyspark.sql import functions as F

from millrace.llm import lexical_search, queries
from millrace.llm.lexical_search import postings, ranked, search, store_postings

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(items, docs, top=20):
    counts = [Counter(terms(t)) for _, t in docs]
    n = [sum(c.values()) for c in counts]
    docs_with, total = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for (doc, _), c, k in zip(docs, counts, n, strict=True):
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * docs_with + 2) / (2 * df[t] + 1)))
                    score += w * (1000000000 * c[t] // (1000 * c[t] + 12 * (75 + 25 * k * docs_with // total)))
            if score > 0:
                found.append((-score, doc is not None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_equals_sql(spark, sf, duck):
    same_rows(queries.QUERIES["op13_lexical_search"](spark, sf), duck, queries.ORACLES["op13_lexical_search"])


def frames(spark, items, docs):
    return spark.createDataFrame([(*x, 9, "r") for x in items], "item_id long, text string, score int, term string"), spark.createDataFrame([(*x, 1, 2, "t") for x in docs], "doc_id long, text string, n int, rank int, term string")


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "_PART", 64)  # so that the long text is taken apart in pieces
    docs = [(k, f"alpha beta{k % 7} Gamma's {'delta ' * (k % 5)}ÉTÉ été x-{k}") for k in range(60)]
    docs += [(5, docs[5][1]), (5, "another text of row 5, alpha"), (None, "alpha beta1"), (70, None), (71, ""), (72, " ,.;\x00\x7f"), (73, "naïve日本 ß" * 40), (74, "alpha " * 3000 + "omega")]
    items = [(1, "ALPHA beta1 beta1 nowhere"), (1, "alpha"), (2, None), (3, "!!"), (None, "delta été"), (4, "ÉTÉ omega naïve日本"), (5, "unseen")]
    i, d = frames(spark, items, docs)
    want = plain(items, docs)
    assert got(ranked(i, d)) == want and len(want) > 60
    assert got(ranked(i, d, top=3)) == plain(items, docs, 3)
    path = lexical_search.shared_folder(spark) + "/odd-postings"
    stored = store_postings(postings(d, buckets=4), path)
    assert got(search(i, stored, buckets=4, broadcast_rows=0)) == want  # by shuffle
    one = search(i.where(F.col("text") == "alpha"), stored, buckets=4)
    assert got(one) == plain([(1, "alpha")], docs)


def test_empty(spark):
    i, d = frames(spark, [(1, "a b")], [(1, "a b c")])
    for x, y in ((i.limit(0), d), (i, d.limit(0)), (i, d.where("false").unionByName(d.withColumn("text", F.lit(None).cast("string")))), (i.withColumn("text", F.lit("-")), d)):
        assert ranked(x, y).collect() == []
    assert ranked(i, d).columns == ["item_id", "rank", "doc_id", "score"]


def test_postings_hold_every_term(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted((r.doc_id, t, c, sum(x.values())) for r in docs.collect() for x in [Counter(terms(r.text))] for t, c in x.items())
    stored = store_postings(postings(docs), lexical_search.shared_folder(spark) + "/all-postings")
    assert sorted((r.id, r.term, r.tf, r.n) for r in stored.collect()) == want
    assert stored.where("lead").count() == len({d for d, *_ in want})
