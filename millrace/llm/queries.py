"""The registered queries of this subpackage, with production parameters, over their whole tables; SQL where it can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import byte_bpe
from millrace.llm.exact_dedup import exact_groups
from millrace.llm.html_text import extract_pages
from millrace.llm.language_id import identify
from millrace.llm.language_model import score_texts
from millrace.llm.lexical_search import ranked
from millrace.llm.line_dedup import drop_repeated_lines
from millrace.llm.mixing import mix_sources
from millrace.llm.quality_rules import quality_rules
from millrace.llm.sentencepiece_viterbi import decode_documents, encode_documents
from millrace.llm.shared import table
from millrace.llm.simhash import near_groups
from millrace.llm.sort_means import sort_means
from millrace.llm.url_filter import RULES, judge_urls, rule_table

#: The vocabularies of the registered queries and the pipeline.
MODEL = os.environ.get("MILLRACE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
RANKS = os.environ.get("MILLRACE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), "crc32(cast(doc_id as string)) % 10 = 0")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), MODEL)
    back = decode_documents(encoded, MODEL)
    return back.select("doc_id", "ids", "n_ids", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), max_repeats=2.0)
    return mixed.select("doc_id", "source", "n_tokens", "pass", "block", "position")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), "crc32(cast(doc_id as string)) % 3 = 1")


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means(table(spark, sf_dir, "embeddings"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), RANKS).drop("text")
    back = byte_bpe.decode_documents(encoded, RANKS)
    return back.select("doc_id", F.col("n_ids").alias("n_tokens"), F.sha2(byte_bpe.packed_ids(F.col("ids")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


_ALL = (
    op1_url_filter, op2_quality_rules, op3_lm_score, op4_sentencepiece, op5_simhash, op6_line_dedup, op7_html_text, op8_mix_sources, op9_exact_dedup, op10_language_id,
    op11_sort_means, op12_byte_bpe, op13_lexical_search,
)
QUERIES = {f.__name__: f for f in _ALL}


def _sort_means_sql(k: int = 8, rounds: int = 10) -> str:
    """Each round as two tables: the best (distance, centroid) of each vector as one number, and the centroids that follow."""
    steps = [
        """kept as materialized (
            select vec_id, row_number() over () as r, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v
            from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)""",
        "cells as materialized (select r, unnest(v) as x, generate_subscripts(v, 1) as i from kept)",
        f"c0 as materialized (select row_number() over (order by sha256('3:' || vec_id)) - 1 as c, v from kept order by sha256('3:' || vec_id) limit {k})",
    ]
    for n in range(rounds + 1):
        steps.append(f"""a{n} as materialized (
            select r, min(list_sum(list_transform(list_zip(kept.v, c{n}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint * {k} + c) as best from kept, c{n} group by r)""")
        if n < rounds:
            steps.append(f"""c{n + 1} as materialized (
            select c, coalesce(w.v, c{n}.v) as v from c{n} left join (
                select c, list(((s - ((s % m) + m) % m) // m)::bigint order by i) as v
                from (select best % {k} as c, i, sum(x) as s, count(*) as m from a{n} join cells using (r) group by 1, 2) group by c) as w using (c))""")
    return f"""with {", ".join(steps)}
        select vec_id, (best % {k})::int as cluster, best // {k} as distance, (sum(best // {k}) over (partition by best % {k}))::bigint as cluster_inertia,
               (sum(best // {k}) over ())::bigint as inertia, sha256(array_to_string(list_transform(c{rounds}.v, lambda x: x::varchar), ',')) as centroid_sha256
        from a{rounds} join kept using (r) join c{rounds} on c = best % {k}"""


_RULE_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLES = {
    "op1_url_filter": f"""
        with cut as (select page_id, coalesce(url, '') as u, instr(coalesce(url, ''), '://') as pos from pages),
        rest as (select page_id, case when pos > 0 then substr(u, pos + 3) else '' end as r from cut),
        part as (
            select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') as path
            from rest),
        rules(h, p, v) as (values {_RULE_VALUES}),
        best as (select host, path, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as verdict
                 from (select distinct host, path from part) join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by host, path)
        select page_id, part.host, part.path, rule, coalesce(verdict, 'allow') as verdict
        from part left join best on part.host = best.host and part.path = best.path""",
    "op6_line_dedup": """
        with d as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
        k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from d),
        r as (select key, max(doc_id) as keep_id from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
        m as (select doc_id, i, line, keep_id is not null and keep_id <> doc_id as gone from k left join r using (key))
        select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
        from m group by doc_id""",
    "op9_exact_dedup": """
        with d as (select doc_id, coalesce(text, '') as t from documents),
        g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
        select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(d.t) as text_sha256 from d join g on d.t = g.t""",
    "op11_sort_means": _sort_means_sql(),
    "op13_lexical_search": r"""
        with t as materialized (
            select doc_id, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
            from (select doc_id, text, row_number() over () as r from documents)),
        c as (select doc_id, r, term, count(*) as tf from t group by doc_id, r, term),
        p as materialized (select *, (sum(tf) over (partition by r))::bigint as n from c),
        g as (select count(distinct r) as docs, sum(tf)::bigint as terms from p),
        f as (select term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint as w from (select term, count(*) as df from p group by term), g),
        q as (select item_id, k, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
              from (select item_id, text, row_number() over () as k from benchmark)),
        s as (select item_id, k, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::bigint as score
              from q join p using (term) join f using (term) cross join g group by item_id, k, doc_id, r)
        select item_id, rank::int as rank, doc_id, score
        from (select *, row_number() over (partition by k order by score desc, doc_id, r) as rank from s where score > 0) where rank <= 20""",
}
