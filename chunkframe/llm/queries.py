"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ._common import table
from .licence_scan import op8_sql
from .quality_rules_sql import OP3_SQL
from .secret_scan_sql import op9_sql

RANKS = "byte_bpe_50k.tiktoken"


def op1_byte_cnn_quality(spark, sf_dir):
    from .byte_cnn import ByteCNN, score
    from .labelled import held_out, sample

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = sample(documents, table(spark, sf_dir, "labels"), "quality", folds=3, held=1)
    model = ByteCNN().fit([t for t, _ in seen], [y for _, y in seen])
    scored = score(documents, model).drop("text")
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_simhash_near_dedup(spark, sf_dir):
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark, sf_dir):
    from .quality_rules import judge

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    slim = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(slim, output="_judged").select("doc_id", *(F.col(f"_judged.{x}") for x in names))


def op4_noisy_channel_toxicity(spark, sf_dir):
    from .labelled import held_out, training
    from .toxicity import score
    from .toxicity_fit import fit

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(training(documents, table(spark, sf_dir, "labels"), "toxic", folds=5, held=0))
    scored = score(documents, model).drop("text")
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_exact_topk(spark, sf_dir):
    from .topk_blocks import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_byte_bpe(spark, sf_dir):
    from .byte_bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op7_temperature_mixing(spark, sf_dir):
    from .mixing import readings

    return readings(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), target_entropy=0.9, budget_ratio=1.0)


def op8_licence_dice(spark, sf_dir):
    from .licence_scan import scan

    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_secret_ownership(spark, sf_dir):
    from .secret_scan import scan

    return scan(table(spark, sf_dir, "documents")).drop("all_spans")


# A dated block list; ``pages`` has no fetch time, so the capture of page
# n counts as fetched n modulo 365 days after the first day of 2024.
BLOCK_LIST = [
    ("free-bets.example.com", "2024-02-01", "add"),
    ("free-bets.example.com", "2024-05-01", "remove"),
    ("free-bets.example.com", "2024-08-15", "add"),
    ("therhe.example.net", "2024-01-10", "add"),
    ("blog.tionsh.example.net", "2024-03-01", "add"),
    ("blog.tionsh.example.net", "2024-03-20", "add"),
    ("blog.tionsh.example.net", "2024-09-01", "remove"),
    ("example.org", "2024-11-01", "add"),
    ("example.org", "2024-11-21", "remove"),
    ("ththed.example.org", "2024-06-01", "remove"),
]
_FETCHED = "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(CAST(page_id % 365 AS INT))"


def op10_url_temporal_lists(spark, sf_dir):
    from .url_lists import judge

    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(_FETCHED).alias("fetched_at"))
    entries = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, BLOCK_LIST))} AS t(domain, listed_on, action)")
    return judge(pages, entries).select("page_id", "host", "listed_domain", "kept")


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_cnn_quality, op2_simhash_near_dedup, op3_quality_rules, op4_noisy_channel_toxicity, op5_exact_topk,
        op6_byte_bpe, op7_temperature_mixing, op8_licence_dice, op9_secret_ownership, op10_url_temporal_lists,
    )
}

def op10_sql():
    rows = ", ".join(f"('{d}', TIMESTAMP '{t} 00:00:00', '{a}')" for d, t, a in BLOCK_LIST)
    return rf"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, nullif(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@]+?)[.]?(?::[0-9]*)?(?:[/?#].*)?$', 1), '') AS host,
           TIMESTAMP '2024-01-01 00:00:00' + CAST(page_id % 365 AS INTEGER) * INTERVAL 1 DAY AS ts FROM pages),
e(domain, ts, action) AS (VALUES {rows}),
met AS (SELECT p.rid, e.domain, e.action, row_number() OVER (PARTITION BY p.rid, e.domain ORDER BY e.ts DESC, e.action DESC) AS k
        FROM p JOIN e ON (p.host = e.domain OR (p.host LIKE '%.' || e.domain AND NOT regexp_matches(p.host, '^(\[.*\]|[0-9]+([.][0-9]+){{3}})$'))) AND e.ts <= p.ts),
best AS (SELECT rid, max_by(domain, length(domain)) AS listed_domain FROM met WHERE k = 1 AND action = 'add' GROUP BY rid)
SELECT page_id, host, listed_domain, listed_domain IS NULL AS kept FROM p LEFT JOIN best USING (rid)"""


ORACLE_SQL = {
    "op3_quality_rules": OP3_SQL,
    "op8_licence_dice": op8_sql(),
    "op9_secret_ownership": op9_sql(),
    "op10_url_temporal_lists": op10_sql(),
    "op5_exact_topk": """
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}
