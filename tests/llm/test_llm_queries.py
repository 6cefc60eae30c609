"""Queries against their SQL, and the pipeline against plain Python."""

import hashlib
import re

import duckdb
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from chunkframe.llm import queries

TABLES = ("documents", "embeddings", "pages", "labels")


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    done = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in done.description]
    want = sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in done.fetchall())
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.select(*columns).collect())
    assert got == want


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline(spark, sf):
    """What the rules and the near-duplicates keep, the redaction, and the token ids."""
    from test_near_text import plain
    from test_operators import plain_base

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    kept = {r[0] for r in con.execute(f"select doc_id from ({queries.ORACLE_SQL['op3_quality_rules']}) where kept").fetchall()}
    docs = {i: t for i, t in zip(*(pq.read_table(f"{sf}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text"))) if i in kept}
    ids = sorted(docs)
    stay = [ids[i] for i in plain([docs[i] for i in ids])]  # five words, 0.8
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == set(stay)
    assert len(got) >= len(stay)
    import public_tokenizers
    import tiktoken

    from chunkframe.llm.byte_bpe import read_ranks

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in got:
        assert not plain_base(r["text"]) and r["ids"] == enc.encode_ordinary(r["text"]) and r["n_tokens"] == len(r["ids"])
        if not plain_base(docs[r["doc_id"]]):
            assert hashlib.sha256(r["text"].encode()).digest() == hashlib.sha256(docs[r["doc_id"]].encode()).digest()
