"""Nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import zlib

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from chunkframe.llm import byte_bpe, labelled, licence_scan, mixing, quality_rules, secret_scan, simhash, topk_blocks, url_lists
from chunkframe.llm.byte_cnn import ByteCNN
from chunkframe.llm.byte_cnn import score as cnn_score
from chunkframe.llm.toxicity import Toxicity
from chunkframe.llm.toxicity import score as toxic_score

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOXIC = Toxicity().fit(["you idiot"] * 5 + ["fine day"] * 5, [1] * 5 + [0] * 5)
ALL = {
    "cnn": lambda d: cnn_score(d, ByteCNN()),
    "simhash": simhash.near_duplicates,
    "rules": quality_rules.judge,
    "toxicity": lambda d: toxic_score(d, TOXIC),
    "bpe": lambda d: byte_bpe.decode(byte_bpe.encode(d, RANKS, outputs=("n_tokens", "ids", "starts", "ends")), RANKS, "ids"),
    "mix": lambda d: mixing.mix(d, target_entropy=0.95),
    "licence": licence_scan.scan,
    "secrets": secret_scan.scan,
    "urls": lambda d: url_lists.judge(d.withColumns({"url": F.concat(F.lit("http://a.example.com/"), "doc_id"), "fetched_at": F.lit("2024-03-01")}), d.sparkSession.createDataFrame([("example.com", "2024-01-01", "add")], "domain string, listed_on string, action string")),
}


@pytest.mark.parametrize("name", ALL)
def test_one_row_per_row(edge, name):
    assert ALL[name](edge).count() == edge.count()


@pytest.mark.parametrize("name", ALL)
def test_empty_table(edge, name):
    df = ALL[name](edge.limit(0))
    assert df.count() == 0


@pytest.mark.parametrize("stage", [quality_rules.filtered, simhash.dedupe, secret_scan.redact, lambda d: mixing.realise(d, max_repetition=1.5)])
def test_stages_keep_columns(edge, stage):
    assert stage(edge).columns == edge.columns
    assert stage(edge.limit(0)).count() == 0
    assert stage(edge).count() > 0


def test_readings_of_edge_rows(edge):
    copies = [r["copies"] for r in mixing.mix(edge, target_entropy=0.0).collect()]
    assert mixing.readings(edge, target_entropy=0.0).count() == sum(max(c, 1) for c in copies)
    assert mixing.readings(edge.limit(0), target_entropy=0.5).count() == 0


def test_missing_and_empty_texts_score_alike(edge):
    for f in (ALL["cnn"], ALL["toxicity"]):
        got = {r["doc_id"]: r["score"] for r in f(edge.where("doc_id in (1, 2)")).collect()}
        assert got[1] == got[2] and 0 <= got[1] <= 1


def test_topk_skips_unsound_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [1.0]), (5, [0.5, 0.5]), (5, [0.5, 0.5]), (None, [1.0, 1.0]), (7, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"score": F.lit(1), "segment": F.lit(2)})
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk_blocks.top_k(df, F.col("vec_id") % 50 == 0).collect())
    half = 128 * 256
    assert got == [(0, 1, 5, half), (0, 2, 5, half), (0, 3, 50, half), (50, 1, 0, half), (50, 2, 5, half), (50, 3, 5, half)]
    again = [(50, [1.0])] * 2 + [(50, [2.0])] + [(i, [float(i)]) for i in range(1, 8)]
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in topk_blocks.top_k(df.sparkSession.createDataFrame(again, "vec_id bigint, embedding array<float>"), F.col("vec_id") % 50 == 0).collect())
    assert got == sorted((k + 1, 7 - k, 65536 * x * (7 - k)) for k in range(5) for x in (1, 2))
    assert topk_blocks.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_url_edges(spark):
    rows = [(0, None, "2024-01-05"), (1, "", "2024-01-05"), (2, "no address", "2024-01-05"), (3, "HTTP://Sub.Bad.Example.com:80/x?y#z", None), (4, "//user@bad.example.com./", "2024-01-02"),
            (5, "http://bad.example.com", "2024-01-03"), (5, "http://bad.example.com", "2024-01-03"), (6, "http://bad.example.com", "2024-01-04"), (7, "http://notbad.example.com", "2024-01-02")]
    captures = spark.createDataFrame(rows, "id int, url string, fetched_at string").withColumn("host", F.lit("x"))
    log = [("bad.example.com", "2024-01-02", "add"), ("bad.example.com", "2024-01-03", "add"), ("bad.example.com", "2024-01-04", "add"), ("bad.example.com", "2024-01-04", "remove"), (None, "2024-01-01", "add"), ("x", None, "add")]
    entries = spark.createDataFrame(log, "domain string, listed_on string, action string")
    got = [(r["id"], r["host"], r["kept"]) for r in url_lists.judge(captures, entries).orderBy("id").collect()]
    assert got == [(0, None, True), (1, None, True), (2, None, True), (3, "sub.bad.example.com", True), (4, "bad.example.com", False), (5, "bad.example.com", False), (5, "bad.example.com", False), (6, "bad.example.com", True), (7, "notbad.example.com", True)]
    assert url_lists.judge(captures, entries.limit(0)).where("kept").count() == len(rows)


def test_url_addresses(spark):
    """Addresses are whole hosts: neither parts of them nor IPv6 groups are domains."""
    urls = ["http://10.0.0.1/x", "http://10.0.0.1:80/", "http://[2001:DB8::1]:8080/x", "http://[::1]", "http://a.0.1/x"]
    captures = spark.createDataFrame(list(enumerate(urls)), "id int, url string").withColumn("fetched_at", F.lit("2024-03-01"))
    log = [(d, "2024-01-01", "add") for d in ("0.1", "10.0.0.1", "[::1]", "db8::1]")]
    got = url_lists.judge(captures, spark.createDataFrame(log, "domain string, listed_on string, action string")).orderBy("id").collect()
    assert [(r["host"], r["listed_domain"]) for r in got] == [("10.0.0.1", "10.0.0.1"), ("10.0.0.1", "10.0.0.1"), ("[2001:db8::1]", None), ("[::1]", "[::1]"), ("a.0.1", "0.1")]
    none = url_lists.judge(captures, spark.createDataFrame(log[:1], "domain string, listed_on string, action string"))
    assert none.where("not kept").count() == 1


def test_pipeline_on_edge_rows(edge, tmp_path):
    """All stages one after the other: nulls, empty and repeated rows, clashing columns; an
    empty table."""
    for name, df in (("some", edge), ("none", edge.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = corpus_pipeline.run(edge.sparkSession, f"{tmp_path}/some").collect()
    assert got and 10 in {r["doc_id"] for r in got} and all(r["text"] for r in got)
    assert corpus_pipeline.run(edge.sparkSession, f"{tmp_path}/none").count() == 0


def test_labelled_samples(spark):
    docs = spark.createDataFrame([(i, "t" * 10 * (i % 7)) for i in range(60)] + [(1, "a"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    whole = labelled.sample(docs, labels, "toxic", 3, 1)
    assert len(whole) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(60))
    few = labelled.sample(docs, labels, "toxic", 3, 1, per_label=5)
    assert sum(y for _, y in few) == 5 and len(few) == 10
    short = labelled.sample(docs, labels, "toxic", 3, 1, total_bytes=200)
    assert 0 < sum(len(t) for t, _ in short) <= 200 and len(short) < len(whole)
    assert labelled.sample(docs, labels.limit(0), "toxic", 3, 1) == []
