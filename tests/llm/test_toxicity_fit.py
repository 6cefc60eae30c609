"""The toxicity model learns from every labelled row, in tasks, as from lists."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkframe.llm import labelled, queries, toxicity_fit
from chunkframe.llm.toxicity import Toxicity

GOOD = "the people are fine today and the sun is out for us"
BAD = "you are such a stup1d idiooot and we all know t h a t"


def made(n):
    """(text, y): words of their own, words of one label and words of both."""
    return [(f"{BAD if i % 3 == 0 else GOOD} {'abcdefghij'[i % 10] * 2}word {'l0ser' if i % 7 == 0 else 'friend'}", int(i % 3 == 0)) for i in range(n)]


def same(a, b):
    assert np.array_equal(a.cost, b.cost) and a.words.cost == b.words.cost
    assert a.weights.keys() == b.weights.keys()
    assert [*a.weights.values(), a.bias] == pytest.approx([b.weights[w] for w in a.weights] + [b.bias], abs=3e-6)


@pytest.mark.parametrize("parts", [1, 5])
def test_a_table_gives_the_model_of_lists(spark, parts, monkeypatch):
    monkeypatch.setattr(toxicity_fit, "BLOCK_ROWS", 7)
    rows = made(400) + [("", 0), (None, 1), ("é ☃ 5tup1d", 1)]
    df = spark.createDataFrame(rows, "text string, y int").repartition(parts)
    whole = Toxicity().fit([t or "" for t, _ in rows], [y for _, y in rows])
    assert len(whole.weights) > 5
    same(toxicity_fit.fit(df), whole)


def test_a_table_of_documents_of_this_fixture(spark, sf):
    rows = labelled.training(queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels"), "toxic", 5, 0)
    got = rows.collect()
    same(toxicity_fit.fit(rows, least_chi2=5.0), Toxicity().fit([r["text"] for r in got], [r["y"] for r in got], least_chi2=5.0))


@pytest.mark.parametrize("y", [0, 1])
def test_one_label_and_no_rows(spark, y):
    df = spark.createDataFrame([(GOOD, y)] * 9, "text string, y int")
    model = toxicity_fit.fit(df)
    assert (model.scores([GOOD, ""])[0] > 0.99) == (y == 1) and (model.scores([GOOD])[0] < 0.01) == (y == 0)
    none = toxicity_fit.fit(df.limit(0))
    assert none.weights == {} and list(none.scores(["", GOOD])) == [0.5, 0.5]


def test_training_rows_are_all(spark):
    docs = spark.createDataFrame([(i, "t" * 10 * (i % 7)) for i in range(60)] + [(1, "a"), (2, None), (None, "x")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (4, 7)], "doc_id bigint, toxic int")
    got = sorted((r["text"], r["y"]) for r in labelled.training(docs, labels, "toxic", 3, 1).collect())
    text = {**{i: "t" * 10 * (i % 7) for i in range(60)}, 1: "a", 2: ""}
    assert got == sorted((text[i], i % 2) for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1)
    assert labelled.training(docs, labels.limit(0), "toxic", 3, 1).count() == 0


def test_rows_beyond_a_sample_teach_the_query(spark, tmp_path):
    """A word that marks toxic rows, but too few of them for a sample of 1,500 to learn it."""
    n = 30_000
    text = "CASE WHEN id % 2 = 0 THEN 'a fine day here' WHEN id % 200 = 1 THEN 'a fine day here grobnak' ELSE 'a fine day here idiot' END"
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.expr(text).alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op4_noisy_channel_toxicity(spark, str(tmp_path)).join(docs, "doc_id")
    wrong = got.where("predicted != doc_id % 2").groupBy("text").count().collect()
    assert wrong == [] and got.count() == n


def test_held_out_texts_are_dropped_before_the_join(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(60)] + [(None, "x")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    plans, written = [], labelled.written

    def noted(df, what):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return written(df, what)

    monkeypatch.setattr(labelled, "written", noted)
    monkeypatch.setattr(labelled, "small", lambda df: df.hint("merge"))
    got = sorted((r["text"], r["y"]) for r in labelled.training(docs, labels, "toxic", 3, 1).collect())
    assert got == sorted((f"t{i}", i % 2) for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1)
    below = plans[-1][plans[-1].index("Join") :]
    assert "crc32" in below
