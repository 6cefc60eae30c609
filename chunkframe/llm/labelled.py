"""Labelled rows for the classifiers, whole or as bounded samples, and their held-out folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import fold, small, written

#: Rows of each label that a classifier is fitted on, at most.
SAMPLE_PER_LABEL = 1500
#: Bytes of all their texts, at most.
SAMPLE_BYTES = 128 << 20


def held_out(folds: int, held: int, doc_id: str = "doc_id") -> Column:
    """True for the rows that no model may learn from; a null id is never learnt from."""
    return F.coalesce(fold(doc_id, folds) == held, F.lit(True))


def _known(labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    return labels.where(F.col(label).isin(0, 1) & ~held_out(folds, held)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def training(documents: DataFrame, labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """Every (text, y) of the labels 0 and 1 outside the held-out fold, written to the shared
    folder.  Null labels and ids are skipped; null texts are empty; of several texts of one id
    the least is taken."""
    known = written(_known(labels, label, folds, held), "labels")
    texts = documents.where(~held_out(folds, held)).select("doc_id", "text").join(small(known), "doc_id")  # held-out texts need no shuffle
    one = texts.groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return written(one.select("text", "y"), "training")


def sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_label: int = SAMPLE_PER_LABEL,
           total_bytes: int = SAMPLE_BYTES) -> list[tuple[bytes, int]]:
    """At most ``per_label`` (text, label) of each label 0 and 1 outside the held-out fold,
    chosen by a hash of the id, and in that order no more whole texts than ``total_bytes``
    hold.  Null labels and ids are skipped; null texts are empty; of several texts of one id
    the least is taken; without labels the sample is empty."""
    known = _known(labels, label, folds, held)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("y = 0").orderBy(*order).limit(per_label).unionByName(known.where("y = 1").orderBy(*order).limit(per_label))
    texts = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # 2 * per_label rows at most
    one = texts.groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit("")).cast("binary")).alias("text"))
    size = F.sum(F.octet_length("text")).over(W.orderBy(*order))  # one task, of 2 * per_label rows at most
    rows = one.withColumn("size", size).where(F.col("size") <= total_bytes).collect()
    return [(bytes(r["text"]), r["y"]) for r in sorted(rows, key=lambda r: r["doc_id"])]
