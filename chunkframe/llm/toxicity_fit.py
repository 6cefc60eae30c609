"""The toxicity model of a whole table: every row counts, in tasks.

Three passes over the rows: words are counted; spans are restored and the features of each
row written; features are counted by label.  Rows of equal kept features become one row with
two counts, over which the logistic model is fitted: a job per Newton step returns sums whose
size depends on the number of features alone.  To the driver come the ``WordModel.MOST`` words,
the kept features and these sums.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import in_parts, written
from .toxicity import LEAST_CHI2, LEAST_DOCS, MOST_FEATURES, PENALTY, CharModel, Toxicity, WordModel, chi_square, in_slices, least_loss, loss_sums, words_of

#: Words that a task counts at once, before it passes them on.
TALLY_WORDS = 200_000
#: Rows that become a dense block at once; files (and so about tasks) of the rows to fit on.
BLOCK_ROWS, FIT_FILES = 1000, 16


def _slices(batches):
    """Lower-cased texts and labels of a task."""
    for batch in in_parts(batches):
        y, at = batch.column("y").to_numpy(zero_copy_only=False), 0
        for texts in in_slices(batch.column("text").to_pylist()):
            yield [t.lower() for t in texts], y[at : at + len(texts)]
            at += len(texts)


def _count_words(batches):
    words = Counter()

    def tallied():
        return pa.RecordBatch.from_pydict({"word": pa.array(words.keys(), pa.string()), "n": pa.array(words.values(), pa.int64())})

    for texts, _ in _slices(batches):
        for t in texts:
            words.update(words_of(t))
            if len(words) > TALLY_WORDS:
                yield tallied()
                words.clear()
    yield tallied()


def _count_pairs(batches):
    total = np.zeros(27 * 27, np.int64)
    for batch in batches:
        total += CharModel.pairs(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()))
    yield pa.RecordBatch.from_pydict({"pairs": pa.array([total.tolist()], pa.list_(pa.int64()))})


def _language(rows: DataFrame) -> Toxicity:
    """A model that restores, by the words of all rows."""
    words = written(rows.mapInArrow(_count_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    most = words.orderBy(F.desc("n"), "word").limit(WordModel.MOST).collect()
    pairs = [np.array(r["pairs"], np.int64) for r in words.mapInArrow(_count_pairs, "pairs array<bigint>").collect()]
    model = Toxicity()
    model.cost = CharModel.costs(sum(pairs, np.zeros(27 * 27, np.int64)))
    model.words = WordModel({r["word"]: r["n"] for r in most}, words.agg(F.sum("n")).first()[0] or 0)
    return model


def _by_label(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of label 0 (``a``) and 1 (``b``) of each key."""
    return df.groupBy(*keys).agg(F.sum(1 - F.col("y")).alias("a"), F.sum("y").alias("b"))


def fit(rows: DataFrame, least_docs: int = LEAST_DOCS, most: int = MOST_FEATURES, least_chi2: float = LEAST_CHI2, penalty: float = PENALTY) -> Toxicity:
    """The model of all ``rows`` (text, and y: 0 or 1), a written table, as ``Toxicity.fit`` makes
    it of lists."""
    model = _language(rows)
    got = _by_label(rows).first()
    if got["a"] is None:
        return model
    n = np.clip([got["a"], got["b"]], 1, None)

    def featured(batches):
        for texts, y in _slices(batches):
            found = [list(model.features(d)) for d in model.restored(texts)]
            yield pa.RecordBatch.from_pydict({"y": pa.array(y, pa.int32()), "features": pa.array(found, pa.list_(pa.string()))})

    def ranked(batches):
        for batch in batches:
            sign = chi_square(batch.column("a").to_numpy(zero_copy_only=False), batch.column("b").to_numpy(zero_copy_only=False), n)
            yield pa.RecordBatch.from_pydict({"feature": batch.column("feature"), "sign": pa.array(abs(sign), pa.float64())})

    docs = written(rows.mapInArrow(featured, "y int, features array<string>"), "features")
    seen = _by_label(docs.select("y", F.explode("features").alias("feature")), "feature").where(F.col("a") + F.col("b") >= least_docs)
    best = seen.mapInArrow(ranked, "feature string, sign double").where(F.col("sign") >= least_chi2).orderBy(F.desc("sign"), "feature").limit(most)
    kept = [r["feature"] for r in best.collect()]

    def reduced(batches):
        """The kept features of each row: their sorted numbers, as bytes."""
        value_set = pa.array(kept, pa.string())
        for batch in batches:
            lists = batch.column("features")
            at = pc.fill_null(pc.index_in(pc.list_flatten(lists), value_set=value_set), -1).to_numpy(zero_copy_only=False)
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[at >= 0]
            at = at[at >= 0].astype(np.int16)
            at = at[np.lexsort((at, row))]
            ends = np.cumsum(np.bincount(row, minlength=batch.num_rows))
            numbers = [at[lo:hi].tobytes() for lo, hi in zip([0, *ends[:-1]], ends)]
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "numbers": pa.array(numbers, pa.binary())})

    alike = written(_by_label(docs.mapInArrow(reduced, "y int, numbers binary"), "numbers").coalesce(FIT_FILES), "alike")
    size = len(kept) + 1

    def sums(w):
        def run(batches):
            total = np.zeros(1 + size + size * size)
            for batch in batches:
                for lo in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(lo, BLOCK_ROWS)
                    numbers = part.column("numbers").to_pylist()
                    x = np.zeros((part.num_rows, size))
                    x[:, 0] = 1
                    x[np.repeat(np.arange(len(numbers)), [len(b) // 2 for b in numbers]), np.frombuffer(b"".join(numbers), np.int16).astype(int) + 1] = 1
                    total += loss_sums(x, np.column_stack([part.column(c).to_numpy(zero_copy_only=False) for c in "ab"]), n, w)
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

        return sum(np.frombuffer(bytes(r["sums"])) for r in alike.mapInArrow(run, "sums binary").collect())

    return model.weighted(kept, least_loss(sums, size, penalty))
