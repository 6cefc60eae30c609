"""One row of every group of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import scratch_name, small, written


def text_key(text: Column) -> Column:
    """Tells the texts of one id apart (null: the empty text)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def one_of_each(df: DataFrame, id_col: str, text_col: str, rows: DataFrame) -> DataFrame:
    """``rows(doc_id, key, root)`` has the group of every row of ``df``, ``key`` being its
    ``text_key``.  Of each group the row with the least id stays (among texts of one id
    that with the least key; null ids come last), once, with its columns unchanged.

    Only what goes is looked up, by id and key: the rows of ``df`` are not shuffled while
    that fits a broadcast of checked size."""
    per = written(rows.groupBy("root", "doc_id", "key").agg(F.count("*").alias("n")), "ids-by-group")
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")
    chosen = written(per.groupBy(F.col("root").alias("r")).agg(F.min(first).alias("m")), "chosen")
    stays = F.col("doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("key") == F.col("m.key"))
    gid, gkey, times = (scratch_name(df, x) for x in ("gone_id", "gone_key", "times"))
    marked = per.join(chosen, F.col("root") == F.col("r")).withColumn("stays", stays).where(~F.col("stays") | (F.col("n") > 1))
    marked = small(written(marked.select(F.col("doc_id").alias(gid), F.col("key").alias(gkey), F.col("stays").alias(times)), "gone-or-repeated"))
    met = df.join(marked, df[id_col].eqNullSafe(F.col(gid)) & (text_key(df[text_col]) == F.col(gkey)), "left")
    alone = met.where(F.col(times).isNull()).select(*(df[c] for c in df.columns))
    several = met.where(F.col(times)).dropDuplicates([gid, gkey]).select(*(df[c] for c in df.columns))
    return alone.unionByName(several)
