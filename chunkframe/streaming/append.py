"""Appending micro-batches of a stream to an array along its first dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..catalog import open as open_node
from ..functions.session import shared_folder


def appender(store, path: str, value_col: str, order_col: str):
    """A ``foreachBatch`` function: the rows of a micro-batch, ordered by ``order_col`` (then
    by value), are appended to the rank-1 array at ``path``.  The new shape and the number
    of the batch go into the array's document at once, after the chunks: a batch that is
    replayed after a failure either finds its number, or writes the same cells again."""

    def run(batch: DataFrame, batch_id: int) -> None:
        array = open_node(store, path)
        if array.attrs.get("last_batch", -1) >= batch_id:
            return
        spark, folder = batch.sparkSession, shared_folder(batch.sparkSession, "stream-batch")
        # written once: ranges are sampled, and a lost executor must not deal them anew
        rows = batch.select(F.col(order_col).alias("_o"), F.col(value_col).alias("value")).repartitionByRange("_o").withColumn("_p", F.spark_partition_id())
        rows.write.parquet(folder)
        ranged = spark.read.schema(rows.schema).parquet(folder)
        sizes = ranged.groupBy("_p").count().withColumn("_before", F.coalesce(F.sum("count").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        number = F.row_number().over(W.partitionBy("_p").orderBy("_o", "value")) - 1
        cells = ranged.withColumn("_n", number).join(F.broadcast(sizes), "_p").select((F.col("_n") + F.col("_before")).alias("i0"), "value")
        if total := ranged.count():
            array.append_df(cells, total, attributes={"last_batch": batch_id})
        else:
            array.set_attr("last_batch", batch_id)

    return run
