"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import shared_folder

#: Separators of words: ASCII space and the controls tab to carriage return.
SPACE_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet into the shared folder and
    read it back, so lost executors cost one re-read and not a re-computation.
    The files go when the session's file system closes."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of a batch that Python code works on at once.
PART_ROWS, PART_BYTES = 1000, 8 << 20


def in_parts(batches):
    """The Arrow ``batches`` of a task (Spark bounds them by bytes) in zero-copy slices of at
    most ``PART_ROWS`` rows and about ``PART_BYTES``, one row at least."""
    for batch in batches:
        step = max(1, min(PART_ROWS, batch.num_rows * PART_BYTES // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


#: Rows (of a few longs each) up to which a table is broadcast.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table of narrow rows, marked for a broadcast if it has at most so
    many rows; a larger one is left to a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fold(doc_id="doc_id", folds: int = 3):
    """crc32 of the id as text, modulo ``folds`` (null ids: null)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % F.lit(folds)


def words(text):
    """Array of the words of ``text`` (null text: empty array)."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(plain, " "), "")


def scratch_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` has not, whatever columns the caller added."""
    taken = {c.lower() for c in df.columns}
    name, k = f"_{stem}", 0
    while name.lower() in taken:
        k += 1
        name = f"_{stem}_{k}"
    return name


def without(df: DataFrame, *names: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without the columns that an output is about to replace (any case); columns
    in ``keep`` are the operator's inputs and stay."""
    gone = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in gone or c in keep))
