"""SimHash near-duplicates: fingerprints of word shingles linked by BK-trees.

A link joins two texts whose 64-bit fingerprints differ in at most ``radius`` bits.
Fingerprints within the radius are equal in one of ``radius + 1`` bands, so every
distinct fingerprint goes, for each band, into the shard tree of that band's bucket and
probes that tree; a bucket's tree holds the fingerprints of many band values, and the
walk alone decides what is linked.  A task emits the spanning forest of its links and
not every pair.

Defined results: a null or empty text has no words and fingerprint zero, which is
linked like any other; null ids take part with their text, and a component's id is
its least id that isn't null (null if all are); repeated rows stay; empty tables
give empty tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import in_parts, written
from .bktree import SHARD_ROWS, shards, spanning, walk
from .components import components
from .keep import one_of_each, text_key

SEED = 42


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64 majority bits of the XXH64 hashes of the shingles of lower-cased words."""
    import xxhash

    found = (text or b"").lower().split()  # A-Z only, and the ASCII separators
    if not found:
        return 0
    norm = b" ".join(found)
    n = len(found)
    hash64 = xxhash.xxh64_intdigest
    if n <= shingle:
        return hash64(norm, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    total = np.zeros(64, np.int64)
    m = n - shingle + 1
    for at in range(0, m, 1 << 16):  # bounded memory for texts of any length
        h = np.fromiter([hash64(norm[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])], ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > m).tobytes(), "big")


def with_fingerprints(df: DataFrame, output: str, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Add ``output``, the fingerprint as a signed BIGINT."""

    def run(batches):
        for batch in in_parts(batches):
            texts = batch.column(text_col).cast(pa.binary())
            got = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got.view(np.int64))], [*batch.schema.names, output])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(output, T.LongType())]))


def bands(count: int) -> list[tuple[int, int]]:
    """(shift, width) of ``count`` bands of 64 bits."""
    cuts = [64 * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def fps_by_band(fps: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """``fps(fp)`` -> rows for ``bktree.shards``: fingerprints within ``radius`` are equal in
    one of ``radius + 1`` bands, so a fingerprint stands in one tree for each band: that of
    all fingerprints whose band hashes to the same bucket."""
    buckets = max(1, -(-fps.count() // shard_rows))
    keys = []
    for k, (shift, width) in enumerate(bands(radius + 1)):
        bits = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        keys.append(F.lit(k * buckets) + F.pmod(F.xxhash64(bits, F.lit(k)), F.lit(buckets)))
    return fps.select("fp", F.explode(F.array(*keys)).alias("bucket")).select("bucket", F.col("bucket").alias("grp"), "fp")


def links(fps: DataFrame, radius: int = 2, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``fps(fp)`` of distinct fingerprints -> ``(a, b)``: spanning links, such that the
    components are those of all pairs within ``radius`` bits."""

    def found(tree, probes):
        parts = []
        for p, v, _ in tree.within(probes.values, probes.groups, radius):
            a, b = probes.marks[p, 0], tree.marks[v, 0]
            far = a != b
            if far.any():
                parts.append(np.stack(spanning(a[far], b[far])))
        if parts:
            yield spanning(*np.concatenate(parts, axis=1))

    return walk(shards(fps_by_band(fps, radius, shard_rows), ("fp",), shard_rows), found, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``fingerprint`` (16 hex digits),
    ``component_id`` (the least id that links reach, its own included)."""
    slim = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = written(with_fingerprints(slim, "fp", "text", shingle).drop("text"), "fingerprints")
    least = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    roots = components(links(least.select("fp"), radius, shard_rows))
    rooted = written(
        least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "roots"
    )
    named = written(rooted.groupBy(F.col("root").alias("r")).agg(F.min("least_id").alias("component_id")), "component-ids")
    named = written(rooted.join(named, F.col("root") == F.col("r")).select(F.col("fp").alias("cfp"), "component_id"), "named")
    return marked.join(named, F.col("fp") == F.col("cfp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def dedupe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The rows of ``df`` that stay, columns unchanged: of each component one (see
    ``keep.one_of_each``), also where texts share an id."""
    slim = df.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    marked = written(with_fingerprints(slim, "fp", "text", shingle).drop("text"), "fingerprints")
    roots = components(links(marked.select("fp").distinct(), radius, shard_rows))
    rows = marked.join(roots, F.col("fp") == F.col("node"), "left").select("doc_id", "key", F.coalesce("root", "fp").alias("root"))
    return one_of_each(df, id_col, text_col, rows)
