"""Exact top-k inner products by block-at-a-time pruning.

Vectors are quantised to integers and seen as documents whose dimensions are terms.
Candidates are cut into blocks over ranges of their ids; a block keeps its forward
index (its rows) and per term the largest and least weight.  For a query the sum over
terms of the best possible product bounds every score of a block.  Blocks are visited
in the order of that bound and a query stops when the next bound is below its k-th
score so far; equal bounds are still visited, because ties go to smaller ids.

Blocks are grouped into segments (id ranges of bounded size), queries into packs of
bounded size; a group scores one pack against one segment and keeps k rows per query,
and the k best over all segments follow from a window with a partial group limit.

Defined results: vectors that are null, or hold null, NaN or infinite components, or
have another length than the queries', take no part; a query never meets its own row,
so repeated rows with one id never meet each other; equal query rows (id and vector) are
one query, rows of one id with different vectors are a query each; fewer than k
candidates: all of them; null ids take no part; empty tables give no rows.  Sums beyond
53 bits are made of whole numbers of any size; a score beyond 64 bits is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import written

_EXACT = 2.0**53
_NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max


def _dot(a: np.ndarray, b: np.ndarray, bound: bool = False) -> np.ndarray:
    """Exact integer products of rows: by float64 while sums stay below 2**53, then by
    Python's integers.  What 64 bits can't hold is cut to them in a ``bound``."""
    top = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if top < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    found = a.astype(object) @ b.astype(object).T
    if bound:
        found = np.clip(found, _NONE + 1, _LAST)
    elif found.size and (found.max() > _LAST or found.min() <= _NONE):
        raise OverflowError("a score is beyond 64 bits")
    return found.astype(np.int64)


def search_pack(q_ids, q, c_ids, c, k: int, block: int):
    """(query index, id, score) of the k best of one segment for every query of a pack."""
    best_s = np.full((len(q), k), _NONE)
    best_i = np.full((len(q), k), _LAST)
    cuts = range(0, len(c), block)
    high = np.stack([c[s : s + block].max(0) for s in cuts])
    low = np.stack([c[s : s + block].min(0) for s in cuts])
    bound = _dot(np.hstack((np.maximum(q, 0), np.minimum(q, 0))), np.hstack((high, low)), bound=True)
    order = np.argsort(-bound, axis=1, kind="stable")
    live = np.arange(len(q))
    for rank in range(len(high)):
        b = order[live, rank]
        going = bound[live, b] >= best_s[live, k - 1]
        live, b = live[going], b[going]
        if not len(live):
            break
        by = np.argsort(b, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(b[by])) + 1):
            at, s = live[part], int(b[part[0]]) * block
            ids, score = c_ids[s : s + block], _dot(q[at], c[s : s + block])
            score[q_ids[at][:, None] == ids[None, :]] = _NONE
            all_s = np.concatenate((best_s[at], score), 1)
            all_i = np.concatenate((best_i[at], np.broadcast_to(ids, score.shape)), 1)
            all_i[all_s == _NONE] = _LAST
            top = np.lexsort((all_i, ~all_s), axis=1)[:, :k]
            best_s[at] = np.take_along_axis(all_s, top, 1)
            best_i[at] = np.take_along_axis(all_i, top, 1)
    row, col = np.nonzero(best_s > _NONE)
    return row, best_i[row, col], best_s[row, col]


def _matrices(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length of vector -> (ids, matrix, queries), in the order of the ids."""
    ids = rows.column("vec_id").to_numpy()
    asked = rows.column("query").to_numpy() if "query" in rows.column_names else ids
    q = rows.column("q").combine_chunks()
    flat, ends = q.flatten().to_numpy(zero_copy_only=False), q.offsets.to_numpy()
    starts, lengths = ends[:-1] - ends[0], np.diff(ends)
    out = {}
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        at = at[np.argsort(ids[at], kind="stable")]
        out[int(d)] = ids[at], flat[starts[at][:, None] + np.arange(d)], asked[at]
    return out


def _segment(vec_id, cuts: list[float]):
    """How many of the sorted ``cuts`` are below the id: first among every 32nd, then in
    the stretch of 32 behind it."""
    if not cuts:
        return F.lit(0)
    below = lambda part: F.size(F.filter(part, lambda c: c < vec_id))
    coarse = below(F.array(*(F.lit(int(c)) for c in cuts[31::32])).cast("array<bigint>"))
    stretches = F.array(*(F.array(*(F.lit(int(c)) for c in cuts[j : j + 32])) for j in range(0, len(cuts), 32)), F.array().cast("array<bigint>"))
    return coarse * 32 + below(F.get(stretches, coarse))


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding",
          block_rows: int = 128, segment_rows: int = 65536, pack_rows: int = 16384) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row where the column ``is_query``
    holds, the ``k`` rows with another id of highest score, ties to smaller ids."""
    x = F.col("v")
    sound = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("is_query"))
    base = base.where(sound).select("vec_id", "is_query", F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("q"))
    rows = written(base, "quantised")
    n, n_queries = rows.agg(F.count("*"), F.count_if("is_query")).first()
    # small tables get smaller segments, so that there is work for 64 tasks
    segments = max(1, -(-n // segment_rows), min(64, -(-n // 1024)))
    packs = max(1, -(-n_queries // pack_rows))
    cuts = rows.approxQuantile("vec_id", [j / segments for j in range(1, segments)], 0.1 / segments) if segments > 1 else []
    segment = _segment(F.col("vec_id"), cuts)
    # the stated query set against all rows, in blocks: every pack meets every segment
    asked = written(rows.where("is_query").select("vec_id", "q").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    asked = asked.withColumn("pack", F.pmod(F.xxhash64("vec_id"), F.lit(packs)).cast("int"))
    asked = asked.withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(len(cuts))))).select("segment", "pack", "vec_id", "q", "query")
    held = rows.withColumn("segment", segment).withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1)))).select("segment", "pack", "vec_id", "q")

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found = [(np.empty(0, np.int64),) * 4]
        there = _matrices(candidates)
        for d, (ids, q, asked) in _matrices(queries).items():
            if d in there:
                row, near, score = search_pack(ids, q, *there[d][:2], k, block_rows)
                found.append((asked[row], ids[row], near, score))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], names=["query", "query_id", "vec_id", "score"])

    near = asked.groupBy("segment", "pack").cogroup(held.groupBy("segment", "pack")).applyInArrow(run, "query long, query_id long, vec_id long, score long")
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
