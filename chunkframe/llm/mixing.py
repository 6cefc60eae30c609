"""Temperature mixing of sources: bisected exponent, budgeted block permutations.

A source with the share p of all tokens gets a weight proportional to p**alpha.  Alpha
is bisected in [0, 1] to meet a target entropy (a part of the log of the number of
sources) or a limit of repetition; the sums that a bisection needs are aggregates over
the table of sources, 31 exponents (five halvings) a job, so no source list is
collected.  The weights are realised as whole epochs and one cut epoch per source: the
documents of a source are dealt to 256 blocks, every epoch visits the blocks in its own
permutation, and the last one ends where the token budget does.  The cut is found by
sums over blocks, then over 256 parts of the cut block, then over its documents.  A
reading is a document in an epoch; readings are ordered by epoch, then by the block's rank
in the epoch's permutation (over all sources alike, so they alternate), then by the
document's position in its block.

Defined results: a null source is a source; a null text has no tokens; documents of a
source without any token get one copy and weight 0; null ids hash like a value;
repeated rows share their hash and are cut together; empty tables give empty tables;
the realised tokens of a source fall short of its quota by less than one document (with
its repeats).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import scratch_name, small, written
from .quality_rules import word_array

PARTS = 256
#: Cut tables up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 20_000


def tokens_of(text: Column) -> Column:
    return F.size(word_array(F.coalesce(text, F.lit("")))).cast("long")


def _hash(id_col: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col.cast("string")), 1)


def _block_key(seed: int, epoch: str = "full") -> Column:
    return F.xxhash64(F.lit(seed), F.col(epoch).cast("bigint"), F.col("block").cast("bigint"))


def permutations(spark, epochs: int, seed: int) -> DataFrame:
    """``epoch, block, block_rank``: the order in which each epoch visits the blocks."""
    pairs = spark.range(epochs * PARTS).select(F.floor(F.col("id") / PARTS).cast("int").alias("epoch"), (F.col("id") % PARTS).alias("block"))
    key = pairs.withColumn("key", _block_key(seed, "epoch"))
    return written(key.withColumn("block_rank", F.row_number().over(W.partitionBy("epoch").orderBy("key", "block")) - 1).drop("key"), "permutations")


def _sums(shares: DataFrame, alphas: list[float]) -> list[tuple[float, float]]:
    """Per exponent: the sum of p**a, and the sum of p**a * ln p."""
    p = F.col("p")
    row = shares.agg(*(x for j, a in enumerate(alphas) for x in (F.sum(p**a).alias(f"z{j}"), F.sum(p**a * F.ln(p)).alias(f"s{j}")))).first()
    return [(row[f"z{j}"], row[f"s{j}"]) for j in range(len(alphas))]


def exponent(shares: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None, budget: float | None = 1.0, halvings: int = 30) -> tuple[float, float]:
    """``shares(p)`` -> (alpha, sum of p**alpha).  The largest alpha in [0, 1] whose
    entropy is at least ``target_entropy`` (0 to 1, of the most possible), or the least
    whose sources are repeated at most ``max_repetition`` times with a budget of
    ``budget`` times all tokens (None: with the least repeated source read once).  An end of [0, 1] where the target can't be met."""
    n, least, most = shares.agg(F.count("*"), F.min("p"), F.max("p")).first()

    def enough(a, z, s):
        if target_entropy is not None:
            return math.log(z) - a * s / z >= target_entropy * math.log(n) - 1e-12
        return (least / most if budget is None else least) ** (a - 1) * (1 if budget is None else budget / z) <= max_repetition

    lo, hi = 0.0, 1.0
    (z0, s0), (z1, s1) = _sums(shares, [0.0, 1.0])
    if target_entropy is not None and enough(1.0, z1, s1):
        return 1.0, z1
    if max_repetition is not None and enough(0.0, z0, s0):
        return 0.0, z0
    # entropy holds at 0 and fails at 1; repetition fails at 0 (and may hold at 1)
    for _ in range(0, halvings, 5):
        grid = [lo + (hi - lo) * j / 32 for j in range(1, 32)]
        holds = [enough(a, *zs) for a, zs in zip(grid, _sums(shares, grid))]
        j = sum(holds) if target_entropy is not None else holds.count(False)
        lo, hi = ([lo, *grid, hi])[j], ([lo, *grid, hi])[j + 1]
    alpha = lo if target_entropy is not None else hi
    return alpha, _sums(shares, [alpha])[0][0]


def plan(rows: DataFrame, target_entropy: float | None, max_repetition: float | None, budget_ratio: float | None, seed: int) -> DataFrame:
    """``rows(source, tokens, h, block, part)`` -> per source ``src, weight, full, cut_key,
    cut_block, cut_part, cut_h``.  ``budget_ratio``: tokens to realise, as a part of all;
    None: so many that the source with the least repetition is read once in full."""
    tokens = written(rows.groupBy("source").agg(F.sum("tokens").alias("t")), "source-tokens")
    total = tokens.agg(F.sum("t")).first()[0] or 0
    shares = tokens.where("t > 0").select("source", "t", (F.col("t") / F.lit(float(max(total, 1)))).alias("p"))
    if total == 0:
        alpha, z, budget = 1.0, 1.0, 0.0
    else:
        largest = shares.agg(F.max("p")).first()[0]
        alpha, z = exponent(shares, target_entropy, max_repetition, budget_ratio)
        budget = float(total) * (budget_ratio or z * largest ** (1 - alpha))
    weight = F.col("p") ** alpha / z
    wanted = shares.select("source", "t", weight.alias("weight"), F.round(weight * budget).cast("long").alias("quota"))
    per = written(wanted.select(F.col("source").alias("src"), "weight", F.floor(F.col("quota") / F.col("t")).alias("full"), (F.col("quota") % F.col("t")).alias("rest")), "quotas")
    same = F.col("source").eqNullSafe(F.col("src"))

    def crossing(sums: DataFrame, order: list, left: str) -> DataFrame:
        """Of each source the first row at which the running sum passes ``left``."""
        run = sums.withColumn("_run", F.sum("t").over(W.partitionBy("source").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
        over = run.where(F.col("_run") > F.col(left)).withColumn("_k", F.row_number().over(W.partitionBy("source").orderBy("_run", *order)))
        return over.where("_k = 1").withColumn("left", F.col(left) - F.col("_run") + F.col("t"))

    blocks = rows.groupBy("source", "block").agg(F.sum("tokens").alias("t")).join(per, same).withColumn("key", _block_key(seed))
    cut = written(crossing(blocks.where("t > 0"), ["key", "block"], "rest").select("src", "full", "weight", F.col("key").alias("cut_key"), F.col("block").alias("cut_block"), "left"), "cut-blocks")
    inside = rows.join(cut, same & (F.col("block") == F.col("cut_block"))).groupBy("source", "part", F.col("left").alias("rest")).agg(F.sum("tokens").alias("t"))
    part = written(crossing(inside.where("t > 0"), ["part"], "rest").select(F.col("source").alias("src2"), F.col("part").alias("cut_part"), F.col("left").alias("left2")), "cut-parts")
    cut2 = written(cut.join(part, F.col("src").eqNullSafe(F.col("src2"))).drop("src2"), "cuts")
    docs = rows.join(cut2, same & (F.col("block") == F.col("cut_block")) & (F.col("part") == F.col("cut_part")))
    taken = docs.withColumn("_run", F.sum("tokens").over(W.partitionBy("source").orderBy("h"))).where("_run <= left2")
    last = taken.groupBy(F.col("source").alias("src3")).agg(F.max("h").alias("cut_h"))
    return written(cut2.join(last, F.col("src").eqNullSafe(F.col("src3")), "left").select("src", "weight", "full", "cut_key", "cut_block", "cut_part", F.coalesce("cut_h", F.lit(-1)).alias("cut_h")), "mix-plan")


def _dealt(df: DataFrame, id_col: Column, source_col: Column, tokens: Column, seed: int) -> DataFrame:
    rows = df.select(id_col.alias("doc_id"), source_col.cast("string").alias("source"), tokens.alias("tokens"), _hash(id_col, seed).alias("h"))
    return rows.withColumns({"block": F.shiftright("h", 55), "part": F.shiftright("h", 47).bitwiseAND(F.lit(PARTS - 1))})


def _copies(seed: int) -> Column:
    key = _block_key(seed)
    inside = (F.col("part") < F.col("cut_part")) | ((F.col("part") == F.col("cut_part")) & (F.col("h") <= F.col("cut_h")))
    before = (key < F.col("cut_key")) | ((key == F.col("cut_key")) & (F.col("block") < F.col("cut_block")))
    return F.when(F.col("full").isNull(), F.lit(1)).otherwise(F.col("full") + (before | ((F.col("block") == F.col("cut_block")) & inside)).cast("int")).cast("int")


def _with_plan(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    small = cuts.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(cuts) if small else cuts, F.col("source").eqNullSafe(F.col("src")), "left")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float | None = None,
        max_repetition: float | None = None, budget_ratio: float | None = 1.0, seed: int = 17) -> DataFrame:
    """``doc_id, source, n_tokens, weight, copies``: how often every row is to be read."""
    if (target_entropy is None) == (max_repetition is None):
        raise ValueError("one of target_entropy and max_repetition is needed")
    rows = written(_dealt(df, F.col(id_col), F.col(source_col), tokens_of(F.col(text_col)), seed), "dealt")
    cuts = plan(rows, target_entropy, max_repetition, budget_ratio, seed)
    out = _with_plan(rows, cuts)
    return out.select("doc_id", "source", F.col("tokens").alias("n_tokens"), F.coalesce("weight", F.lit(0.0)).alias("weight"), _copies(seed).alias("copies"))


def readings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float | None = None,
             max_repetition: float | None = None, budget_ratio: float | None = 1.0, seed: int = 17) -> DataFrame:
    """``doc_id, source, n_tokens, weight, copies, epoch, block_rank, position``: one row for
    each time that a row is read, and one without an epoch if it never is."""
    rows = written(_dealt(df, F.col(id_col), F.col(source_col), tokens_of(F.col(text_col)), seed), "dealt")
    out = _with_plan(rows, plan(rows, target_entropy, max_repetition, budget_ratio, seed)).withColumn("copies", _copies(seed))
    place = F.row_number().over(W.partitionBy("source", "block").orderBy("h", "doc_id", "tokens")) - 1
    out = written(out.select("doc_id", "source", F.col("tokens").alias("n_tokens"), F.coalesce("weight", F.lit(0.0)).alias("weight"), "copies", "block", place.cast("long").alias("position")), "placed")
    most = out.agg(F.max("copies")).first()[0] or 0
    each = out.withColumn("e", F.explode_outer(F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1))))
    order = small(permutations(df.sparkSession, most, seed).withColumnRenamed("block", "b"))
    met = each.join(order, (F.col("e") == F.col("epoch")) & (F.col("block") == F.col("b")), "left")
    return met.select("doc_id", "source", "n_tokens", "weight", "copies", "epoch", "block_rank", "position")


def realise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float | None = None,
            max_repetition: float | None = None, budget_ratio: float | None = None, seed: int = 17) -> DataFrame:
    """The rows of ``df``, columns unchanged, each as often as the mix reads it; every
    partition is in the order of reading."""
    rows = written(_dealt(df, F.col(id_col), F.col(source_col), tokens_of(F.col(text_col)), seed), "dealt")
    cuts = plan(rows, target_entropy, max_repetition, budget_ratio, seed)
    most = _with_plan(rows, cuts).agg(F.max(_copies(seed))).first()[0] or 0
    order = small(permutations(df.sparkSession, most, seed).withColumnRenamed("block", "b"))
    whole = scratch_name(df, "row")
    kept = df.select(F.struct(*df.columns).alias(whole))
    dealt = kept.select(whole, F.col(whole)[source_col].cast("string").alias("source"), _hash(F.col(whole)[id_col], seed).alias("h"))
    dealt = dealt.withColumns({"block": F.shiftright("h", 55), "part": F.shiftright("h", 47).bitwiseAND(F.lit(PARTS - 1))})
    times = _with_plan(dealt, cuts).select(whole, "block", "h", _copies(seed).alias("copies")).where("copies > 0")
    each = times.withColumn("e", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    met = each.join(order, (F.col("e") == F.col("epoch")) & (F.col("block") == F.col("b")))
    return met.sortWithinPartitions("epoch", "block_rank", "h").select(f"{whole}.*")
