"""Near-duplicates by Jaccard similarity: SimHash fingerprints in BK-trees, then a check.

A link joins two texts whose sets of shingles (five lower-cased words) have a Jaccard
similarity of at least ``least``.  A text's SimHash is the majority of the bits of its
shingles' hashes; two texts at similarity 0.8 differ in about 10 of 64 bits (deviation
2.9).  Trees of such a wide radius prune little over a whole corpus, so the texts that
share a min-hash key (two minima, ``MINS`` keys: a pair at 0.8 shares none with a chance
of 8e-8) form one BK-tree, and the walks of radius ``RADIUS`` (a pair at 0.8 lies beyond
it with a chance of 1.1e-4) name the candidates.

Candidates must also share enough tokens, by 16 bits of each hash, which can only add to
what is shared: of sets of at most ``WHOLE`` tokens all are compared; of larger ones a
prefix.  With all sets in one order of tokens, two sets of that similarity share ``k`` of the
first ``n - ceil(least * n) + k`` of each.  This loses no link in any order; tokens that are
frequent in a sample go last, so that the prefixes of edited copies hold the edits.

First each text is checked against its nearest in each tree, then against what is left:
the candidates of other components, so that large groups are not paired off.  Every
link is checked on the texts themselves.

Defined results: null and empty texts have no shingles and are copies of each other; a
text of fewer words than a shingle is one shingle; null ids take part with their text;
repeated rows stay one; texts that share an id are told apart; empty tables give empty
tables.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import in_parts, small, written
from .bktree import SHARD_ROWS, shards, walk
from .components import components
from .keep import one_of_each, text_key
from .simhash import SEED

MINS, PER_KEY = 16, 2
RADIUS = 21
WHOLE = 1024
SAMPLE_TEXTS, SAMPLE_LEAST, SAMPLE_TOKENS = 8192, 3, 500_000
_ODD = np.random.default_rng(SEED).integers(1, 1 << 63, MINS * PER_KEY, np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes | None, size: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of lower-cased words."""
    import xxhash

    found = (text or b"").lower().split()  # A-Z only, and the ASCII separators
    n = len(found)
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)] if n else [], np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, n)
    h = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        h = _mixed(h + w[j : n - size + 1 + j])
    return np.unique(h)


def simhash(hashes: np.ndarray) -> int:
    """Majority bits; of no hashes zero."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def min_keys(hashes: np.ndarray) -> np.ndarray:
    """``MINS`` keys, each of ``PER_KEY`` minima under different mixings."""
    low = np.array([_mixed(hashes * odd).min() for odd in _ODD]).reshape(MINS, PER_KEY)
    key = np.arange(MINS, dtype=np.uint64)
    for column in low.T:
        key = _mixed(key + column)
    return key


def _bytes(column):
    return (t.as_py() for t in column.cast(pa.binary()))


def _common_tokens(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a bounded sample hold, with their counts.  They order
    the prefixes, and no order changes the result."""
    share = max(1, texts.count() // SAMPLE_TEXTS)

    def run(batches):
        for batch in in_parts(batches):
            for t in _bytes(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, size).view(np.int64))], ["token"])

    drawn = texts.where(F.pmod(F.xxhash64("key", "doc_id"), F.lit(share)) == 0).select("text")
    counted = drawn.mapInArrow(run, "token bigint").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= SAMPLE_LEAST)
    got = counted.orderBy(F.desc("n"), "token").limit(SAMPLE_TOKENS).toArrow()
    token, n = (got.column(c).to_numpy() for c in ("token", "n"))
    order = np.argsort(token.view(np.uint64))
    return token.view(np.uint64)[order], n[order]


def shared_least(n: np.ndarray, least: float) -> np.ndarray:
    """Tokens of its load that a set of ``n`` must share with a similar one."""
    return np.where(n <= WHOLE, np.ceil(least * n - 1e-9), 3 * n // 10).astype(np.int64)


def prefix(hashes: np.ndarray, tokens: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The size (two cells) and 16 bits of each of the first tokens in the order of
    ``counts``."""
    n = len(hashes)
    size = np.array([n], np.uint32).view(np.uint16)
    if n <= WHOLE:
        return np.append(size, hashes.astype(np.uint16))
    at = np.searchsorted(tokens, hashes)
    known = at < len(tokens)
    known[known] = tokens[at[known]] == hashes[known]
    count = np.zeros(n, np.int64)
    count[known] = counts[at[known]]
    first = np.argsort(count, kind="stable")[: n - math.ceil(least * n - 1e-9) + int(shared_least(n, least))]
    return np.append(size, hashes[first].astype(np.uint16))


def _marked(texts: DataFrame, size: int, least: float) -> DataFrame:
    """``doc_id, key, set, fp, mins, load``: equal shingle sets have equal ``set``; the load
    is the prefix."""
    import xxhash

    common = texts.sparkSession.sparkContext.broadcast(_common_tokens(texts, size))

    def run(batches):
        for batch in in_parts(batches):
            sets, fps, mins, loads = [], [], [], []
            for text in _bytes(batch.column("text")):
                s = shingles(text, size)
                sets.append(xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0)
                fps.append(simhash(s))
                mins.append(min_keys(s).view(np.int64) if len(s) else [])
                loads.append(prefix(s, *common.value, least).tobytes() if len(s) else b"")
            more = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (sets, fps)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *more, pa.array(mins, pa.list_(pa.int64())), pa.array(loads, pa.binary())], ["doc_id", "key", "set", "fp", "mins", "load"])

    long = T.LongType()
    schema = T.StructType([texts.schema["doc_id"], texts.schema["key"], T.StructField("set", long), T.StructField("fp", long), T.StructField("mins", T.ArrayType(long)), T.StructField("load", T.BinaryType())])
    return written(texts.mapInArrow(run, schema), "shingled")


def _checked(pairs: DataFrame, texts: DataFrame, keys: DataFrame, size: int, least: float, what: str) -> DataFrame:
    """The ``pairs(a, b)`` of sets whose texts are similar enough."""
    asked = written(pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct().join(keys, "set"), f"{what}-asked")
    met = texts.select("key", "text").join(small(asked), "key").groupBy("set").agg(F.first("text").alias("text"))
    met = written(met, f"{what}-texts")
    both = pairs.join(met.select(F.col("set").alias("a"), F.col("text").alias("ta")), "a").join(met.select(F.col("set").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in in_parts(batches):
            a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
            keep = np.zeros(len(a), bool)
            for i, (ta, tb) in enumerate(zip(_bytes(batch.column("ta")), _bytes(batch.column("tb")))):
                sides = []
                for k, t in ((a[i], ta), (b[i], tb)):
                    if k not in held:
                        if len(held) >= 100:
                            held.clear()
                        held[k] = shingles(t, size)
                    sides.append(held[k])
                same = len(np.intersect1d(*sides, assume_unique=True))
                keep[i] = same >= least * (len(sides[0]) + len(sides[1]) - same) - 1e-9
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return written(both.mapInArrow(run, "a long, b long"), f"{what}-links")


def _company(sets: DataFrame, shard_rows: int) -> DataFrame:
    """``sets(set, fp, mins, root)`` -> rows for ``bktree.shards``, of those keys under which
    several components meet."""
    keyed = written(sets.select(F.explode(F.array_distinct("mins")).alias("grp"), "set", "fp", "root"), "keyed")
    loads = sets.select(F.col("set").alias("s"), "load")
    met = keyed.groupBy(F.col("grp").alias("g")).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("g")
    kept = written(keyed.join(met, F.col("grp") == F.col("g"), "left_semi"), "keyed-company")
    buckets = max(1, -(-kept.count() // shard_rows))
    asked = written(loads.join(kept.select(F.col("set").alias("k")).distinct(), F.col("s") == F.col("k"), "left_semi"), "loads")
    return kept.join(asked, F.col("set") == F.col("s")).select(F.pmod(F.xxhash64("grp"), F.lit(buckets)).alias("bucket"), "grp", "set", "fp", "root", "load")


def _tokens(loads: tuple[np.ndarray, np.ndarray]):
    """(sizes, tokens, offsets of each load's tokens)."""
    flat, at = loads[0].view(np.uint16), loads[1] // 2
    head = np.zeros(len(flat), bool)
    head[at[:-1]] = head[at[:-1] + 1] = True
    return np.ascontiguousarray(flat[head]).view(np.uint32).astype(np.int64), flat[~head], at - 2 * np.arange(len(at))


class Loads:
    """The loads of a shard's sets, found by their tokens."""

    def __init__(self, loads: tuple[np.ndarray, np.ndarray], least: float):
        self.size, self.token, self.at = _tokens(loads)
        self.least, self.enough = least, shared_least(self.size, least)
        order = np.argsort(self.token, kind="stable")
        self.sorted, self.owner = self.token[order], np.repeat(np.arange(len(self.size)), np.diff(self.at))[order]

    def sharing(self, p: np.ndarray, v: np.ndarray, probes: Loads) -> np.ndarray:
        """Which of the pairs (indices of ``probes``, of these sets) share enough tokens."""
        x, y = probes.size[p], self.size[v]
        enough = np.where((x <= WHOLE) & (y <= WHOLE), self.least / (1 + self.least) * (x + y) - 1e-9, np.minimum(probes.enough[p], self.enough[v]))
        keep = np.zeros(len(p), bool)
        order = np.argsort(p, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(p[order])) + 1):
            one = p[mine[0]]
            asked = probes.token[probes.at[one] : probes.at[one + 1]]
            first = np.searchsorted(self.sorted, asked, "left")
            n = np.searchsorted(self.sorted, asked, "right") - first
            place = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            keep[mine] = np.bincount(self.owner[place], minlength=len(self.size))[v[mine]] >= enough[mine]
        return keep


def _candidates(tree, probes, radius: int, least: float):
    """(sets, sets, distances) of the pairs of different components, some at a time."""
    own = asked = None
    for p, v, d in tree.within(probes.values, probes.groups, radius):
        far = probes.marks[p, 1] != tree.marks[v, 1]
        p, v, d = p[far], v[far], d[far]
        if len(p):
            own = own or Loads(tree.loads, least)
            asked = asked or Loads(probes.loads, least)
            keep = own.sharing(p, v, asked)
            if keep.any():
                yield probes.marks[p[keep], 0], tree.marks[v[keep], 0], d[keep]


def _nearest(made: DataFrame, radius: int, least: float) -> DataFrame:
    """The pairs (a, b) of a set and its nearest of another component (second mark) in
    each tree."""

    def found(tree, probes):
        for a, b, d in _candidates(tree, probes, radius, least):
            order = np.lexsort((b, d, a))
            a, b = a[order], b[order]
            first = np.concatenate(([True], a[1:] != a[:-1]))
            yield a[first], b[first]

    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return written(walk(made, found, "a long, b long").select(low, high).distinct(), "nearest-pairs")


def _across(made: DataFrame, radius: int, least: float) -> DataFrame:
    """The pairs (a, b), a < b, within the radius whose components differ."""

    def found(tree, probes):
        for a, b, _ in _candidates(tree, probes, radius, least):
            yield tuple(np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1))

    return written(walk(made, found, "a long, b long").distinct(), "pairs-across")


def dedupe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The rows of ``df`` that stay, columns unchanged: of each component one (see
    ``keep.one_of_each``)."""
    text = F.coalesce(df[text_col], F.lit(""))
    texts = df.select(df[id_col].alias("doc_id"), text_key(df[text_col]).alias("key"), text.alias("text"))
    marked = _marked(texts, size, least)
    sets = written(marked.groupBy("set").agg(F.min("key").alias("key"), F.first("fp").alias("fp"), F.first("mins").alias("mins"), F.first("load").alias("load")), "sets")
    keys = sets.select("set", "key")
    slim = sets.select("set", "fp", "mins", "load")
    rooted = slim.withColumn("root", F.col("set"))
    links = None
    for what, ask in (("nearest", _nearest), ("across", _across)):
        made = shards(_company(rooted, shard_rows), ("set", "root"), shard_rows)
        new = _checked(ask(made, radius, least), texts, keys, size, least, what)
        links = new if links is None else links.unionByName(new)
        roots = written(components(links), "components")
        rooted = slim.join(roots, F.col("set") == F.col("node"), "left").select("set", "fp", "mins", "load", F.coalesce("root", "set").alias("root"))
    rows = marked.select("doc_id", "key", "set").join(roots, F.col("set") == F.col("node"), "left").select("doc_id", "key", F.coalesce("root", "set").alias("root"))
    return one_of_each(df, id_col, text_col, rows)
