"""BK-trees over 64-bit fingerprints, in shards.

Children of a node are keyed by their integer Hamming distance to it, and a probe
follows only the edges whose key is within the radius of its own distance.  A shard
holds the trees of some groups (a tree for each group) as flat arrays.

``shards`` builds them in the tasks, one row for each shard, and ``walk`` brings every
shard together with the blocks of probes that may meet it: by a broadcast while all trees
together are known to be at most ``BROADCAST_BYTES``; beyond that a block, which is its
shard's own members, walks its tree where it lies.  A bucket of many fingerprints becomes
several shards of bounded size, whose blocks meet in pairs, by a shuffle join if need be.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written

#: Fingerprints of a shard, about; a bucket of more than twice as many is split.
SHARD_ROWS = 2048
BROADCAST_BYTES = 32 << 20
_PROBES_AT_ONCE = 512
WHOLE = -1  # the salt of a bucket that is one shard


class BKForest:
    """BK-trees, one per group, built and probed level by level.

    A group's first value is its root; a value goes to the child that is keyed by its
    distance to the node, until it is a new node.  Children of a node lie side by
    side, ordered by key, so "edges within the radius" is one range per visit."""

    FIELDS = ("values", "groups", "roots", "keys", "nodes")

    def __init__(self, values: np.ndarray, groups: np.ndarray):
        self.values, self.groups = values, groups
        place = np.asarray(groups, np.int64)  # (node, key) the value waits at, as one number
        waiting = np.arange(len(values))
        keys, nodes, self.roots = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.empty(0, np.int64)
        first = True
        while len(waiting):
            order = np.lexsort((waiting, place))
            waiting, place = waiting[order], place[order]
            head = np.concatenate(([True], place[1:] != place[:-1]))
            owner = waiting[head][np.cumsum(head) - 1]
            if first:
                self.roots, first = waiting[head], False
            else:
                keys.append(place[head])
                nodes.append(waiting[head])
            rest, parent = waiting[~head], owner[~head]
            place = parent * 65 + np.bitwise_count(values[rest] ^ values[parent]).astype(np.int64)
            waiting = rest
        keys, nodes = np.concatenate(keys), np.concatenate(nodes)
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], nodes[order]
        self.visited = 0

    def packed(self) -> list[bytes]:
        return [getattr(self, f).tobytes() for f in self.FIELDS]

    @classmethod
    def unpacked(cls, parts: list[bytes]) -> BKForest:
        tree = cls.__new__(cls)
        for f, part in zip(cls.FIELDS, parts):
            setattr(tree, f, np.frombuffer(part, np.uint64 if f == "values" else np.int64))
        tree.visited = 0
        return tree

    def starts(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices of the groups that have a tree, their roots)."""
        known = self.groups[self.roots]  # ascending
        at = np.minimum(np.searchsorted(known, groups), max(len(known) - 1, 0))
        there = np.flatnonzero(known[at] == groups) if len(known) else np.empty(0, np.int64)
        return there, self.roots[at[there]] if len(known) else there

    def within(self, probes: np.ndarray, groups: np.ndarray, radius: int):
        """Yield (indices of probes, of values, distances) of all pairs of one group within
        ``radius``, for some probes at a time."""
        asked, roots = self.starts(groups)
        for lo in range(0, len(asked), _PROBES_AT_ONCE):
            p, node = asked[lo : lo + _PROBES_AT_ONCE], roots[lo : lo + _PROBES_AT_ONCE]
            all_p, all_v, all_d = [], [], []
            while len(p):
                self.visited += len(p)
                d = np.bitwise_count(probes[p] ^ self.values[node]).astype(np.int64)
                hit = d <= radius
                all_p.append(p[hit])
                all_v.append(node[hit])
                all_d.append(d[hit])
                a = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0), "left")
                b = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right")
                n = b - a
                p = np.repeat(p, n)
                start = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n)
                node = self.nodes[start + np.arange(len(p))]
            yield np.concatenate(all_p), np.concatenate(all_v), np.concatenate(all_d)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (a, b) as stars around the least member of each of their components."""
    ids, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = root.copy()
        least = np.minimum(root[x], root[y])
        np.minimum.at(low, root[x], least)
        np.minimum.at(low, root[y], least)
        low = low[low[root]]
        while not np.array_equal(low, low[low]):
            low = low[low]
        if np.array_equal(low, root):
            break
        root = low
    far = root != np.arange(len(ids))
    return ids[far], ids[root[far]]


_SHARDS = "bucket long, salt long, mark binary, load binary, load_at binary, " + ", ".join(f"{f} binary" for f in BKForest.FIELDS)


def shards(keyed: DataFrame, marks: tuple[str, ...], shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``keyed(bucket, grp, fp, *marks)`` -> a table of shards.  Fingerprints of one ``grp``
    lie in one bucket and share a tree (in each shard of the bucket); ``marks`` are BIGINT
    columns that go with them, and a BINARY column ``load`` if there is one."""
    sizes = written(keyed.select("bucket").groupBy(F.col("bucket").alias("b")).agg(F.ceil(F.count("*") / (2 * shard_rows)).cast("int").alias("salts")).where("salts > 1"), "split-buckets")
    # split buckets hold more than 2 * shard_rows rows each, so there are few of them
    salted = keyed.join(sizes, F.col("bucket") == F.col("b"), "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("fp", F.lit(7)), 2 * F.col("salts")).cast("int"), F.lit(WHOLE)))

    def build(key, rows):
        grp, fp, *mark = (rows.column(c).to_numpy() for c in ("grp", "fp", *(f"m{k}" for k in range(len(marks)))))
        order = np.lexsort((*mark[::-1], fp, grp))  # the least of a group is its root
        tree = BKForest(fp[order].view(np.uint64), grp[order])
        load = [b""] * len(fp)
        if "load" in rows.column_names:
            load = rows.column("load").take(pa.array(order)).to_pylist()
        ends = np.cumsum([0, *map(len, load)])
        cells = [[key[0].as_py()], [key[1].as_py()], [np.stack(mark, 1)[order].tobytes()], [b"".join(load)], [ends.tobytes()], *([x] for x in tree.packed())]
        return pa.table(cells, names=["bucket", "salt", "mark", "load", "load_at", *BKForest.FIELDS])

    extra = ["load"] if "load" in keyed.columns else []
    return written(salted.select("bucket", "salt", "grp", "fp", *(F.col(c).alias(f"m{k}") for k, c in enumerate(marks)), *extra).groupBy("bucket", "salt").applyInArrow(build, _SHARDS), "shards")


def walk(made: DataFrame, found, schema: str) -> DataFrame:
    """``found(tree, probes)`` of every shard's tree with every block of probes of its
    bucket, as rows of ``schema`` (arrays in its order).  Both are forests with ``marks``
    (a matrix, a row for each fingerprint) and ``loads``: (bytes, their offsets)."""
    cells = ("mark", "load", "load_at", *BKForest.FIELDS)
    size = made.agg(F.sum(sum(F.length(f) for f in cells))).first()[0] or 0
    blocks = made.select("bucket", "salt", *(F.col(c).alias(f"p_{c}") for c in cells if c not in ("roots", "keys", "nodes"))).withColumnsRenamed({"bucket": "b", "salt": "s"})
    met = lambda trees, order: blocks.join(trees, (F.col("b") == F.col("bucket")) & order).drop("b", "s", "bucket", "salt")
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches):
        def side(row, prefix):
            one = BKForest.unpacked([row.get(prefix + f, b"") for f in BKForest.FIELDS])
            one.marks = np.frombuffer(row[prefix + "mark"], np.int64).reshape(len(one.values), -1)
            one.loads = np.frombuffer(row[prefix + "load"], np.uint8), np.frombuffer(row[prefix + "load_at"], np.int64)
            return one

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                tree = side(row, "")
                for cols in found(tree, side(row, "p_") if "p_mark" in row else tree):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    if size <= BROADCAST_BYTES:
        return met(F.broadcast(made), F.col("s") <= F.col("salt")).mapInArrow(run, schema)
    pairs = met(made.where(F.col("salt") != WHOLE), F.col("s") < F.col("salt"))
    return made.mapInArrow(run, schema).unionByName(pairs.mapInArrow(run, schema))
