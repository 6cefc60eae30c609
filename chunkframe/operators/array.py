"""Arrays: lazy handles whose reads are DataFrames and whose writes are jobs by chunk."""

from __future__ import annotations

import json
import warnings
from dataclasses import replace
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..codecs import build
from ..errors import Indexing, ShapeFlattened, ShapeMismatch, StoreError
from ..functions.cells import chunk_columns, linear_index
from ..grid import intersections, region, visible
from ..metadata import ArrayMetadata, key_of
from ..plans.pruning import Bounds, plan
from ..sources.cells import install, packed
from ..stores import LocalStore, Store
from .chunks import patch_block, patch_cells, read_part, read_whole, store_chunk, trim_chunk

#: Index lists up to this length are broadcast; longer ones join by a shuffle.
BROADCAST_INDEX = 100_000


class Array:
    def __init__(self, store: Store, path: str, meta: ArrayMetadata, write_empty_chunks: bool = False):
        self.store, self.path, self.meta, self.write_empty_chunks = store, path, meta, write_empty_chunks

    # -- properties ----------------------------------------------------------
    @property
    def shape(self) -> tuple[int, ...]:
        return self.meta.shape

    @property
    def ndim(self) -> int:
        return len(self.meta.shape)

    @property
    def size(self) -> int:
        return prod(self.meta.shape)

    @property
    def chunk_shape(self) -> tuple[int, ...]:
        return self.meta.chunk_shape

    @property
    def dtype(self) -> str:
        d = self.meta.dtype
        return f"{d.name}[{d.config['unit']}]" if d.kind == "time" else d.name

    @property
    def fill_value(self):
        return self.meta.fill

    @property
    def attrs(self) -> dict:
        return dict(self.meta.attributes)

    @property
    def dimension_names(self):
        return self.meta.dimension_names

    def __len__(self):
        return self.shape[0] if self.shape else 0

    def __repr__(self):
        return f"<Array /{self.path} {self.shape} {self.dtype} chunks {self.chunk_shape}>"

    def describe_df(self, spark: SparkSession) -> DataFrame:
        row = (self.path, list(self.shape), self.ndim, self.size, self.dtype, list(self.chunk_shape), json.dumps(self.meta.dtype.encode_fill(self.meta.fill)),
               json.dumps([c.json for c in self.meta.codecs]), self.dimension_names, json.dumps(self.attrs))
        return spark.createDataFrame([row], "path string, shape array<bigint>, ndim int, size bigint, dtype string, chunk_shape array<bigint>, fill_value string, codecs string, dimension_names array<string>, attributes string")

    # -- metadata ------------------------------------------------------------
    def _save(self) -> None:
        self.store.set(key_of(self.path), self.meta.to_json().encode())

    def set_attr(self, name: str, value) -> None:
        self.set_attrs(self.attrs | {name: value})

    def set_attrs(self, attributes: dict) -> None:
        self.meta.attributes = dict(attributes)
        self._save()

    # -- reads ---------------------------------------------------------------
    def _source(self, spark: SparkSession, **options):
        install(spark)
        reader = spark.read.format("chunkframe").option("node", self.path)
        for k, v in options.items():
            if v is not None:
                reader = reader.option(k, str(v))
        if isinstance(self.store, LocalStore):
            return reader.load(self.store.root)
        return reader.option("store", packed(self.store)).load()

    def cells(self, spark: SparkSession, start=None, count=None, *, emit_fill: bool = True, null_fill: bool = False, named: bool = False, fields=None, partitions: int | None = None) -> DataFrame:
        """Cells of a region: ``i0.., value``.  The region is validated here and now; further
        ``where`` clauses on coordinates prune chunks."""
        start, count = region(self.shape, start, count)
        return self._source(spark, start=json.dumps(start), count=json.dumps(count), emit_fill=emit_fill, null_fill=null_fill, coords="names" if named else None,
                            fields=",".join(fields) if fields else None, partitions=partitions)

    def blocks(self, spark: SparkSession, start=None, count=None, *, emit_fill: bool = True, partitions: int | None = None) -> DataFrame:
        """One row per chunk of a region: ``chunk, start, extent, data`` (C order)."""
        start, count = region(self.shape, start, count)
        return self._source(spark, mode="blocks", start=json.dumps(start), count=json.dumps(count), emit_fill=emit_fill, partitions=partitions)

    def _subscripts(self, index) -> list[list[int] | slice]:
        index = index if isinstance(index, tuple) else (index,)
        if len(index) != self.ndim:
            raise Indexing(f"{len(index)} subscripts for rank {self.ndim}")
        picked = [_positions(i, n) for i, n in zip(index, self.shape)]
        if any(not isinstance(p, range) and not p for p in picked):
            raise Indexing("empty subscripts are not supported")
        return picked

    def select(self, spark: SparkSession, index) -> DataFrame:
        """Outer indexing by slices, integers, lists or masks, one per dimension:
        ``o0.., i0.., value``; the order and repeats of lists show in ``o``."""
        picked = self._subscripts(index)
        start = [p.start if isinstance(p, range) else min(p, default=0) for p in picked]
        count = [len(p) if isinstance(p, range) else (max(p) + 1 - min(p) if p else 0) for p in picked]
        df = self.cells(spark, start, count)
        for d, p in enumerate(picked):
            if not isinstance(p, range) and len(p) <= BROADCAST_INDEX:  # beyond, the box and the join
                df = df.where(F.col(f"i{d}").isin(sorted(set(p))))
        for d, p in enumerate(picked):
            if isinstance(p, range):
                df = df.withColumn(f"o{d}", F.col(f"i{d}") - F.lit(p.start))
            else:
                where = spark.createDataFrame(list(enumerate(p)), f"o{d} bigint, x{d} bigint")
                where = F.broadcast(where) if len(p) <= BROADCAST_INDEX else where
                df = df.join(where, F.col(f"i{d}") == F.col(f"x{d}")).drop(f"x{d}")
        return df.select(*(f"o{d}" for d in range(self.ndim)), *self.meta.coordinate_names, "value")

    def flat(self, spark: SparkSession, order: str = "F") -> DataFrame:
        """``lin, value``: all cells by their position in the flattened array."""
        return self.cells(spark).select(linear_index(self.meta.coordinate_names, self.shape, order).alias("lin"), "value")

    def read(self, start=None, count=None) -> np.ndarray:
        """A region as a numpy array, on the driver (for regions that fit there)."""
        start, count = region(self.shape, start, count)
        out = self.meta.dtype.filled(count, self.meta.fill)
        for part in intersections(start, count, self.chunk_shape):
            block = read_part(self.store, self.path, self.meta, part)
            if block is not None:
                out[part.in_out] = block
        return out

    def __getitem__(self, index) -> np.ndarray:
        """Numpy-like outer indexing on the driver; only chunks that are hit are read."""
        if index == () and not self.ndim:
            return self.read()[()]
        if isinstance(index, slice) and index == slice(None) and self.ndim != 1:
            return self.read().reshape(-1, order="F")
        picked = self._subscripts(index)
        bounds = Bounds.of([min(p, default=0) for p in picked], [max(p) + 1 - min(p) if len(p) else 0 for p in picked])
        for d, p in enumerate(picked):
            if not isinstance(p, range):
                bounds.narrow(d, "in", p)
        box = self.meta.dtype.filled(tuple(b - a for a, b in zip(bounds.low, bounds.high)), self.meta.fill)
        for chunks in plan(bounds, self.chunk_shape, self.meta.cell_bytes, 1):
            for coords in chunks:
                part = bounds.part(coords, self.chunk_shape)
                block = read_part(self.store, self.path, self.meta, part, bounds.hit)
                if block is not None:
                    box[tuple(slice(o - a, o - a + n) for o, a, n in zip(part.out, bounds.low, part.n))] = block
        return box[np.ix_(*([i - a for i in p] for p, a in zip(picked, bounds.low)))] if self.ndim else box

    def __iter__(self):
        raise Indexing("arrays aren't iterated; read a region")

    def __delitem__(self, index):
        raise Indexing("cells can't be deleted; resize the array")

    # -- writes from the driver ----------------------------------------------
    def write(self, values, start=None) -> None:
        """Assign a block of values at ``start`` (default: the origin), chunk by chunk."""
        block = self._block(values)
        start, count = region(self.shape, start, block.shape)
        for part in intersections(start, count, self.chunk_shape):
            if self.ndim:
                patch_block(self.store, self.path, self.meta, part, block[part.in_out], self.write_empty_chunks)
            else:
                store_chunk(self.store, self.path, self.meta, (), block, True)

    def _block(self, values) -> np.ndarray:
        block = self.meta.dtype.coerce(values if isinstance(values, np.ndarray) else values)
        if self.ndim == 1 and block.ndim != 1:
            if sum(n > 1 for n in block.shape) > 1:
                warnings.warn("several long dimensions are flattened", ShapeFlattened, stacklevel=3)
            block = block.reshape(-1)
        if block.ndim != self.ndim:
            raise ShapeMismatch(f"values of shape {block.shape} for rank {self.ndim}")
        return block

    def __setitem__(self, index, values) -> None:
        """Outer assignment; of repeated subscripts the last counts.  Scalars spread."""
        if index == () and not self.ndim:
            return self.write(np.asarray(values) if not self.meta.dtype.variable else _scalar(values))
        picked = self._subscripts(index)
        shape = tuple(len(p) for p in picked)
        scalar = isinstance(values, (str, bytes, dict)) or np.ndim(values) == 0
        if scalar:
            block = self.meta.dtype.coerce([values] if self.meta.dtype.kind in ("struct", "bytes", "string", "utf32") else np.asarray(values).reshape(1))
            block = np.broadcast_to(block.reshape((1,) * self.ndim), shape)
        else:
            block = self.meta.dtype.coerce(values)
            if block.size != prod(shape):
                raise ShapeMismatch(f"{block.size} values for {shape}")
            block = block.reshape(shape)
        for coords_d in _products([sorted({i // c for i in p}) for p, c in zip(picked, self.chunk_shape)]):
            inside = [[(j, i) for j, i in enumerate(p) if i // c == k] for p, c, k in zip(picked, self.chunk_shape, coords_d)]
            seen = visible(coords_d, self.shape, self.chunk_shape)
            whole = all(len({i for _, i in x}) == n for x, n in zip(inside, seen))
            chunk = self.meta.dtype.filled(self.chunk_shape, self.meta.fill) if whole else read_whole(self.store, self.path, self.meta, coords_d)
            last = [dict((i - k * c, j) for j, i in x) for x, k, c in zip(inside, coords_d, self.chunk_shape)]
            chunk[np.ix_(*(list(x) for x in last))] = block[np.ix_(*(list(x.values()) for x in last))]
            store_chunk(self.store, self.path, self.meta, coords_d, chunk, self.write_empty_chunks)

    # -- distributed writes --------------------------------------------------
    def by_chunk(self, df: DataFrame) -> DataFrame:
        """``df`` dealt so that all cells of a chunk are in one task, one after the other (for
        the sink)."""
        if not self.ndim:
            return df.coalesce(1)
        numbers = chunk_columns(self.meta.coordinate_names, self.chunk_shape)
        return df.repartition(*numbers).sortWithinPartitions(*numbers)

    def write_df(self, df: DataFrame, order_by: str | None = None) -> int:
        """Assign the cells of ``df`` (``i0.., value``): one shuffle on the chunk numbers, then
        one task per chunk patches, encodes and stores it.  Repeated cells: the last in
        ``order_by``.  Null values become the fill value.  Returns the chunks written.

        A repeated or speculated task stores the same bytes again, as chunks are replaced
        whole."""
        self._distributed()
        if not self.ndim:
            rows = df.select("value").limit(2).toArrow()
            if rows.num_rows:
                patch_cells(self.store, self.path, self.meta, (), [], rows.column("value"))
            return int(rows.num_rows > 0)
        store, path, meta, keep = self.store, self.path, self.meta, self.write_empty_chunks
        names = meta.coordinate_names
        keys = [f"_k{d}" for d in range(self.ndim)]
        cells = df.select(*(F.col(n).cast("bigint").alias(n) for n in names), "value", *([F.col(order_by).alias("_order")] if order_by else []))
        cells = cells.where(" and ".join(f"{n} is not null" for n in names))
        dealt = cells.withColumns(dict(zip(keys, chunk_columns(names, self.chunk_shape))))

        def run(rows: pa.Table) -> pa.Table:
            if order_by:
                rows = rows.sort_by("_order")
            coords = tuple(rows.column(k)[0].as_py() for k in keys)
            n = patch_cells(store, path, meta, coords, [rows.column(c).to_numpy() for c in names], rows.column("value"), keep)
            return pa.table({"stored": pa.array([n], pa.int64())})

        return dealt.groupBy(*keys).applyInArrow(run, "stored long").agg(F.count("*")).first()[0]

    def _distributed(self) -> None:
        if not self.store.shared:
            raise StoreError("tasks can't write into this store; use write on the driver")

    def _chunk_table(self, spark: SparkSession, start, count, task_bytes: int = 64 << 20) -> DataFrame:
        """One row per chunk of a region: ``k0..``.  The numbers follow from a range by
        arithmetic (last dimension fastest), so there is neither a shuffle nor a list."""
        first = [s // c for s, c in zip(start, self.chunk_shape)]
        sizes = [(s + n - 1) // c - f + 1 if n else 0 for s, n, c, f in zip(start, count, self.chunk_shape, first)]
        total = prod(sizes)
        tasks = max(1, min(total, max(spark.sparkContext.defaultParallelism, -(-total * self.meta.cell_bytes // task_bytes))))
        columns, stride = [], total
        for d, (f, n) in enumerate(zip(first, sizes)):
            stride //= max(n, 1)
            columns.append((F.floor(F.col("id") / F.lit(max(stride, 1))) % F.lit(max(n, 1)) + F.lit(f)).cast("bigint").alias(f"k{d}"))
        return spark.range(0, total, 1, tasks).select(*columns)

    def fill(self, spark: SparkSession, value, start=None, count=None) -> int:
        """Assign one value to a region by a task per group of chunks; no cell is made."""
        self._distributed()
        start, count = region(self.shape, start, count)
        if not self.ndim or not prod(count):
            if not self.ndim:
                self[()] = value
            return int(not self.ndim)
        scalar = self.meta.dtype.coerce([value] if self.meta.dtype.kind in ("struct", "bytes", "string", "utf32") else np.asarray(value).reshape(1)).reshape(-1)[0]
        store, path, meta, keep = self.store, self.path, self.meta, self.write_empty_chunks
        bounds = Bounds.of(start, count)

        def run(batches):
            for batch in batches:
                n = 0
                for coords in zip(*(c.to_pylist() for c in batch.columns)):
                    part = bounds.part(coords, meta.chunk_shape)
                    patch_block(store, path, meta, part, meta.dtype.filled(part.n, scalar), keep)
                    n += 1
                yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

        return self._chunk_table(spark, start, count).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0

    def map_blocks(self, spark: SparkSession, make, start=None, count=None) -> int:
        """Assign a region by ``make(start, extent)``, which gives the values of a box; it runs
        in the tasks, once per chunk, so neither cells nor blocks cross the network.
        Returns the bytes stored."""
        self._distributed()
        start, count = region(self.shape, start, count)
        store, path, meta, keep, bounds = self.store, self.path, self.meta, self.write_empty_chunks, Bounds.of(start, count)

        def run(batches):
            for batch in batches:
                n = 0
                for coords in zip(*(c.to_pylist() for c in batch.columns)):
                    part = bounds.part(coords, meta.chunk_shape)
                    n += patch_block(store, path, meta, part, meta.dtype.coerce(make(part.out, part.n)), keep)
                yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

        return self._chunk_table(spark, start, count).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0 if prod(count) else 0

    def statistics(self, spark: SparkSession, start=None, count=None) -> DataFrame:
        """``chunk, n, total, least, greatest`` of each chunk's part of a region (numeric types),
        computed on decoded blocks in the tasks: no cell becomes a row."""
        if self.meta.dtype.kind not in ("bool", "int", "uint", "float"):
            raise Indexing(f"no statistics of {self.dtype}")
        start, count = region(self.shape, start, count)
        store, path, meta, bounds = self.store, self.path, self.meta, Bounds.of(start, count)

        def run(batches):
            for batch in batches:
                rows = []
                for coords in zip(*(c.to_pylist() for c in batch.columns)):
                    part = bounds.part(coords, meta.chunk_shape)
                    block = read_part(store, path, meta, part)
                    block = (meta.dtype.filled(part.n, meta.fill) if block is None else block).astype(np.float64, copy=False)
                    rows.append((list(map(int, coords)), block.size, float(block.sum()), float(block.min()), float(block.max())))
                chunk, *numbers = zip(*rows) if rows else ([],) * 5
                yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.list_(pa.int64())), pa.array(numbers[0], pa.int64()), *(pa.array(c, pa.float64()) for c in numbers[1:])], names=["chunk", "n", "total", "least", "greatest"])

        return self._chunk_table(spark, start, count).mapInArrow(run, "chunk array<bigint>, n bigint, total double, least double, greatest double")

    # -- shape ---------------------------------------------------------------
    def resize(self, shape, spark: SparkSession | None = None) -> None:
        """Change the shape: metadata first, then chunks outside go and cells of boundary
        chunks that fell outside are reset to the fill value.  With a session this is done in
        tasks over ranges of chunk numbers; no chunk is listed on the driver."""
        shape = tuple(int(n) for n in (shape if isinstance(shape, (list, tuple)) else [shape]))
        if len(shape) != self.ndim or any(n < 0 for n in shape):
            raise ShapeMismatch(f"shape {shape} for rank {self.ndim}")
        old = self.meta
        self.meta = replace(old, shape=shape)
        self._save()
        shrunk = [d for d in range(self.ndim) if shape[d] < old.shape[d]]
        if not shrunk:
            return
        store, path, meta, keep = self.store, self.path, self.meta, self.write_empty_chunks
        if spark is None or not store.shared:
            for _, coords in self._stored():
                if any((coords[d] + 1) * self.chunk_shape[d] > shape[d] for d in shrunk):
                    trim_chunk(store, path, meta, coords, keep)
            return

        def run(batches):
            for batch in batches:
                for coords in zip(*(c.to_pylist() for c in batch.columns)):
                    if store.exists(key_of(path, meta.chunk_key(coords))):
                        trim_chunk(store, path, meta, coords, keep)
                yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

        # one box of chunks per shrunk dimension: outside or on the edge of the new shape
        # there, inside of it in the shrunk dimensions before, so that no two boxes meet
        start, count = [0] * self.ndim, list(old.shape)
        for d in shrunk:
            edge = shape[d] // self.chunk_shape[d] * self.chunk_shape[d]
            start[d], count[d] = edge, old.shape[d] - edge
            if prod(count):
                self._chunk_table(spark, start, count).mapInArrow(run, "n long").agg(F.sum("n")).collect()
            start[d], count[d] = 0, edge

    def _stored(self) -> list[tuple[str, tuple[int, ...]]]:
        """(key below the array, chunk numbers) of the stored chunks."""
        prefix = f"{self.path}/" if self.path else ""
        keys = (k[len(prefix) :] for k in self.store.list(self.path))
        return [(k, c) for k in keys if (c := self.meta.chunk_coords(k)) is not None]

    def _grown(self, extent, dim: int) -> ArrayMetadata:
        if not self.ndim:
            raise ShapeMismatch("a rank-0 array can't grow")
        if not 0 <= dim < self.ndim:
            raise Indexing(f"dimension {dim} of rank {self.ndim}")
        if len(extent) != self.ndim or any(n != m for d, (n, m) in enumerate(zip(extent, self.shape)) if d != dim):
            raise ShapeMismatch(f"values of shape {tuple(extent)} after {self.shape} along dimension {dim}")
        return replace(self.meta, shape=tuple(n + extent[d] if d == dim else n for d, n in enumerate(self.shape)))

    def append(self, values, dim: int = 0) -> None:
        """Grow along ``dim`` by a block; the new shape is published after its chunks."""
        block = self._block(values)
        grown = Array(self.store, self.path, self._grown(block.shape, dim), self.write_empty_chunks)
        grown.write(block, [n if d == dim else 0 for d, n in enumerate(self.shape)])
        self.meta = grown.meta
        self._save()

    def append_df(self, df: DataFrame, length: int, dim: int = 0, attributes: dict | None = None) -> None:
        """Grow along ``dim`` by ``length`` and assign cells whose ``i{dim}`` starts at 0.  The
        new shape and ``attributes`` are published in one document, after the chunks."""
        extent = [length if d == dim else n for d, n in enumerate(self.shape)]
        grown = Array(self.store, self.path, self._grown(extent, dim), self.write_empty_chunks)
        grown.write_df(df.withColumn(f"i{dim}", F.col(f"i{dim}") + F.lit(self.shape[dim])))
        self.meta = grown.meta
        self.meta.attributes = self.attrs | (attributes or {})
        self._save()

    # -- relational helpers --------------------------------------------------
    def chunks_df(self, spark: SparkSession) -> DataFrame:
        """Stored chunks of the shape: ``key, chunk, bytes``; tasks ask for the sizes, by
        ranges of chunk numbers."""
        schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("chunk", T.ArrayType(T.LongType())), T.StructField("bytes", T.LongType())])
        store, path, meta = self.store, self.path, self.meta
        if not self.ndim or not store.shared:
            return spark.createDataFrame([(key, list(coords), store.size(key_of(path, key))) for key, coords in self._stored()], schema)

        def run(batches):
            for batch in batches:
                keys = [(meta.chunk_key(c), list(c)) for c in zip(*(c.to_pylist() for c in batch.columns))]
                sizes = [store.size(key_of(path, k)) for k, _ in keys]
                rows = [(k, c, n) for (k, c), n in zip(keys, sizes) if n is not None]
                key, chunk, n = zip(*rows) if rows else ([],) * 3
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(chunk, pa.list_(pa.int64())), pa.array(n, pa.int64())], names=["key", "chunk", "bytes"])

        # the first chunk of an empty dimension may be stored as well
        return self._chunk_table(spark, [0] * self.ndim, [max(n, 1) for n in self.shape]).mapInArrow(run, schema)

    def codec_names(self) -> list[str]:
        return [build(c).name for c in self.meta.codecs]


def _scalar(value) -> np.ndarray:
    out = np.empty((), object)
    out[()] = value
    return out


def _products(axes):
    from itertools import product

    return product(*axes)


def _positions(index, n: int) -> range | list[int]:
    """Validated positions of one subscript in a dimension of ``n``."""
    if isinstance(index, slice):
        if index.step not in (None, 1):
            return list(range(*index.indices(n)))
        start, stop = (0 if index.start is None else index.start), (n if index.stop is None else index.stop)
        if not 0 <= start <= stop <= n:
            raise Indexing(f"{start}:{stop} in a dimension of {n}")
        return range(start, stop)
    a = np.asarray(index)
    if a.dtype == bool:
        if a.shape != (n,):
            raise Indexing(f"a mask of {a.shape} for a dimension of {n}")
        return np.flatnonzero(a).tolist()
    if a.dtype.kind == "f" and not np.all(a == np.trunc(a)):
        raise Indexing("subscripts must be integers")
    if a.dtype.kind not in "iuf" and a.size:
        raise Indexing(f"no subscript: {index!r}")
    out = [int(i) for i in a.reshape(-1)]
    if any(not 0 <= i < n for i in out):
        raise Indexing(f"subscript outside 0..{n - 1}")
    return out
