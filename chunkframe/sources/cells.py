"""The Spark data source of array cells and blocks.

``spark.read.format("chunkframe").option("node", path).load(root)`` gives one row per
cell: coordinates ``i0..`` and ``value``.  Comparisons with coordinates become chunk
pruning; all filters are handed back to Spark too, so pruning can't change a result.

Options: ``node`` (path of the array), ``start`` and ``count`` (JSON lists, validated),
``mode`` (``cells``, or ``blocks``: one row per chunk with its decoded bytes), ``emit_fill``
(false: missing chunks give no rows), ``null_fill`` (true: cells that equal the fill value
are null), ``coords`` (``names``: dimension names as columns), ``fields`` (comma-separated
fields of records), ``partitions``, ``store`` (set by the API).
"""

from __future__ import annotations

import base64
import json

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from ..errors import Indexing, InvalidMetadata, StoreError
from ..functions.arrow import to_arrow
from ..grid import region
from ..metadata import ArrayMetadata, key_of, normal_path
from ..operators.chunks import patch_cells, read_part
from ..plans.pruning import Bounds, ChunkRange, plan
from ..stores import Store, resolve

_OPS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
_BATCH_CELLS = 1 << 17


def packed(store: Store) -> str:
    """A store as an option string."""
    return base64.b64encode(cloudpickle.dumps(store)).decode()


class _Range(InputPartition):
    def __init__(self, chunks: ChunkRange):
        self.chunks = chunks


class CellSource(DataSource):
    @classmethod
    def name(cls):
        return "chunkframe"

    def _node(self) -> tuple[Store, str, ArrayMetadata]:
        options = self.options
        packed_store = options.get("store")
        store = cloudpickle.loads(base64.b64decode(packed_store)) if packed_store else resolve(options.get("path"))
        path = normal_path(options.get("node", ""))
        text = store.get(key_of(path))
        if text is None:
            raise StoreError(f"no array at {path or '/'}")
        return store, path, ArrayMetadata.from_json(text)

    def _flag(self, name: str, default: bool) -> bool:
        return str(self.options.get(name, default)).lower() == "true"

    def _names(self, meta: ArrayMetadata) -> list[str]:
        if self.options.get("coords") != "names":
            return meta.coordinate_names
        names = meta.dimension_names or [None] * len(meta.shape)
        return [n or f"i{d}" for d, n in enumerate(names)]

    def schema(self):
        _, _, meta = self._node()
        if self.options.get("mode", "cells") == "blocks":
            return T.StructType([T.StructField(n, T.ArrayType(T.LongType(), False), False) for n in ("chunk", "start", "extent")] + [T.StructField("data", T.BinaryType(), False)])
        kind = meta.dtype.spark
        if wanted := self._fields():
            if meta.dtype.kind != "struct":
                raise InvalidMetadata("fields are for records")
            kind = T.StructType([kind[f] for f in wanted])
        return T.StructType([*(T.StructField(n, T.LongType(), False) for n in self._names(meta)), T.StructField("value", kind)])

    def _fields(self) -> list[str]:
        return [f.strip() for f in self.options.get("fields", "").split(",") if f.strip()]

    def reader(self, schema):
        store, path, meta = self._node()
        start, count = (json.loads(self.options[k]) if k in self.options else None for k in ("start", "count"))
        bounds = Bounds.of(*region(meta.shape, start, count))
        partitions = self.options.get("partitions")
        return CellReader(store, path, meta, bounds, self._names(meta), schema, self.options.get("mode", "cells"), self._flag("emit_fill", True), self._flag("null_fill", False), self._fields(), int(partitions) if partitions else None)

    def writer(self, schema, overwrite):
        if overwrite:
            raise InvalidMetadata("cells are written with mode append; create the array first")
        return CellWriter(*self._node(), self._names(self._node()[2]))


class CellReader(DataSourceReader):
    def __init__(self, store, path, meta, bounds, names, schema, mode, emit_fill, null_fill, fields, partitions):
        self.store, self.path, self.meta, self.bounds, self.names, self.schema = store, path, meta, bounds, names, schema
        self.mode, self.emit_fill, self.null_fill, self.fields, self.wanted_partitions = mode, emit_fill, null_fill, fields, partitions

    def pushFilters(self, filters):
        at = {(n,): d for d, n in enumerate(self.names)}
        for f in filters:
            op = _OPS.get(type(f))
            if self.mode == "cells" and op and tuple(f.attribute) in at:
                self.bounds.narrow(at[tuple(f.attribute)], op, f.value)
            yield f

    def partitions(self):
        found = plan(self.bounds, self.meta.chunk_shape, self.meta.cell_bytes, self.wanted_partitions)
        return [_Range(r) for r in found] or [_Range(ChunkRange([[]]))]

    def read(self, partition):
        for coords in partition.chunks:
            part = self.bounds.part(coords, self.meta.chunk_shape)
            block = read_part(self.store, self.path, self.meta, part, self.bounds.hit)
            if block is None:
                if not self.emit_fill:
                    continue
                block = self.meta.dtype.filled(part.n, self.meta.fill)
            yield from self._blocks(part, block) if self.mode == "blocks" else self._cells(part, block)

    def _blocks(self, part, block):
        raw = np.ascontiguousarray(block).tobytes() if not self.meta.dtype.variable else json.dumps([v if isinstance(v, str) else base64.b64encode(v).decode() for v in block.reshape(-1)]).encode()
        lists = [pa.array([list(map(int, x))], pa.list_(pa.int64())) for x in (part.coords, part.out, part.n)]
        yield pa.RecordBatch.from_arrays([*lists, pa.array([raw], pa.binary())], names=["chunk", "start", "extent", "data"])

    def _cells(self, part, block):
        index = [np.arange(a, a + n) for a, n in zip(part.out, part.n)]
        for d, values in enumerate(self.bounds.values):
            if values is not None:  # only the listed coordinates
                keep = np.array(self.bounds.wanted(d, part.out[d], part.out[d] + part.n[d]), np.int64)
                block, index[d] = np.take(block, keep - part.out[d], axis=d), keep
        shape, size, dtype = block.shape, block.size, self.meta.dtype
        flat = np.ascontiguousarray(block).reshape(-1)
        for at in range(0, size, _BATCH_CELLS):
            end = min(at + _BATCH_CELLS, size)
            where = np.unravel_index(np.arange(at, end), shape) if shape else ()
            columns = [pa.array(index[d][where[d]]) for d in range(len(shape))]
            values = to_arrow(flat[at:end], dtype)
            if self.fields:
                values = pa.StructArray.from_arrays([values.field(f) for f in self.fields], names=self.fields)
            if self.null_fill:
                values = values.take(pa.array(np.arange(end - at), mask=dtype.fills(flat[at:end], self.meta.fill)))
            yield pa.RecordBatch.from_arrays([*columns, values], names=[*self.names, "value"])


#: Bytes of rows that a task of the sink holds before it patches their chunks.
HELD_BYTES = 128 << 20


class _Written(WriterCommitMessage):
    def __init__(self, chunks):
        self.chunks = chunks


class CellWriter(DataSourceArrowWriter):
    """Patches chunks in place.  The rows of a chunk must be in one task (``Array.by_chunk``);
    two tasks on one chunk are an error at commit.  A task holds about ``HELD_BYTES`` of its
    rows at a time; a chunk whose rows are farther apart is patched again.  Chunks that a
    failed job has stored stay; writing the same rows again gives the whole result."""

    def __init__(self, store, path, meta, names):
        if not store.shared:
            raise StoreError("tasks can't write into this store")
        self.store, self.path, self.meta, self.names = store, path, meta, names

    def write(self, iterator):
        done, held, size = {}, [], 0
        for batch in iterator:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= HELD_BYTES:
                done.update(dict.fromkeys(self._patch(pa.Table.from_batches(held))))
                held, size = [], 0
        if held:
            done.update(dict.fromkeys(self._patch(pa.Table.from_batches(held))))
        return _Written(list(done))

    def _patch(self, rows):
        index = [rows.column(n).to_numpy() for n in self.names]
        if not index:
            patch_cells(self.store, self.path, self.meta, (), [], rows.column("value"))
            return [()]
        chunk = np.stack([i // c for i, c in zip(index, self.meta.chunk_shape)])
        order = np.lexsort(chunk[::-1])
        cuts = np.flatnonzero((np.diff(chunk[:, order], axis=1) != 0).any(0)) + 1
        done = []
        for picked in np.split(order, cuts):
            picked = np.sort(picked)
            coords = tuple(int(k) for k in chunk[:, picked[0]])
            patch_cells(self.store, self.path, self.meta, coords, [i[picked] for i in index], rows.column("value").take(pa.array(picked)))
            done.append(coords)
        return done

    def commit(self, messages):
        seen = [c for m in messages if m is not None for c in m.chunks]
        if len(seen) != len(set(seen)):
            raise Indexing("two tasks wrote one chunk; deal the rows with Array.by_chunk first")

    def abort(self, messages):
        pass


def install(spark: SparkSession) -> None:
    """Register the source and switch coordinate pushdown on, in this session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CellSource)
