"""Cells between numpy blocks and Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..dtypes import DType

_WIDER = {"uint8": np.int16, "uint16": np.int32, "uint32": np.int64, "float16": np.float32}


def arrow_type(dtype: DType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(dtype.spark)


def to_arrow(cells: np.ndarray, dtype: DType) -> pa.Array:
    """A flat block as a column of ``dtype.spark``."""
    if dtype.kind in ("string", "utf32"):
        return pa.array(cells.tolist(), pa.string())
    if dtype.kind == "bytes":
        return pa.array(cells.tolist(), pa.binary())
    if dtype.kind == "complex":
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(cells.real)), pa.array(np.ascontiguousarray(cells.imag))], names=["re", "im"])
    if dtype.kind == "struct":
        return pa.StructArray.from_arrays([to_arrow(np.ascontiguousarray(cells[n]), d) for n, d in dtype.fields], names=[n for n, _ in dtype.fields])
    if dtype.name == "uint64":
        return pa.array(cells).cast(pa.decimal128(20, 0))
    if dtype.name in _WIDER:
        return pa.array(cells.astype(_WIDER[dtype.name]))
    return pa.array(cells)


def from_arrow(column, dtype: DType, fill) -> np.ndarray:
    """A column as a flat block; nulls become the fill value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if dtype.kind == "complex" and pa.types.is_struct(column.type):
        re, im = (column.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        out = (re + 1j * im).astype(dtype.numpy)
        if column.null_count:
            out[np.asarray(column.is_null())] = fill
        return out
    plain = pa.types.is_primitive(column.type) and not pa.types.is_decimal(column.type)
    if plain and not pa.types.is_temporal(column.type):
        missing = np.asarray(column.is_null()) if column.null_count else None
        values = column.fill_null(False if pa.types.is_boolean(column.type) else 0) if column.null_count else column
        out = dtype.coerce(values.to_numpy(zero_copy_only=False))
        if missing is not None:
            out[missing] = fill
        return out
    if pa.types.is_timestamp(column.type) or pa.types.is_duration(column.type):
        return from_arrow(column.cast(pa.int64()), dtype, fill)
    rows = column.to_pylist()
    missing = [i for i, v in enumerate(rows) if v is None]
    blank = {n: 0 if not isinstance(d.spark.typeName(), str) or d.kind not in ("utf32",) else "" for n, d in dtype.fields} if dtype.kind == "struct" else None
    flat = np.empty(len(rows), object)
    flat[:] = [blank if v is None and blank is not None else v for v in rows]
    out = dtype.coerce(flat)
    for i in missing:
        out[i] = fill
    return out
