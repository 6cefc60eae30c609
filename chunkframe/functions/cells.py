"""Column expressions over cell tables."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges of the integer types.
_RANGES = {f"{u}int{b}": (0, 2**b - 1) if u else (-(2 ** (b - 1)), 2 ** (b - 1) - 1) for u in ("", "u") for b in (8, 16, 32, 64)}
_SPARK = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)"}


def saturating_cast(value: Column, to: str) -> Column:
    """The integer cast of array writes: half away from zero, saturating, NaN to 0.  Bounds
    of 64 bits are no doubles, so values at or over them never reach the cast."""
    lo, hi = _RANGES[to]
    x = value.cast("double")
    r = F.when(F.abs(x) < 2.0**52, F.round(x)).otherwise(x)  # larger doubles are whole
    kind = _SPARK[to]
    high, low = F.lit(str(hi)).cast("decimal(20,0)").cast(kind), F.lit(str(lo)).cast("decimal(20,0)").cast(kind)
    return F.when(F.isnan(x), F.lit(0).cast(kind)).when(r >= float(hi), high).when(r <= float(lo), low).otherwise(r.try_cast(kind))


def chunk_columns(coords: list[str], chunk_shape) -> list[Column]:
    """Chunk numbers of a cell."""
    return [F.floor(F.col(c) / F.lit(k)).cast("bigint") for c, k in zip(coords, chunk_shape)]


def chunk_key(chunk: list[Column], separator: str = "/", encoding: str = "default") -> Column:
    """The store key of a chunk as a string column."""
    parts = [c.cast("string") for c in chunk]
    if encoding == "default":
        return F.concat_ws(separator, F.lit("c"), *parts)
    return F.concat_ws(separator, *parts) if parts else F.lit("0")


def chunk_coords(key: Column, rank: int, separator: str = "/", encoding: str = "default") -> Column:
    """Chunk numbers (array<bigint>) from a key column; null for other keys."""
    skip = 1 if encoding == "default" else 0
    escaped = "\\" + separator
    head = "c" + (escaped if rank else "") if encoding == "default" else ""
    pattern = "^" + head + escaped.join(["(0|[1-9][0-9]*)"] * rank) + "$"
    if encoding != "default" and not rank:
        pattern = "^0$"
    parts = F.slice(F.split(key, escaped), skip + 1, rank)
    return F.when(key.rlike(pattern), F.transform(parts, lambda p: p.cast("bigint")) if rank else F.array().cast("array<bigint>"))


def linear_index(coords: list[str], shape, order: str = "C") -> Column:
    """The position of a cell in the flattened array; F: first dimension fastest."""
    strides = [prod(shape[d + 1 :]) if order == "C" else prod(shape[:d]) for d in range(len(shape))]
    out = F.lit(0).cast("bigint")
    for c, s in zip(coords, strides):
        out = out + F.col(c) * F.lit(s)
    return out
