"""Chunk arithmetic on N-d boxes (no Spark, no I/O)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import prod
from typing import NamedTuple

from .errors import Indexing


class Part(NamedTuple):
    """A chunk's share of a region: within the chunk [lo, lo + n), in the output at ``out``."""

    coords: tuple[int, ...]
    lo: tuple[int, ...]
    n: tuple[int, ...]
    out: tuple[int, ...]

    @property
    def in_chunk(self) -> tuple[slice, ...]:
        return tuple(slice(a, a + k) for a, k in zip(self.lo, self.n))

    @property
    def in_out(self) -> tuple[slice, ...]:
        return tuple(slice(a, a + k) for a, k in zip(self.out, self.n))


def region(shape, start=None, count=None) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Validated (start, count); defaults are the whole array, ``None`` counts run to the end."""
    rank = len(shape)
    start = (0,) * rank if start is None else tuple(start)
    count = (None,) * rank if count is None else tuple(count)
    if len(start) != rank or len(count) != rank:
        raise Indexing(f"rank {rank} array, start {start}, count {count}")
    out = []
    for n, s, c in zip(shape, start, count):
        c = n - s if c is None or c == float("inf") else c
        if int(s) != s or int(c) != c or s < 0 or c < 0 or s + c > n:
            raise Indexing(f"start {s}, count {c} in a dimension of {n}")
        out.append((int(s), int(c)))
    return tuple(s for s, _ in out), tuple(c for _, c in out)


def along(start: int, count: int, chunk: int) -> list[tuple[int, int, int, int]]:
    """Per chunk that [start, start + count) meets: (chunk, from, length, output offset)."""
    end = start + count
    return [(k, max(start - k * chunk, 0), min(end, (k + 1) * chunk) - max(start, k * chunk), max(start, k * chunk) - start) for k in range(start // chunk, -(-end // chunk))] if count else []


def intersections(start, count, chunk_shape) -> Iterator[Part]:
    """The chunks that meet a region, last dimension fastest; rank 0 has one."""
    for picked in product(*(along(s, c, k) for s, c, k in zip(start, count, chunk_shape))):
        yield Part(*(tuple(x[j] for x in picked) for j in range(4)))


def grid_shape(shape, chunk_shape) -> tuple[int, ...]:
    return tuple(-(-n // c) for n, c in zip(shape, chunk_shape))


def visible(coords, shape, chunk_shape) -> tuple[int, ...]:
    """The extent of a chunk inside the array (edge chunks overhang)."""
    return tuple(max(0, min(c, n - k * c)) for k, n, c in zip(coords, shape, chunk_shape))


def cells(extent) -> int:
    return prod(extent)


def outside(coords, shape, chunk_shape) -> bool:
    """Wholly outside ``shape``; the first chunk of an empty dimension stays."""
    return any(k > max(-(-n // c) - 1, 0) for k, n, c in zip(coords, shape, chunk_shape))
