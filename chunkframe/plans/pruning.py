"""From coordinate predicates to the chunks that a scan must touch."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from math import ceil, floor, prod

from ..grid import Part


@dataclass
class Bounds:
    """Per dimension a half-open interval and, if an IN list was given, its sorted values."""

    low: list[int]
    high: list[int]
    values: list[list[int] | None] = field(default_factory=list)

    @classmethod
    def of(cls, start, count) -> Bounds:
        return cls(list(start), [s + c for s, c in zip(start, count)], [None] * len(start))

    def narrow(self, d: int, op: str, value) -> None:
        if value is None:
            self.high[d] = self.low[d]
        elif op == "=":
            self.low[d], self.high[d] = max(self.low[d], ceil(value)), min(self.high[d], floor(value) + 1)
        elif op == ">":
            self.low[d] = max(self.low[d], floor(value) + 1)
        elif op == ">=":
            self.low[d] = max(self.low[d], ceil(value))
        elif op == "<":
            self.high[d] = min(self.high[d], ceil(value))
        elif op == "<=":
            self.high[d] = min(self.high[d], floor(value) + 1)
        elif op == "in":
            found = {int(v) for v in value if v is not None and int(v) == v}
            old = self.values[d]
            self.values[d] = sorted(found if old is None else found & set(old))

    def along(self, d: int, chunk: int) -> list[int]:
        """The chunk numbers of one dimension that can hold a wanted cell."""
        if self.high[d] <= self.low[d]:
            return []
        if self.values[d] is None:
            return range(self.low[d] // chunk, (self.high[d] - 1) // chunk + 1)
        return sorted({v // chunk for v in self.wanted(d, self.low[d], self.high[d])})

    def wanted(self, d: int, low: int, high: int) -> list[int]:
        """The listed values in [low, high)."""
        v = self.values[d]
        return v[bisect_left(v, max(low, self.low[d])) : bisect_right(v, min(high, self.high[d]) - 1)]

    @property
    def hit(self):
        """Whether an interval of a dimension holds a wanted cell; None if all do."""
        if all(v is None for v in self.values):
            return None
        return lambda d, low, high: self.values[d] is None or bool(self.wanted(d, low, high))

    def part(self, coords, chunk_shape) -> Part:
        """The share of one chunk."""
        low = [max(a, k * c) for a, k, c in zip(self.low, coords, chunk_shape)]
        high = [min(b, (k + 1) * c) for b, k, c in zip(self.high, coords, chunk_shape)]
        return Part(tuple(coords), tuple(a - k * c for a, k, c in zip(low, coords, chunk_shape)), tuple(b - a for a, b in zip(low, high)), tuple(low))


@dataclass
class ChunkRange:
    """Chunks by odometer number (last dimension fastest) of a product of lists, so a plan
    of any number of chunks stays small."""

    axes: list
    first: int = 0
    last: int | None = None

    @property
    def size(self) -> int:
        return prod(map(len, self.axes))

    def __iter__(self):
        for n in range(self.first, self.size if self.last is None else self.last):
            coords = []
            for axis in reversed(self.axes):
                n, k = divmod(n, len(axis))
                coords.append(axis[k])
            yield tuple(reversed(coords))

    def split(self, parts: int) -> list[ChunkRange]:
        parts = max(1, min(parts, self.size))
        cuts = [self.size * k // parts for k in range(parts + 1)]
        return [ChunkRange(self.axes, a, b) for a, b in zip(cuts, cuts[1:])] if self.size else []


def plan(bounds: Bounds, chunk_shape, cell_bytes: int, partitions: int | None = None, target: int = 64 << 20, least: int = 32) -> list[ChunkRange]:
    """Chunk ranges for tasks of about ``target`` bytes, and ``least`` tasks if there are
    as many chunks."""
    whole = ChunkRange([bounds.along(d, c) for d, c in enumerate(chunk_shape)])
    return whole.split(partitions or max(least, -(-whole.size * cell_bytes // target)))
