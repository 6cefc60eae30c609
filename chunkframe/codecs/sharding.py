"""Shards: inner chunks with an index of (offset, length), read by byte ranges."""

from __future__ import annotations

from math import prod

import numpy as np

from ..dtypes import parse
from ..errors import CodecError, InvalidMetadata, UnsupportedCodec
from ..grid import grid_shape, intersections
from .base import Bound, Serializer, build, register
from .pipeline import Pipeline, completed

_MISSING = 2**64 - 1
#: Bytes that one ranged read may fetch for several inner chunks.
MERGED = 16 << 20


@register
class Sharding(Serializer):
    name = "sharding_indexed"

    def __init__(self, chunk_shape, codecs=None, index_codecs=None, index_location: str = "end"):
        self.inner = tuple(int(x) for x in (chunk_shape if isinstance(chunk_shape, (list, tuple)) else [chunk_shape]))
        if index_location not in ("start", "end") or any(x < 1 for x in self.inner):
            raise InvalidMetadata(f"shard of {chunk_shape}, index at {index_location!r}")
        self.codecs = completed(list(codecs or []), None)
        self.index_codecs = completed(list(index_codecs), None) if index_codecs else [build({"name": "bytes"}), build({"name": "crc32c"})]
        self.location = index_location

    @property
    def configuration(self):
        return {"chunk_shape": list(self.inner), "codecs": [c.json for c in self.codecs], "index_codecs": [c.json for c in self.index_codecs], "index_location": self.location}

    def bind(self, bound: Bound) -> Bound:
        if not bound.shape or len(self.inner) != len(bound.shape) or any(s % c for s, c in zip(bound.shape, self.inner)):
            raise InvalidMetadata(f"inner chunks {self.inner} don't divide shards {bound.shape}")
        if other := [c.name for c in self.index_codecs if c.name not in ("bytes", "crc32c")]:
            raise UnsupportedCodec(f"index codecs {other} have no fixed encoded size")
        self.grid = grid_shape(bound.shape, self.inner)
        self.pipeline = Pipeline(self.codecs, bound.dtype, self.inner, bound.fill)
        self.index_pipeline = Pipeline(self.index_codecs, parse("uint64"), (*self.grid, 2), np.uint64(_MISSING))
        self.index_size = 16 * prod(self.grid) + 4 * sum(c.name == "crc32c" for c in self.index_codecs)
        return bound

    def encode(self, block, bound):
        at = self.index_size if self.location == "start" else 0
        index = np.full((*self.grid, 2), _MISSING, np.uint64)
        blobs = []
        for part in intersections((0,) * block.ndim, bound.shape, self.inner):
            piece = block[part.in_out]
            if not bound.dtype.is_fill(piece, bound.fill):
                blobs.append(self.pipeline.encode(piece))
                index[part.coords] = at, len(blobs[-1])
                at += len(blobs[-1])
        tail = self.index_pipeline.encode(index)
        return b"".join([tail, *blobs] if self.location == "start" else [*blobs, tail])

    def index(self, data: bytes) -> np.ndarray:
        if len(data) != self.index_size:
            raise CodecError(f"a shard index of {len(data)} bytes; {self.index_size} are needed")
        return self.index_pipeline.decode(data)

    def decode(self, data, bound):
        data = bytes(data)
        index = self.index(data[: self.index_size] if self.location == "start" else data[max(0, len(data) - self.index_size) :])
        return self.gather(index, lambda at, n: data[at : at + n], bound, (0,) * len(bound.shape), bound.shape)

    def gather(self, index, fetch, bound, start, count, hit=None) -> np.ndarray:
        """The region (start, count) of the shard; ``fetch(offset, length)`` gets its bytes.
        ``hit(d, low, high)`` tells whether a wanted cell is in an interval of a dimension;
        inner chunks without any stay at the fill value.  Ranges that touch each other
        are fetched at once, up to ``MERGED`` bytes."""
        out = bound.dtype.filled(count, bound.fill)
        wanted = []
        for part in intersections(start, count, self.inner):
            at, n = (int(x) for x in index[part.coords])
            if at == _MISSING and n == _MISSING:
                continue
            if hit is None or all(hit(d, k * c + a, k * c + a + m) for d, (k, c, a, m) in enumerate(zip(part.coords, self.inner, part.lo, part.n))):
                wanted.append((at, n, part))
        wanted.sort(key=lambda x: x[0])
        first = 0
        while first < len(wanted):
            last, begin = first + 1, wanted[first][0]
            end = begin + wanted[first][1]
            while last < len(wanted) and wanted[last][0] == end and end + wanted[last][1] - begin <= MERGED:
                end += wanted[last][1]
                last += 1
            data = fetch(begin, end - begin)
            if data is None or len(data) != end - begin:
                raise CodecError("a shard ends within an inner chunk")
            for at, n, part in wanted[first:last]:
                out[part.in_out] = self.pipeline.decode(data[at - begin : at - begin + n])[part.in_chunk]
            first = last
        return out

    def read(self, get_partial, get_suffix, bound, start, count, hit=None) -> np.ndarray | None:
        """A region by byte ranges: the index first, then the inner chunks that are met.
        None if the shard doesn't exist."""
        head = get_partial(0, self.index_size) if self.location == "start" else get_suffix(self.index_size)
        if head is None:
            return None
        return self.gather(self.index(head), get_partial, bound, start, count, hit)
