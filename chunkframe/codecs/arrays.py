"""Transpose and the fixed-size serializer."""

from __future__ import annotations

import numpy as np

from ..errors import CodecError, InvalidCodecs
from .base import ArrayCodec, Bound, Serializer, register


@register
class Transpose(ArrayCodec):
    name = "transpose"

    def __init__(self, order):
        self.order = [int(x) for x in (order if isinstance(order, (list, tuple)) else [order])]

    @property
    def configuration(self):
        return {"order": self.order}

    def bind(self, bound: Bound) -> Bound:
        if sorted(self.order) != list(range(len(bound.shape))):
            raise CodecError(f"{self.order} is no permutation of {len(bound.shape)} dimensions")
        return Bound(bound.dtype, tuple(bound.shape[i] for i in self.order), bound.fill)

    def encode(self, block, bound):
        return block.transpose(self.order)

    def decode(self, block, bound):
        return block.transpose(np.argsort(self.order))


def _swapped(dtype: np.dtype, endian: str) -> np.dtype:
    return dtype.newbyteorder("<" if endian == "little" else ">")


@register
class BytesCodec(Serializer):
    name = "bytes"

    def __init__(self, endian: str = "little"):
        if endian not in ("little", "big"):
            raise InvalidCodecs(f"endian {endian!r}")
        self.endian = endian

    @property
    def configuration(self):
        return {"endian": self.endian}

    def bind(self, bound: Bound) -> Bound:
        if bound.dtype.variable:
            raise InvalidCodecs(f"bytes can't hold {bound.dtype.name}")
        return bound

    def encode(self, block, bound):
        return np.ascontiguousarray(block, _swapped(bound.dtype.numpy, self.endian)).tobytes()

    def decode(self, data, bound):
        dtype = bound.dtype.numpy
        want = dtype.itemsize * int(np.prod(bound.shape, dtype=np.int64))
        if len(data) != want:
            raise CodecError(f"{len(data)} bytes where {want} are needed")
        if bound.dtype.kind == "bool":
            return (np.frombuffer(data, np.uint8) != 0).reshape(bound.shape)
        return np.frombuffer(data, _swapped(dtype, self.endian)).astype(dtype, copy=False).reshape(bound.shape)
