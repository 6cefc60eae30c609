"""Variable-length strings and bytes: a count, then length-prefixed items."""

from __future__ import annotations

import struct

import numpy as np

from ..errors import CodecError, InvalidCodecs
from .base import Bound, Serializer, register


class _Vlen(Serializer):
    wants = ""

    @property
    def configuration(self):
        return {}

    def bind(self, bound: Bound) -> Bound:
        if bound.dtype.kind != self.wants:
            raise InvalidCodecs(f"{self.name} can't hold {bound.dtype.name}")
        return bound

    def encode(self, block, bound):
        items = [self.to_bytes(v) for v in np.ascontiguousarray(block).reshape(-1)]
        parts = [struct.pack("<I", len(items))]
        for item in items:
            parts += (struct.pack("<I", len(item)), item)
        return b"".join(parts)

    def decode(self, data, bound):
        data = bytes(data)
        size = int(np.prod(bound.shape, dtype=np.int64))
        if len(data) < 4 or struct.unpack_from("<I", data)[0] != size:
            raise CodecError(f"the item count isn't {size}")
        out, at = np.empty(size, object), 4
        read = struct.Struct("<I").unpack_from
        for i in range(size):
            if at + 4 > len(data):
                raise CodecError("the data end within an item")
            n = read(data, at)[0]
            at += 4 + n
            if at > len(data):
                raise CodecError("the data end within an item")
            out[i] = self.from_bytes(data[at - n : at])
        return out.reshape(bound.shape)


@register
class VlenUtf8(_Vlen):
    name, wants = "vlen-utf8", "string"

    @staticmethod
    def to_bytes(v):
        return "" .encode() if v is None else v.encode()

    @staticmethod
    def from_bytes(b):
        try:
            return b.decode()
        except UnicodeDecodeError as e:
            raise CodecError(str(e)) from e


@register
class VlenBytes(_Vlen):
    name, wants = "vlen-bytes", "bytes"
    to_bytes = staticmethod(lambda v: v or b"")
    from_bytes = staticmethod(bytes)
