"""Composition of codecs."""

from __future__ import annotations

import numpy as np

from ..dtypes import DType
from ..errors import InvalidCodecs
from .base import ARRAY, BYTES, SERIAL, Bound, Codec, build


def completed(entries: list, dtype: DType | None) -> list[Codec]:
    """The chain with the default serializer before the first bytes codec, if none is there."""
    chain = [build(e) for e in entries]
    if any(c.kind == SERIAL for c in chain):
        return chain
    at = next((i for i, c in enumerate(chain) if c.kind == BYTES), len(chain))
    kind = dtype.kind if dtype else ""
    default = build({"name": {"string": "vlen-utf8", "bytes": "vlen-bytes"}.get(kind, "bytes")})
    return [*chain[:at], default, *chain[at:]]


def fill_typesize(chain: list[Codec], dtype: DType) -> None:
    """Give blosc codecs without an item size that of the array, inside shards too."""
    for c in chain:
        if c.name == "blosc" and not c.typesize:
            c.typesize = dtype.itemsize
        if c.name == "sharding_indexed":
            fill_typesize(c.codecs, dtype)


class Pipeline:
    """A validated chain for blocks of one shape and type."""

    def __init__(self, codecs: list, dtype: DType, shape: tuple[int, ...], fill):
        self.codecs = [build(c) for c in codecs]
        kinds = [c.kind for c in self.codecs]
        if kinds.count(SERIAL) != 1:
            raise InvalidCodecs(f"{kinds.count(SERIAL)} array->bytes codecs; one is needed")
        order = [(ARRAY, SERIAL, BYTES).index(k) for k in kinds]
        if order != sorted(order):
            raise InvalidCodecs("codecs must go from arrays over the array->bytes codec to bytes")
        bound = Bound(dtype, tuple(shape), fill)
        self.bounds = []
        for c in self.codecs:
            self.bounds.append(bound)
            bound = c.bind(bound)

    def encode(self, block: np.ndarray) -> bytes:
        for c, b in zip(self.codecs, self.bounds):
            block = c.encode(block) if c.kind == BYTES else c.encode(block, b)
        return bytes(block)

    def decode(self, data: bytes) -> np.ndarray:
        for c, b in zip(reversed(self.codecs), reversed(self.bounds)):
            data = c.decode(data) if c.kind == BYTES else c.decode(data, b)
        return data

    @property
    def sole_sharding(self):
        """The sharding codec, if it is the whole chain: then byte ranges can be read."""
        return self.codecs[0] if len(self.codecs) == 1 and self.codecs[0].name == "sharding_indexed" else None
