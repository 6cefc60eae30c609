"""The contract of codecs and the registry of their names."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..dtypes import DType
from ..errors import InvalidMetadata, UnsupportedCodec

ARRAY, SERIAL, BYTES = "array->array", "array->bytes", "bytes->bytes"


@dataclass
class Bound:
    """What a codec works on: the element type, the shape it gets, and the fill value."""

    dtype: DType
    shape: tuple[int, ...]
    fill: object


class Codec:
    name = ""
    kind = ""

    @property
    def configuration(self) -> dict | None:
        return None

    @property
    def json(self) -> dict:
        return {"name": self.name} if self.configuration is None else {"name": self.name, "configuration": self.configuration}

    def bind(self, bound: Bound) -> Bound:
        """Check the codec against its input; returns what the next codec gets."""
        return bound


class ArrayCodec(Codec):
    kind = ARRAY

    def encode(self, block: np.ndarray, bound: Bound) -> np.ndarray: ...
    def decode(self, block: np.ndarray, bound: Bound) -> np.ndarray: ...


class Serializer(Codec):
    kind = SERIAL

    def encode(self, block: np.ndarray, bound: Bound) -> bytes: ...
    def decode(self, data: bytes, bound: Bound) -> np.ndarray: ...


class ByteCodec(Codec):
    kind = BYTES

    def encode(self, data: bytes) -> bytes: ...
    def decode(self, data: bytes) -> bytes: ...


_registry: dict[str, type[Codec]] = {}


def register(cls: type[Codec]) -> type[Codec]:
    """Make a codec class known by its ``name`` (users may register their own)."""
    _registry[cls.name] = cls
    return cls


def build(entry) -> Codec:
    """A codec from its metadata entry."""
    if isinstance(entry, Codec):
        return entry
    if not isinstance(entry, dict) or not isinstance(entry.get("name"), str):
        raise InvalidMetadata(f"no codec entry: {entry!r}")
    cls = _registry.get(entry["name"])
    if cls is None:
        raise UnsupportedCodec(entry["name"])
    try:
        return cls(**(entry.get("configuration") or {}))
    except TypeError as e:
        raise InvalidMetadata(f"codec {entry['name']}: {e}") from e
