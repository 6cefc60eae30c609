"""Codec chains: array to array, array to bytes, bytes to bytes."""

from .base import BYTES, ArrayCodec, ByteCodec, Codec, Serializer, build, register
from .pipeline import Pipeline, completed, fill_typesize
from . import arrays, compress, blosc, sharding, vlen  # noqa: F401,E402  - they register themselves

__all__ = ["BYTES", "ArrayCodec", "ByteCodec", "Codec", "Pipeline", "Serializer", "build", "completed", "fill_typesize", "register"]
