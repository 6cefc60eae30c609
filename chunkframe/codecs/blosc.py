"""The Blosc 1 frame: 16-byte header, block offsets, filtered and compressed blocks.

Encoding writes one stream per block by zstd, lz4, zlib or snappy; ``lz4hc`` is
written by the plain lz4 compressor (same stream format, less effort) and ``blosclz`` as
a stored frame, which every reader accepts.  Decoding reads all formats.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

from ..errors import CodecError, InvalidCodecs
from .base import ByteCodec, register
from .compress import shuffled, unshuffled

# Numbers of the inner formats and the flags of the header.
_FORMATS = {"blosclz": 0, "lz4": 1, "lz4hc": 1, "snappy": 2, "zlib": 3, "zstd": 4}
_SHUFFLE, _STORED, _BITSHUFFLE, _ONE_STREAM = 1, 2, 4, 16
_HEADER = "<BBBBIII"
_BLOCK = 256 * 1024
_SHUFFLES = ("noshuffle", "shuffle", "bitshuffle")


def _bits(data: bytes, size: int) -> bytes:
    n = len(data) // size
    if n % 8:
        return data
    bits = np.unpackbits(np.frombuffer(data, np.uint8, n * size).reshape(n, size), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").tobytes() + data[n * size :]


def _unbits(data: bytes, size: int) -> bytes:
    n = len(data) // size
    if n % 8 or not n:
        return data
    bits = np.unpackbits(np.frombuffer(data, np.uint8, n * size).reshape(size * 8, n // 8), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").tobytes() + data[n * size :]


def _unblosclz(data: bytes, size: int) -> bytes:
    """Literal runs and back references of the blosclz stream."""
    out, at, end = bytearray(), 0, len(data)
    control = data[0] & 31
    at = 1
    while True:
        if control < 32:
            out += data[at : at + control + 1]
            at += control + 1
        else:
            length, distance = (control >> 5) - 1, (control & 31) << 8
            if length == 6:
                while True:
                    more = data[at]
                    at += 1
                    length += more
                    if more != 255:
                        break
            low = data[at]
            at += 1
            if low == 255 and distance == 31 << 8:
                distance = (data[at] << 8) + data[at + 1] + 8191
                at += 2
            else:
                distance += low
            length, distance = length + 3, distance + 1
            if distance > len(out):
                raise CodecError("blosclz: reference before the start")
            while length:
                piece = out[-distance:][:length] if distance > 0 else b""
                out += piece
                length -= len(piece)
        if at >= end:
            break
        control = data[at]
        at += 1
    if len(out) != size:
        raise CodecError("blosclz: wrong size")
    return bytes(out)


def _compress(name: str, level: int, data: bytes) -> bytes:
    if name == "zlib":
        return zlib.compress(data, level)
    if name == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=min(2 * level - 1, 22)).compress(data)
    return pa.Codec("snappy" if name == "snappy" else "lz4_raw").compress(data, asbytes=True)


def _decompress(fmt: int, data: bytes, size: int) -> bytes:
    try:
        if fmt == 0:
            out = _unblosclz(data, size)
        elif fmt == 3:
            out = zlib.decompress(data)
        elif fmt in (1, 2, 4):
            out = pa.Codec({1: "lz4_raw", 2: "snappy", 4: "zstd"}[fmt]).decompress(data, decompressed_size=size, asbytes=True)
        else:
            raise CodecError(f"blosc: inner format {fmt}")
    except (zlib.error, OSError, IndexError, pa.ArrowException) as e:
        raise CodecError(f"blosc: {e}") from e
    if len(out) != size:
        raise CodecError("blosc: wrong block size")
    return out


@register
class Blosc(ByteCodec):
    name = "blosc"

    def __init__(self, cname: str = "zstd", clevel: int = 5, shuffle="shuffle", typesize: int = 0, blocksize: int = 0):
        shuffle = _SHUFFLES[shuffle] if isinstance(shuffle, int) and 0 <= shuffle < 3 else shuffle
        if cname not in _FORMATS or shuffle not in _SHUFFLES or not 0 <= clevel <= 9 or typesize < 0:
            raise InvalidCodecs(f"blosc: {cname}, level {clevel}, {shuffle}, typesize {typesize}")
        self.cname, self.clevel, self.shuffle, self.typesize, self.blocksize = cname, int(clevel), shuffle, int(typesize), int(blocksize)

    @property
    def configuration(self):
        return {"cname": self.cname, "clevel": self.clevel, "shuffle": self.shuffle, "typesize": self.typesize, "blocksize": self.blocksize}

    def encode(self, data):
        if self.typesize < 1:
            raise InvalidCodecs("blosc needs a typesize")
        data = bytes(data)
        size = min(self.typesize, 255)
        flags = {"noshuffle": 0, "shuffle": _SHUFFLE, "bitshuffle": _BITSHUFFLE}[self.shuffle] | _FORMATS[self.cname] << 5 | _ONE_STREAM
        block = max(size * 8, _BLOCK // (size * 8) * size * 8)
        block = min(block, max(len(data), 1))
        stored = struct.pack(_HEADER, 2, 1, flags | _STORED, size, len(data), block, 16 + len(data)) + data
        if not data or self.clevel == 0 or self.cname == "blosclz":
            return stored
        parts, starts = [], []
        n = -(-len(data) // block)
        at = 16 + 4 * n
        for k in range(n):
            raw = data[k * block : (k + 1) * block]
            if size > 1 or self.shuffle == "bitshuffle":
                raw = {"noshuffle": lambda d, s: d, "shuffle": shuffled, "bitshuffle": _bits}[self.shuffle](raw, size)
            packed = _compress(self.cname, self.clevel, raw)
            packed = packed if len(packed) < len(raw) else raw
            starts.append(at)
            parts += (struct.pack("<i", len(packed)), packed)
            at += 4 + len(packed)
        if at >= len(stored):
            return stored
        return struct.pack(_HEADER, 2, 1, flags, size, len(data), block, at) + struct.pack(f"<{n}i", *starts) + b"".join(parts)

    def decode(self, data):
        data = bytes(data)
        if len(data) < 16:
            raise CodecError("blosc: no header")
        version, _, flags, size, total, block, packed = struct.unpack_from(_HEADER, data)
        if packed != len(data) or version not in (1, 2):
            raise CodecError("blosc: header and data don't match")
        if flags & _STORED:
            if len(data) != 16 + total:
                raise CodecError("blosc: truncated")
            return data[16:]
        if not total:
            return b""
        n = -(-total // block)
        out = []
        try:
            for k, at in enumerate(struct.unpack_from(f"<{n}i", data, 16)):
                want = min(block, total - k * block)
                splits = size if not flags & _ONE_STREAM and want == block and size <= 16 and block // size >= 128 else 1
                raw = []
                for _ in range(splits):
                    length = struct.unpack_from("<i", data, at)[0]
                    piece = data[at + 4 : at + 4 + length]
                    if length < 0 or len(piece) != length:
                        raise CodecError("blosc: truncated")
                    raw.append(piece if length == want // splits else _decompress(flags >> 5, piece, want // splits))
                    at += 4 + length
                whole = b"".join(raw)
                if flags & _SHUFFLE and size > 1:
                    whole = unshuffled(whole, size)
                elif flags & _BITSHUFFLE:
                    whole = _unbits(whole, size)
                out.append(whole)
        except struct.error as e:
            raise CodecError(f"blosc: {e}") from e
        return b"".join(out)
