"""Compressors, the byte shuffle and the CRC-32C trailer."""

from __future__ import annotations

import gzip as _gzip
import struct
import zlib as _zlib

import numpy as np

from ..errors import ChecksumError, CodecError, InvalidCodecs, MissingCodecLibrary
from .base import ByteCodec, register


def _level(value, lo: int, hi: int) -> int:
    if int(value) != value or not lo <= value <= hi:
        raise InvalidCodecs(f"level {value} isn't in {lo}..{hi}")
    return int(value)


@register
class Gzip(ByteCodec):
    name = "gzip"

    def __init__(self, level: int = 5):
        self.level = _level(level, 0, 9)

    @property
    def configuration(self):
        return {"level": self.level}

    def encode(self, data):
        return _gzip.compress(data, self.level, mtime=0)

    def decode(self, data):
        member = _zlib.decompressobj(31)  # one gzip member; its checksum is verified
        try:
            out = member.decompress(data)
        except _zlib.error as e:
            raise CodecError(f"gzip: {e}") from e
        if not member.eof or member.unused_data:
            raise CodecError("gzip: truncated, or bytes after the member")
        return out


@register
class Zlib(ByteCodec):
    name = "numcodecs.zlib"

    def __init__(self, level: int = 1):
        self.level = _level(level, 0, 9)

    @property
    def configuration(self):
        return {"level": self.level}

    def encode(self, data):
        return _zlib.compress(data, self.level)

    def decode(self, data):
        try:
            return _zlib.decompress(data)
        except _zlib.error as e:
            raise CodecError(f"zlib: {e}") from e


@register
class Zstd(ByteCodec):
    name = "zstd"

    def __init__(self, level: int = 0, checksum: bool = False):
        self.level, self.checksum = _level(level, -131072, 22), bool(checksum)

    @property
    def configuration(self):
        return {"level": self.level, "checksum": self.checksum}

    @staticmethod
    def _library():
        try:
            import zstandard
        except ImportError as e:
            raise MissingCodecLibrary("zstandard") from e
        return zstandard

    def encode(self, data):
        return self._library().ZstdCompressor(level=self.level, write_checksum=self.checksum).compress(data)

    def decode(self, data):
        lib = self._library()
        try:
            if lib.get_frame_parameters(data).content_size not in (0, lib.CONTENTSIZE_UNKNOWN):
                return lib.ZstdDecompressor().decompress(data)
            return lib.ZstdDecompressor().decompressobj().decompress(data)
        except lib.ZstdError as e:
            raise CodecError(f"zstd: {e}") from e


@register
class Shuffle(ByteCodec):
    name = "numcodecs.shuffle"

    def __init__(self, elementsize: int = 4):
        if int(elementsize) != elementsize or elementsize < 1:
            raise InvalidCodecs(f"elementsize {elementsize}")
        self.size = int(elementsize)

    @property
    def configuration(self):
        return {"elementsize": self.size}

    def encode(self, data):
        return shuffled(bytes(data), self.size)

    def decode(self, data):
        return unshuffled(bytes(data), self.size)


def shuffled(data: bytes, size: int) -> bytes:
    n = len(data) // size
    if size in (2, 4, 8):  # planes by shifts of whole words: several times faster than a transpose
        words = np.frombuffer(data, f"<u{size}", n)
        return b"".join((words >> words.dtype.type(8 * k)).astype(np.uint8).tobytes() for k in range(size)) + data[n * size :]
    return np.frombuffer(data, np.uint8, n * size).reshape(-1, size).T.tobytes() + data[n * size :]


def unshuffled(data: bytes, size: int) -> bytes:
    n = len(data) // size
    planes = np.frombuffer(data, np.uint8, n * size).reshape(size, n)
    out = np.empty((n, size), np.uint8)
    for k in range(size):
        out[:, k] = planes[k]
    return out.tobytes() + data[n * size :]


# -- CRC-32C -----------------------------------------------------------------
def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1).astype(np.uint32)
    return t


_T = _table()


def _apply(tables: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given as four tables by byte."""
    return tables[0][v & 255] ^ tables[1][v >> 8 & 255] ^ tables[2][v >> 16 & 255] ^ tables[3][v >> 24]


def _zeros(n: int) -> np.ndarray:
    """The map of a register over ``n`` zero bytes, by repeated squaring."""
    bytes_ = np.arange(256, dtype=np.uint32)
    at = np.stack([bytes_, bytes_ << 8, bytes_ << 16, bytes_ << 24])
    out, step = at, np.stack([_T[v & 255] ^ (v >> 8) for v in at])
    while n:
        if n & 1:
            out = _apply(step, out)
        step = _apply(step, step)
        n >>= 1
    return out


def crc32c(data: bytes, lane: int = 256) -> int:
    """CRC-32C: lanes of equal length advance together, then fold pairwise."""
    n = len(data)
    if n < 4:
        crc = 0xFFFFFFFF
        for b in data:
            crc = int(_T[(crc ^ b) & 255]) ^ crc >> 8
        return crc ^ 0xFFFFFFFF
    lanes = 1 << max(0, (max(1, -(-n // lane)) - 1).bit_length())
    length = -(-n // lanes)
    block = np.zeros(lanes * length, np.uint8)
    block[-n:] = np.frombuffer(data, np.uint8)  # zeros in front of a zero register change nothing
    block[-n : len(block) - n + 4] ^= 255  # the initial value
    rows = np.ascontiguousarray(block.reshape(lanes, length).T)
    crc = np.zeros(lanes, np.uint32)
    for row in rows:
        crc = _T[(crc ^ row) & 255] ^ crc >> 8
    shift = _zeros(length)
    while len(crc) > 1:
        crc = _apply(shift, crc[::2]) ^ crc[1::2]
        shift = _apply(shift, shift)
    return int(crc[0]) ^ 0xFFFFFFFF


@register
class Crc32c(ByteCodec):
    name = "crc32c"

    def encode(self, data):
        return bytes(data) + struct.pack("<I", crc32c(bytes(data)))

    def decode(self, data):
        data = bytes(data)
        if len(data) < 4:
            raise CodecError("no room for a checksum")
        if struct.unpack("<I", data[-4:])[0] != crc32c(data[:-4]):
            raise ChecksumError("CRC-32C doesn't match")
        return data[:-4]
