"""Stores whose bytes come from the encoders of this file, written from the format's rules with
``struct``, ``zlib``, ``gzip``, ``zstandard`` and Arrow's lz4, not from the engine's codecs: an
error made in both our encoder and our decoder shows here."""

import gzip
import itertools
import json
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

import chunkframe as cf

# The interoperability cases (name, type, shape, chunk, then what differs from the
# default of raw little-endian bytes: shard shape, codecs behind the bytes, part written, ...).
CASES = [
    ("f64_gzip", "float64", (10, 13), (4, 5), {"pack": ["gzip5"]}),
    ("i32_crc", "int32", (5, 4, 3), (2, 2, 2), {"pack": ["gzip1", "crc32c"]}),
    ("f32_be", "float32", (8,), (3,), {"endian": "big"}),
    ("f64_transpose", "float64", (6, 8), (3, 4), {"transpose": [1, 0]}),
    ("f16", "float16", (11,), (4,), {"pack": ["gzip5"]}),
    ("c128", "complex128", (4, 5), (2, 3), {"pack": ["gzip5"]}),
    ("c64", "complex64", (6,), (4,), {}),
    ("bool", "bool", (7, 3), (4, 2), {}),
    ("u64", "uint64", (6,), (4,), {"fill": 2**60, "part": (3,)}),
    ("i64", "int64", (5,), (2,), {}),
    ("u8", "uint8", (9, 2), (4, 2), {}),
    ("i8", "int8", (9,), (5,), {}),
    ("u16", "uint16", (7,), (3,), {}),
    ("i16", "int16", (7,), (3,), {}),
    ("u32", "uint32", (7,), (3,), {}),
    ("f32", "float32", (3, 4, 2, 2), (2, 2, 2, 2), {"pack": ["gzip5"]}),
    ("nanfill", "float64", (6, 6), (3, 3), {"fill": "NaN", "part": (3, 3)}),
    ("scalar", "float64", (), (), {}),
    ("v2keys", "float64", (5, 5), (2, 2), {"v2": True}),
    ("shard2d", "float64", (12, 10), (3, 5), {"shards": [(6, 10)], "pack": ["gzip5"]}),
    ("shard_start", "int32", (8, 8), (2, 2), {"shards": [(4, 8)], "index": "start"}),
    ("shard_fill", "float64", (8, 8), (2, 2), {"shards": [(4, 4)], "fill": "NaN", "part": (2, 2)}),
    ("shard3d", "int16", (6, 4, 4), (3, 2, 2), {"shards": [(6, 4, 4)], "pack": ["gzip1", "crc32c"]}),
    ("zstd_default", "float64", (10, 8), (4, 3), {"pack": ["zstd"]}),
    ("zstd_hi_ck", "int32", (20,), (7,), {"pack": ["zstd19ck"]}),
    ("blosc_lz4_shuf", "float32", (9, 7), (4, 4), {"pack": ["blosc lz4 shuffle"]}),
    ("blosc_zstd_bit", "int16", (12,), (5,), {"pack": ["blosc zstd bitshuffle"]}),
    ("blosc_blosclz_noshuf", "uint8", (6, 6), (3, 3), {"pack": ["blosc blosclz noshuffle"]}),
    ("shard_zstd", "float64", (8, 8), (2, 4), {"shards": [(4, 8)], "pack": ["zstd"]}),
    ("defaults", "float64", (7, 5), (3, 3), {"pack": ["zstd"]}),
    ("str2d", "string", (5, 4), (2, 3), {"pack": ["gzip5"]}),
    ("str_shard", "string", (6,), (2,), {"shards": [(6,)]}),
    ("vbytes", "variable_length_bytes", (7,), (3,), {}),
    ("dt_ns", "datetime64[ns]", (6,), (3,), {}),
    ("td_ms", "timedelta64[ms]", (5,), (2,), {"pack": ["gzip5"]}),
    ("dt_fill", "datetime64[s]", (4,), (2,), {"part": (2,)}),
    ("blosc_lz4hc_shuf", "float64", (8, 6), (3, 3), {"pack": ["blosc lz4hc shuffle"]}),
    ("blosc_zlib_shuf", "int32", (10,), (4,), {"pack": ["blosc zlib shuffle"]}),
    ("gzip9", "float32", (6, 6), (3, 3), {"pack": ["gzip9"]}),
    ("shard_nested", "float64", (8, 8), (2, 2), {"shards": [(8, 8), (4, 4)]}),
    ("zlib5", "float64", (8, 6), (4, 3), {"pack": ["zlib5"]}),
    ("shuffle_zlib", "int32", (10,), (4,), {"pack": ["shuffle4", "zlib1"]}),
]
_MISSING = 2**64 - 1


def pattern(dtype, shape):
    """Cell k (row by row) from k mod 251."""
    b = np.arange(math.prod(shape)) % 251
    if dtype == "string":
        flat = np.array([f"s{x}" for x in b], object)
    elif dtype == "variable_length_bytes":
        flat = np.array([bytes(range(x % 5)) for x in b], object)
    elif "time" in dtype:
        flat = b.astype("<i8")
    elif dtype == "bool":
        flat = (b % 2).astype(bool)
    elif dtype.startswith("complex"):
        flat = (b / 4 + 1j * (b / 4 + 0.5)).astype(dtype)
    else:
        flat = (b / 4 if dtype.startswith("float") else b).astype(dtype)
    return flat.reshape(shape)


def fill_of(dtype, options):
    """(in the document, as a cell)"""
    if "fill" in options:
        return options["fill"], np.nan if options["fill"] == "NaN" else options["fill"]
    if dtype in ("string", "variable_length_bytes"):
        return "", "" if dtype == "string" else b""
    if "time" in dtype:
        return "NaT", -(2**63)
    return ([0.0, 0.0], 0) if dtype.startswith("complex") else (False, False) if dtype == "bool" else (0, 0)


def crc32c(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return struct.pack("<I", crc ^ 0xFFFFFFFF)


def byte_planes(data, size):
    return np.frombuffer(data, np.uint8).reshape(-1, size).T.tobytes()


def blosc(data, how, size):
    """One block, not split; what doesn't shrink is stored as it is."""
    _, kind, shuffle = how.split()
    packed = data
    flags = 0x10
    if shuffle == "shuffle":
        packed, flags = byte_planes(data, size), flags | 1
    elif shuffle == "bitshuffle":
        assert len(data) // size < 8  # too few cells for a group of eight: unchanged
        flags |= 4
    made = {"lz4": lambda: pa.compress(packed, "lz4_raw", asbytes=True), "lz4hc": lambda: pa.compress(packed, "lz4_raw", asbytes=True),
            "zlib": lambda: zlib.compress(packed, 5), "zstd": lambda: zstandard.compress(packed, 5), "blosclz": lambda: packed}[kind]()
    flags |= {"blosclz": 0, "lz4": 1, "lz4hc": 1, "zlib": 3, "zstd": 4}[kind] << 5
    if kind == "blosclz":
        return struct.pack("<BBBBIII", 2, 1, flags | 2, size, len(data), len(data), 16 + len(data)) + data
    return struct.pack("<BBBBIII", 2, 1, flags, size, len(data), len(data), 24 + len(made)) + struct.pack("<II", 20, len(made)) + made


def squeeze(data, how, size):
    if how == "crc32c":
        return data + crc32c(data)
    if how.startswith("gzip"):
        return gzip.compress(data, int(how[4:]))
    if how.startswith("zlib"):
        return zlib.compress(data, int(how[4:]))
    if how.startswith("zstd"):
        return zstandard.ZstdCompressor(level=19 if "19" in how else 3, write_checksum="ck" in how).compress(data)
    return byte_planes(data, int(how[7:])) if how.startswith("shuffle") else blosc(data, how, size)


def entry_of(how, size):
    if how == "crc32c":
        return {"name": "crc32c"}
    if how.startswith("gzip"):
        return {"name": "gzip", "configuration": {"level": int(how[4:])}}
    if how.startswith("zlib"):
        return {"name": "numcodecs.zlib", "configuration": {"level": int(how[4:])}}
    if how.startswith("zstd"):
        return {"name": "zstd", "configuration": {"level": 19 if "19" in how else 0, "checksum": "ck" in how}}
    if how.startswith("shuffle"):
        return {"name": "numcodecs.shuffle", "configuration": {"elementsize": int(how[7:])}}
    _, kind, shuffle = how.split()
    return {"name": "blosc", "configuration": {"cname": kind, "clevel": 5, "shuffle": shuffle, "typesize": size, "blocksize": 0}}


def boxes(shape, step):
    for at in itertools.product(*(range(0, n, s) for n, s in zip(shape, step))):
        yield tuple(a // s for a, s in zip(at, step)), tuple(slice(a, a + s) for a, s in zip(at, step))


def is_empty(block, fill):
    return all(x == fill or (x != x and fill != fill) for x in block.reshape(-1).tolist())


class Foreign:
    """The document and chunks of a case."""

    def __init__(self, dtype, shape, chunk, options):
        self.dtype, self.chunk, self.options = dtype, chunk, options
        self.size = 8 if "time" in dtype else 1 if dtype in ("string", "variable_length_bytes") else np.dtype(dtype).itemsize
        written, self.fill = fill_of(dtype, options)
        shards = [*options.get("shards", []), chunk]
        codecs = [entry_of(how, self.size) for how in options.get("pack", [])]
        serial = {"string": {"name": "vlen-utf8"}, "variable_length_bytes": {"name": "vlen-bytes"}}.get(dtype)
        codecs = [serial or ({"name": "bytes"} if self.size == 1 else {"name": "bytes", "configuration": {"endian": options.get("endian", "little")}}), *codecs]
        if "transpose" in options:
            codecs = [{"name": "transpose", "configuration": {"order": options["transpose"]}}, *codecs]
        for inner in shards[:0:-1]:
            index = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}]
            codecs = [{"name": "sharding_indexed", "configuration": {"chunk_shape": list(inner), "codecs": codecs, "index_codecs": index, "index_location": options.get("index", "end")}}]
        base, _, unit = dtype.partition("[")
        kind = {"name": f"numpy.{base}", "configuration": {"unit": unit[:-1], "scale_factor": 1}} if unit else dtype
        keys = {"name": "v2", "configuration": {"separator": "."}} if options.get("v2") else {"name": "default", "configuration": {"separator": "/"}}
        self.document = json.dumps({"zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": kind, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(shards[0])}},
                                    "chunk_key_encoding": keys, "fill_value": written, "codecs": codecs, "attributes": {}}).encode()
        # cells, padded with the fill value to whole chunks
        self.values = pattern(dtype, shape)
        self.part = tuple(slice(0, n) for n in options.get("part", shape))
        self.cells = np.full(shape, self.fill, self.values.dtype)
        self.cells[self.part] = self.values[self.part]
        padded = np.full(tuple(-(-n // s) * s for n, s in zip(shape, shards[0])), self.fill, self.values.dtype)
        padded[tuple(slice(0, n) for n in shape)] = self.cells
        self.chunks = {}
        for at, box in boxes(padded.shape, shards[0]):
            if not is_empty(padded[box], self.fill) or not shape:
                key = ".".join(map(str, at)) if options.get("v2") else "/".join(["c", *map(str, at)])
                self.chunks[key] = self.encode(padded[box], shards[1:])

    def encode(self, block, inner):
        if inner:
            blobs, index, size = [], [], 0
            head = 16 * sum(1 for _ in boxes(block.shape, inner[0])) + 4 if self.options.get("index") == "start" else 0
            for _, box in boxes(block.shape, inner[0]):
                if is_empty(block[box], self.fill):
                    index += [_MISSING, _MISSING]
                    continue
                blobs.append(self.encode(block[box], inner[1:]))
                index += [head + size, len(blobs[-1])]
                size += len(blobs[-1])
            table = struct.pack(f"<{len(index)}Q", *index)
            table += crc32c(table)
            return b"".join([table, *blobs] if head else [*blobs, table])
        block = np.transpose(block, self.options["transpose"]) if "transpose" in self.options else block
        if block.dtype == object:
            items = [x.encode() if isinstance(x, str) else x for x in block.reshape(-1)]
            data = struct.pack("<I", len(items)) + b"".join(struct.pack("<I", len(x)) + x for x in items)
        else:
            data = block.astype(block.dtype.newbyteorder(">" if self.options.get("endian") == "big" else "<")).tobytes()
        for how in self.options.get("pack", []):
            data = squeeze(data, how, self.size)
        return data


def same(got, want):
    got = np.asarray(got)
    if want.dtype == object:
        return got.shape == want.shape and got.tolist() == want.tolist()
    if got.dtype.kind in "mM":
        got = got.view("<i8")
    return got.shape == want.shape and np.array_equal(got, want, equal_nan=want.dtype.kind in "fc")


@pytest.mark.parametrize("name,dtype,shape,chunk,options", CASES, ids=[c[0] for c in CASES])
def test_foreign_bytes(name, dtype, shape, chunk, options):
    foreign = Foreign(dtype, shape, chunk, options)
    store = cf.MemoryStore()
    store.set("zarr.json", foreign.document)
    for key, data in foreign.chunks.items():
        store.set(key, data)
    array = cf.open(store)
    assert same(array.read(), foreign.cells)
    if shape:
        last = [n - 1 for n in shape]
        assert same(array.read(last, [1] * len(shape)), foreign.cells[tuple(slice(n, n + 1) for n in last)])
    # the other way: where the encoding is fixed, our bytes are those of the rules
    ours = cf.MemoryStore()
    ours.set("zarr.json", foreign.document)
    cf.open(ours).write(foreign.values[foreign.part])
    assert set(ours.list()) == {"zarr.json", *foreign.chunks}
    if not any(how not in ("crc32c", "shuffle4") for how in options.get("pack", [])):
        assert {key: ours.get(key) for key in foreign.chunks} == foreign.chunks
    assert same(cf.open(ours).read(), foreign.cells)


@pytest.mark.parametrize("case,key,want", [
    ("f32_be", "c/0", "00000000 3e800000 3f000000"), ("f32_be", "c/2", "3fc00000 3fe00000 00000000"), ("u16", "c/1", "0300 0400 0500"), ("bool", "c/0/0", "00 01 01 00 00 01 01 00"),
    ("c64", "c/0", "00000000 0000003f 0000803e 0000403f 0000003f 0000803f 0000403f 0000a03f"), ("vbytes", "c/0", "03000000 00000000 01000000 00 02000000 0001"), ("dt_fill", "c/0", "0000000000000000 0100000000000000"),
    ("i8", "c/1", "05 06 07 08 00"), ("v2keys", "0.0", "0000000000000000 000000000000d03f 000000000000f43f 000000000000f83f"), ("scalar", "c", "0000000000000000"),
])
def test_literal_bytes(case, key, want):
    """Chunks by hand, against both encoders."""
    name, dtype, shape, chunk, options = next(c for c in CASES if c[0] == case)
    foreign = Foreign(dtype, shape, chunk, options)
    store = cf.MemoryStore()
    store.set("zarr.json", foreign.document)
    cf.open(store).write(foreign.values[foreign.part])
    assert store.get(key) == foreign.chunks[key] == bytes.fromhex(want)
