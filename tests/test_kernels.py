"""Codecs, types, grids and metadata, without Spark."""

import json
import math
import struct
import zlib
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkframe import errors
from chunkframe.codecs import Codec, Pipeline, build, register
from chunkframe.codecs.base import ByteCodec
from chunkframe.codecs.blosc import Blosc, _unblosclz
from chunkframe.codecs.compress import crc32c
from chunkframe.dtypes import NAT, parse, saturate
from chunkframe.grid import grid_shape, intersections, outside, region, visible
from chunkframe.metadata import _FORMAT_FIELD as FORMAT
from chunkframe.metadata import METADATA_KEY, ArrayMetadata, GroupMetadata, node_type, normal_path
from chunkframe.plans.pruning import Bounds, plan

PLAIN = ["bool", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float16", "float32", "float64", "complex64", "complex128"]


def chain(*entries, dtype="float64", shape=(3, 5), fill=None):
    kind = parse(dtype)
    return Pipeline([{"name": e} if isinstance(e, str) else {"name": e[0], "configuration": e[1]} for e in entries], kind, shape, kind.default_fill() if fill is None else fill)


# -- checksums and compressors ---------------------------------------------------
@pytest.mark.parametrize("data, want", [(b"123456789", 0xE3069283), (b"", 0), (b"\0" * 32, 0x8A9136AA), (b"\xff" * 32, 0x62A8AB43)])
def test_crc32c_known_answers(data, want):
    assert crc32c(data) == want


def _slow_crc(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000))
def test_crc32c_equals_bitwise(data):
    assert crc32c(data) == _slow_crc(data)


CODECS = [("gzip", {"level": 0}), ("gzip", {"level": 9}), ("numcodecs.zlib", {"level": 5}), ("zstd", {}), ("zstd", {"level": 19, "checksum": True}), ("crc32c", {}), ("numcodecs.shuffle", {"elementsize": 4})] + [
    ("blosc", {"cname": c, "clevel": 5, "shuffle": s, "typesize": 4}) for c in ("lz4", "lz4hc", "blosclz", "zstd", "snappy", "zlib") for s in ("noshuffle", "shuffle", "bitshuffle")
]


@pytest.mark.parametrize("name, config", CODECS)
def test_byte_codecs_round_trip(name, config):
    c = build({"name": name, "configuration": config})
    rng = np.random.default_rng(1)
    for data in (b"", b"x", bytes(range(256)) * 40, rng.bytes(10_007), np.arange(200_000, dtype="<i4").tobytes()):
        assert bytes(c.decode(c.encode(data))) == data
    assert build(c.json).json == c.json


@pytest.mark.parametrize("name", ["gzip", "numcodecs.zlib", "zstd", "blosc"])
def test_corrupt_input(name):
    c = build({"name": name, "configuration": {"typesize": 1} if name == "blosc" else {}})
    data = bytearray(c.encode(bytes(range(256)) * 64))
    for broken in (bytes(data[: len(data) // 2]), b"nonsense" * 8, bytes(data) + b"more" if name in ("gzip", "blosc") else b"\0"):
        with pytest.raises(errors.CodecError):
            c.decode(broken)


def test_gzip_header_is_fixed_and_foreign_headers_are_read():
    data = build({"name": "gzip"}).encode(b"hello")
    assert data[:2] == b"\x1f\x8b" and data[4:8] == b"\0\0\0\0" and data[9] == 255
    raw = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = raw.compress(b"hello") + raw.flush()
    named = b"\x1f\x8b\x08" + bytes([4 | 8 | 16]) + b"\0" * 4 + b"\0\3" + struct.pack("<H", 3) + b"abc" + b"name\0" + b"note\0" + body + struct.pack("<II", zlib.crc32(b"hello"), 5)
    assert build({"name": "gzip"}).decode(named) == b"hello"
    with pytest.raises(errors.CodecError):
        build({"name": "gzip"}).decode(data[:-8] + b"\0" * 8)


def test_checksum_errors():
    c = build({"name": "crc32c"})
    with pytest.raises(errors.ChecksumError):
        c.decode(c.encode(b"abc")[:-1] + b"\0")
    with pytest.raises(errors.CodecError):
        c.decode(b"abc")


def test_blosc_frames():
    c = Blosc("zstd", 5, "shuffle", 8)
    frame = c.encode(np.arange(5000.0).tobytes())
    assert frame[:2] == b"\x02\x01" and frame[3] == 8 and struct.unpack("<III", frame[4:16])[0::2] == (40000, len(frame))
    with pytest.raises(errors.InvalidCodecs):
        Blosc().encode(b"x")
    # literals "abcdefgh", then a reference of 12 bytes at distance 8, then "Z"
    assert _unblosclz(bytes([7]) + b"abcdefgh" + bytes([7 << 5, 12 - 3 - 6, 7]) + bytes([0]) + b"Z", 21) == b"abcdefghabcdefghabcdZ"
    # a frame whose blocks are split by byte (no single-stream flag)
    raw = np.arange(256, dtype="<u2").tobytes()
    planes = np.frombuffer(raw, np.uint8).reshape(-1, 2).T
    streams = b"".join(struct.pack("<i", 256) + p.tobytes() for p in planes)
    split = struct.pack("<BBBBIIIi", 2, 1, 1 | 3 << 5, 2, 512, 512, 20 + len(streams), 20) + streams
    assert Blosc("zlib", 5, "shuffle", 2).decode(split) == raw


@pytest.mark.parametrize("bad", [("gzip", {"level": 10}), ("zstd", {"level": 23}), ("blosc", {"cname": "nope"}), ("numcodecs.shuffle", {"elementsize": 0}), ("bytes", {"endian": "middle"})])
def test_bad_parameters(bad):
    with pytest.raises(errors.InvalidCodecs):
        build({"name": bad[0], "configuration": bad[1]})


def test_registry():
    with pytest.raises(errors.UnsupportedCodec):
        build({"name": "unknown"})
    for bad in ("gzip", {}, {"name": 3}, {"name": "gzip", "configuration": {"what": 1}}):
        with pytest.raises(errors.InvalidMetadata):
            build(bad)

    @register
    class Flip(ByteCodec):
        name = "test-flip"
        encode = decode = lambda self, data: bytes(255 - b for b in data)

    p = chain("bytes", "test-flip")
    block = np.arange(15.0).reshape(3, 5)
    assert (p.decode(p.encode(block)) == block).all() and isinstance(p.codecs[1], Codec)


# -- chains ------------------------------------------------------------------------
@pytest.mark.parametrize("dtype, endian", list(product(PLAIN, ["little", "big"])))
def test_types_and_endians(dtype, endian):
    kind = parse(dtype)
    block = (np.arange(15).reshape(3, 5) % (2 if dtype == "bool" else 100)).astype(kind.numpy)
    if kind.kind == "complex":
        block = block + 1j * block
    p = chain(("bytes", {"endian": endian}), dtype=dtype)
    data = p.encode(block)
    assert data == block.astype(kind.numpy.newbyteorder("<" if endian == "little" else ">")).tobytes()
    assert (p.decode(data) == block).all()


def test_bool_bytes_other_than_one_are_true():
    assert chain("bytes", dtype="bool", shape=(3,)).decode(b"\x00\x02\xff").tolist() == [False, True, True]


def test_transpose():
    block = np.arange(24.0).reshape(2, 3, 4)
    p = chain(("transpose", {"order": [2, 0, 1]}), "bytes", shape=(2, 3, 4))
    assert p.encode(block) == block.transpose(2, 0, 1).tobytes() and (p.decode(p.encode(block)) == block).all()
    with pytest.raises(errors.CodecError):
        chain(("transpose", {"order": [0, 0, 1]}), "bytes", shape=(2, 3, 4))


@pytest.mark.parametrize("entries", [["gzip"], ["bytes", "bytes"], ["gzip", "bytes"], ["bytes", ("transpose", {"order": [1, 0]})]])
def test_chain_rules(entries):
    with pytest.raises(errors.InvalidCodecs):
        chain(*entries)


def test_wrong_sizes():
    with pytest.raises(errors.CodecError):
        chain("bytes").decode(b"123")
    with pytest.raises(errors.InvalidCodecs):
        chain("bytes", dtype="string")


def test_vlen_framing():
    p = chain("vlen-utf8", dtype="string", shape=(3,))
    data = p.encode(np.array(["", "é", "日本"], object))
    assert data == struct.pack("<I", 3) + struct.pack("<I", 0) + struct.pack("<I", 2) + "é".encode() + struct.pack("<I", 6) + "日本".encode()
    assert p.decode(data).tolist() == ["", "é", "日本"]
    for bad in (data[:-1], data[:3], struct.pack("<I", 4) + data[4:]):
        with pytest.raises(errors.CodecError):
            p.decode(bad)
    b = chain("vlen-bytes", "gzip", dtype="bytes", shape=(2, 2))
    cells = np.array([b"\1\2", b"", b"\xff", b"\0"], object).reshape(2, 2)
    assert (b.decode(b.encode(cells)) == cells).all()


@pytest.mark.parametrize("where", ["start", "end"])
def test_shard_layout(where):
    inner = [{"name": "bytes"}, {"name": "gzip"}, {"name": "crc32c"}]
    p = chain(("sharding_indexed", {"chunk_shape": [3, 5], "codecs": inner, "index_location": where}), shape=(6, 10))
    block = np.zeros((6, 10))
    block[3:, 5:] = 7
    data = p.encode(block)
    index = p.codecs[0].index(data[:68] if where == "start" else data[-68:])
    assert index.shape == (2, 2, 2) and (index.reshape(-1)[:6] == 2**64 - 1).all()
    assert int(index[1, 1, 0]) == (68 if where == "start" else 0) and int(index[1, 1].sum()) == len(data) - (0 if where == "start" else 68)
    assert (p.decode(data) == block).all()
    with pytest.raises(errors.CodecError):
        p.decode(data[:50])
    flipped = bytearray(data)
    flipped[3 if where == "start" else -3] ^= 1
    with pytest.raises(errors.ChecksumError):
        p.decode(bytes(flipped))


def test_shard_rules():
    with pytest.raises(errors.InvalidMetadata):
        chain(("sharding_indexed", {"chunk_shape": [2, 2]}), shape=(5, 4))
    with pytest.raises(errors.InvalidMetadata):
        chain(("sharding_indexed", {"chunk_shape": []}), shape=())
    for other in ({"name": "gzip"}, {"name": "transpose", "configuration": {"order": [2, 1, 0]}}):
        with pytest.raises(errors.UnsupportedCodec):
            chain(("sharding_indexed", {"chunk_shape": [1, 1], "index_codecs": [other, {"name": "bytes"}] if other["name"] == "transpose" else [{"name": "bytes"}, other]}), shape=(2, 2))


# -- types ---------------------------------------------------------------------------
def test_half_floats():
    bits = np.arange(65536, dtype="<u2")
    p = chain("bytes", dtype="float16", shape=(65536,))
    assert p.encode(p.decode(bits.tobytes())) == bits.tobytes()
    assert parse("float16").coerce(np.array([2049.0, 2051.0, 65520.0])).view("u2").tolist() == [0x6800, 0x6802, 0x7C00]


@pytest.mark.parametrize("dtype, fill", [("float64", math.nan), ("float64", math.inf), ("float32", -math.inf), ("float64", -0.0), ("float64", 0.1), ("int64", -(2**53) - 3), ("uint64", 2**60), ("uint64", 2**64 - 1), ("complex128", complex(math.nan, -math.inf)), ("bool", True), ("string", "é?"), ("bytes", b"\0\xff")])
def test_fill_values_survive(dtype, fill):
    kind = parse(dtype)
    text = json.dumps(kind.encode_fill(kind.numpy.type(fill) if not kind.variable else fill))
    back = kind.decode_fill(json.loads(text))
    assert kind.encode_fill(back) == kind.encode_fill(kind.numpy.type(fill) if not kind.variable else fill)
    if fill == 0 and dtype == "float64":
        assert math.copysign(1, back) == -1


def test_fill_forms():
    f8 = parse("float64")
    assert np.isnan(f8.decode_fill("0x7ff8000000000001")) and f8.encode_fill(f8.decode_fill("0x7ff8000000000001")) == "0x7ff8000000000001"
    assert f8.decode_fill("0x3ff0000000000000") == 1.0
    assert parse("int64").decode_fill(3.0) == 3 and parse("int64").decode_fill(1e16) == 10**16 and parse("int32").decode_fill(None) == 0
    assert parse("int64").decode_fill(2**53 + 3) == 2**53 + 3
    assert parse("datetime64[s]").default_fill() == NAT and parse("datetime64[s]").encode_fill(NAT) == "NaT" and parse("datetime64[s]").decode_fill("NaT") == NAT
    for dtype, bad in (("float64", "0x12"), ("float64", "nan?"), ("int8", 300), ("uint8", -1), ("complex64", 3), ("bytes", "***")):
        with pytest.raises(errors.InvalidFillValue):
            parse(dtype).decode_fill(bad)


RECORD = {"name": "structured", "configuration": {"fields": [["a", "int32"], ["b", "float64"], ["c", {"name": "fixed_length_utf32", "configuration": {"length_bytes": 32}}]]}}


def test_records():
    kind = parse(RECORD)
    assert kind.itemsize == 44 and [kind.numpy.fields[n][1] for n in "abc"] == [0, 4, 12] and parse(kind.json) == kind
    cells = kind.coerce(np.array([{"a": 1, "b": 2.5, "c": "é"}, {"a": -7, "b": -0.0, "c": ""}], object))
    for endian in ("little", "big"):
        p = chain(("bytes", {"endian": endian}), "gzip", dtype=RECORD, shape=(2,))
        assert (p.decode(p.encode(cells)) == cells).all()
    fill = kind.encode_fill(cells[0])
    assert kind.decode_fill(fill) == cells[0]
    nested = parse({"name": "structured", "configuration": {"fields": [["point", {"name": "structured", "configuration": {"fields": [["x", "int16"], ["y", "int16"]]}}], ["label", {"name": "fixed_length_utf32", "configuration": {"length_bytes": 8}}]]}})
    assert nested.itemsize == 12
    with pytest.raises(errors.CellValueError):
        kind.coerce(np.array([{"a": 1, "b": 2, "c": "too long a string"}], object))
    with pytest.raises(errors.TypeMismatch):
        kind.coerce(np.array([1, 2], object))


def test_unknown_types():
    for name in ("float128", "r16", "decimal"):
        with pytest.raises(errors.UnsupportedDataType):
            parse(name)
    with pytest.raises(errors.TypeMismatch):
        parse("bytes").coerce(["text"])
    with pytest.raises(errors.TypeMismatch):
        parse("int32").coerce(np.array(["1"]))


@settings(max_examples=200, deadline=None)
@given(st.floats(allow_nan=True, allow_infinity=True), st.sampled_from(["i1", "i2", "i4", "i8", "u1", "u2", "u4", "u8"]))
def test_saturating_casts(x, to):
    info = np.iinfo(to)
    if math.isnan(x):
        want = 0
    elif math.isinf(x):
        want = info.max if x > 0 else info.min
    else:
        whole = math.trunc(x)
        half = abs(x - whole) >= 0.5
        want = max(info.min, min(info.max, whole + (half and (1 if x > 0 else -1))))
    assert int(saturate(np.array([x]), np.dtype(to))[0]) == want


@given(st.integers(-(2**63), 2**63 - 1), st.sampled_from(["i1", "u4", "u8", "i8"]))
def test_integer_casts_saturate(x, to):
    info = np.iinfo(to)
    assert int(saturate(np.array([x]), np.dtype(to))[0]) == max(info.min, min(info.max, x))


# -- grids -----------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(25))
def test_intersections_cover_exactly_once(seed):
    rng = np.random.default_rng(seed)
    rank = int(rng.integers(1, 4))
    shape, chunk = rng.integers(2, 11, rank), rng.integers(1, 6, rank)
    start = [int(rng.integers(0, n)) for n in shape]
    count = [int(rng.integers(0, n - s + 1)) for n, s in zip(shape, start)]
    seen = np.zeros(count, int)
    for p in intersections(start, count, chunk):
        seen[p.in_out] += 1
        for k, c, lo, n, o, s in zip(p.coords, chunk, p.lo, p.n, p.out, start):
            assert 0 <= lo < c and lo + n <= c and k * c + lo == s + o
    assert (seen == 1).all()


def test_regions():
    assert region((4, 5)) == ((0, 0), (4, 5)) and region((4, 5), (1, 2), (None, 0)) == ((1, 2), (3, 0)) and region(()) == ((), ())
    for start, count in [((0,), (1,)), ((0, 0), (5, 1)), ((-1, 0), (1, 1)), ((0, 6), (1, 0)), ((0.5, 0), (1, 1))]:
        with pytest.raises(errors.Indexing):
            region((4, 5), start, count)
    assert len(list(intersections((), (), ()))) == 1 and grid_shape((5, 0), (2, 3)) == (3, 0)
    assert visible((2, 0), (5, 3), (2, 2)) == (1, 2) and outside((1, 0), (2, 0), (2, 2)) and not outside((0, 0), (2, 0), (2, 2))


def test_pruning():
    b = Bounds.of((0, 0), (100, 100))
    b.narrow(0, ">=", 17)
    b.narrow(0, "<", 23)
    b.narrow(1, "in", [5, 95, 95, 200])
    chunks = [c for r in plan(b, (10, 10), 800) for c in r]
    assert chunks == [(1, 0), (1, 9), (2, 0), (2, 9)]
    b.narrow(0, "=", 5)
    assert not plan(b, (10, 10), 800)
    many = plan(Bounds.of((0,), (10**9,)), (10,), 80)
    assert sum(r.last - r.first for r in many) == 10**8 and len(many) < 1000
    assert next(iter(many[1]))[0] == many[1].first


# -- documents -------------------------------------------------------------------------
DOC = {FORMAT: 3, "node_type": "array", "shape": [4], "data_type": "int64", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [2]}},
       "chunk_key_encoding": {"name": "default"}, "fill_value": 0, "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}]}


def test_array_documents():
    meta = ArrayMetadata.from_json(json.dumps(DOC | {"fill_value": 2**53 + 3, "attributes": {"fill_value": 1, "a b": [1]}, "dimension_names": [None], "unknown": {"x": 1}}))
    assert int(meta.fill) == 2**53 + 3 and meta.attributes == {"fill_value": 1, "a b": [1]}
    again = json.loads(meta.to_json())
    assert again["shape"] == [4] and again["chunk_grid"]["configuration"]["chunk_shape"] == [2] and "dimension_names" not in again
    assert list(again)[:8] == [FORMAT, "node_type", "shape", "data_type", "chunk_grid", "chunk_key_encoding", "fill_value", "codecs"]


@pytest.mark.parametrize("change, error", [
    ({FORMAT: 2}, errors.InvalidMetadata), ({"storage_transformers": [{"name": "x"}]}, errors.UnsupportedFeature), ({"chunk_grid": {"name": "odd"}}, errors.UnsupportedFeature),
    ({"shape": [4, 4]}, errors.InvalidMetadata), ({"shape": [-1]}, errors.InvalidMetadata), ({"chunk_key_encoding": {"name": "zigzag"}}, errors.InvalidMetadata), ({"node_type": "table"}, errors.InvalidMetadata),
    ({"data_type": "float13"}, errors.UnsupportedDataType), ({"codecs": [{"name": "nope"}]}, errors.UnsupportedCodec), ({"codecs": ["bytes"]}, errors.InvalidMetadata), ({"dimension_names": ["a", "b"]}, errors.InvalidMetadata),
])
def test_bad_documents(change, error):
    with pytest.raises(error):
        ArrayMetadata.from_json(json.dumps(DOC | change))
    with pytest.raises(errors.InvalidMetadata):
        node_type("{")


def test_chunk_keys():
    def keys(shape, encoding, separator):
        doc = DOC | {"shape": shape, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [1] * len(shape)}}, "chunk_key_encoding": {"name": encoding, "configuration": {"separator": separator}}}
        return ArrayMetadata.from_json(json.dumps(doc))

    for shape, encoding, separator, coords, key in [([4, 4], "default", "/", (1, 0), "c/1/0"), ([4, 4], "default", ".", (1, 0), "c.1.0"), ([4, 4], "v2", ".", (1, 0), "1.0"), ([], "default", "/", (), "c"), ([], "v2", ".", (), "0")]:
        m = keys(shape, encoding, separator)
        assert m.chunk_key(coords) == key and m.chunk_coords(key) == coords
    m = keys([4, 4], "default", "/")
    assert all(m.chunk_coords(k) is None for k in (METADATA_KEY, "c/1", "c/1/0/2", "c/-1/0", "c/01/0", "d/1/0"))


def test_group_documents():
    g = GroupMetadata({"b": 1}, {"x/y": {"a": 1}, "x": {"b": 2}})
    doc = json.loads(g.to_json())
    assert doc["consolidated_metadata"] == {"kind": "inline", "must_understand": False, "metadata": {"x": {"b": 2}, "x/y": {"a": 1}}}
    assert GroupMetadata.from_json(g.to_json()) == g and g.below("x") == {"y": {"a": 1}} and g.below("z") is None
    assert normal_path("/a//b/") == "a/b"
    for bad in ("a/../b", "./a"):
        with pytest.raises(errors.InvalidPath):
            normal_path(bad)
