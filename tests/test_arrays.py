"""Arrays, stores and hierarchies from the driver."""

import base64
import json
import os
import threading
import warnings
from functools import partial
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest

import chunkframe as cf
from chunkframe import errors
from chunkframe.metadata import METADATA_KEY
from chunkframe.stores import Store
from chunkframe.stores.base import relative


class Counting(Store):
    """Counts what is read of another store."""

    def __init__(self, inner):
        self.inner, self.gets, self.parts = inner, [], []

    def get(self, key):
        self.gets.append(key)
        return self.inner.get(key)

    def get_partial(self, key, offset, length):
        self.parts.append((key, offset, length))
        return self.inner.get_partial(key, offset, length)

    def get_suffix(self, key, length):
        self.parts.append((key, -length, length))
        return self.inner.get_suffix(key, length)

    def exists(self, key):
        return self.inner.exists(key)

    def set(self, key, data):
        self.inner.set(key, data)

    def erase(self, key):
        self.inner.erase(key)

    def list(self, prefix=""):
        return self.inner.list(prefix)


@pytest.fixture(params=["local", "memory", "arrow"])
def store(request, tmp_path):
    return {"local": lambda: cf.LocalStore(tmp_path / "s"), "memory": cf.MemoryStore, "arrow": lambda: cf.ArrowStore(f"file://{tmp_path}/s")}[request.param]()


def test_round_trip_and_slices(store):
    a = cf.create(store, (10, 13), chunk_shape=(4, 5), codecs=[{"name": "gzip"}])
    x = np.arange(130.0).reshape(10, 13)
    a.write(x)
    b = cf.open(store)
    assert (b.read() == x).all() and (b.read((2, 3), (5, 8)) == x[2:7, 3:11]).all() and b.read((10, 13), (0, 0)).shape == (0, 0)
    assert (b[2:7, 3:11] == x[2:7, 3:11]).all() and (b[:] == x.reshape(-1, order="F")).all()


def test_fancy_and_masks(store):
    a = cf.create(store, (8, 8), "int32", chunk_shape=(3, 3))
    x = np.arange(64).reshape(8, 8)
    a.write(x)
    assert (a[[0, 4, 7], [1, 2]] == x[np.ix_([0, 4, 7], [1, 2])]).all()
    assert (a[[7, 0, 7], 2:4] == x[[7, 0, 7], 2:4]).all()
    mask = np.array([1, 0, 1, 0, 0, 0, 0, 1], bool)
    assert (a[mask, :] == x[mask]).all() and (a[::3, [1]] == x[::3, [1]]).all()
    a[[6, 1], [0, 7]] = np.array([[1, 2], [3, 4]])
    x[np.ix_([6, 1], [0, 7])] = [[1, 2], [3, 4]]
    a[[2, 2], 0:1] = np.array([[8], [9]])  # the last of repeated subscripts
    x[2, 0] = 9
    assert (a.read() == x).all()
    a[:, 3:5] = -1
    x[:, 3:5] = -1
    assert (a.read() == x).all()


@pytest.mark.parametrize("index", [(0,), (8, 0), (-1, 0), ([0.5], 0), (slice(3, 99), 0), (np.ones(3, bool), 0), ("a", 0)])
def test_bad_subscripts(index):
    with pytest.raises(errors.Indexing):
        cf.create(cf.MemoryStore(), (8, 8))[index]


def test_unsupported_indexing():
    a = cf.create(cf.MemoryStore(), (4,))
    with pytest.raises(errors.Indexing):
        del a[0]
    with pytest.raises(errors.Indexing):
        iter(a)
    with pytest.raises(errors.ShapeMismatch):
        a[0:2] = np.zeros(3)
    with pytest.raises(errors.ShapeMismatch):
        cf.create(cf.MemoryStore(), (4, 4)).write(np.zeros(3))
    with pytest.raises(errors.Indexing):
        a.write(np.zeros(3), [2])


def test_fill_and_read_modify_write(store):
    a = cf.create(store, (6, 6), path="a", chunk_shape=(3, 3), fill_value=float("nan"))
    a.write(np.ones((3, 3)))
    got = a.read()
    assert (got[:3, :3] == 1).all() and np.isnan(got[3:]).all() and np.isnan(got[:, 3:]).all()
    b = cf.create(store, (9, 9), path="b", chunk_shape=(4, 4))
    b[2:7, 2:7] = np.ones((5, 5))
    assert b.read().sum() == 25 and (b.read()[2:7, 2:7] == 1).all()


def test_ranks(store):
    a = cf.create(store, (7,), "int32", path="one", chunk_shape=3)
    a.write(np.arange(7))
    assert a[1:6].tolist() == [1, 2, 3, 4, 5] and len(a) == 7
    with pytest.warns(errors.ShapeFlattened):
        a.write(np.arange(6).reshape(2, 3))
    s = cf.create(store, (), path="zero")
    assert s[()] == 0
    s[()] = np.pi
    assert cf.open(store, "zero").read()[()] == np.pi and store.exists("zero/c")
    t = cf.create(store, (), "string", path="text")
    t[()] = "π"
    assert t[()] == "π"
    e = cf.create(store, (0, 3), path="empty")
    assert e.read().shape == (0, 3) and e.chunk_shape == (1, 3)


@pytest.mark.parametrize("dtype, values", [("bool", [True, False, True]), ("uint64", [0, 2**64 - 1, 2**60]), ("int64", [-(2**63), 2**63 - 1, 0]), ("complex64", [1 + 2j, -1j, 0]), ("float16", [0.5, -2, 65504]),
                                           ("string", ["", "日本", "x" * 300]), ("bytes", [b"", b"\0\xff", b"abc"]), ("datetime64[ns]", [0, -5, 2**62]), ("timedelta64[ms]", [1, 2, 3])])
def test_types(store, dtype, values):
    a = cf.create(store, (3,), dtype, chunk_shape=2, codecs=[{"name": "zstd"}])
    a.write(np.array(values, object if dtype in ("string", "bytes", "uint64") else None))
    assert cf.open(store).read().tolist() == values and cf.open(store).dtype == dtype.replace("bytes", "variable_length_bytes").replace("datetime", "numpy.datetime").replace("timedelta", "numpy.timedelta")


def test_order_f_and_shards(store):
    x = np.arange(120.0).reshape(12, 10)
    for path, options in {"f": {"order": "F"}, "end": {"shard_shape": (6, 10)}, "start": {"shard_shape": (6, 10), "index_location": "start"}}.items():
        a = cf.create(store, (12, 10), path=path, chunk_shape=(3, 5), codecs=[{"name": "gzip"}, {"name": "crc32c"}], **options)
        a.write(x)
        assert (cf.open(store, path).read() == x).all() and (a[4:8, 3:9] == x[4:8, 3:9]).all()
    with pytest.raises(errors.InvalidCodecs):
        cf.create(store, (2, 2), path="g", order="F", codecs=[{"name": "transpose", "configuration": {"order": [1, 0]}}])
    with pytest.raises(errors.InvalidChunkShape):
        cf.create(store, (8, 8), path="g", chunk_shape=(3, 3), shard_shape=(4, 4))
    with pytest.raises(errors.InvalidChunkShape):
        cf.create(store, (8,), path="g", chunk_shape=(0,))
    with pytest.raises(errors.ShapeMismatch):
        cf.create(store, (8,), path="g", chunk_shape=(2, 2))


def test_shard_ranges_are_read():
    inner = cf.MemoryStore()
    cf.create(inner, (8, 8), chunk_shape=(2, 2), shard_shape=(8, 8)).write(np.arange(64.0).reshape(8, 8))
    counting = Counting(inner)
    a = cf.open(counting)
    counting.gets.clear()
    assert (a[2:4, 4:6] == np.arange(64).reshape(8, 8)[2:4, 4:6]).all()
    assert counting.gets == [] and len(counting.parts) == 2  # the index and one inner chunk
    counting.parts.clear()
    assert a[[0, 7], [0, 7]].tolist() == [[0, 7], [56, 63]]  # the index and the four corners
    assert counting.gets == [] and len(counting.parts) == 5
    counting.parts.clear()
    assert (a[0:2, 0:8] == np.arange(64).reshape(8, 8)[0:2]).all() and len(counting.parts) == 2  # neighbours at once


def test_only_hit_chunks_are_read():
    inner = cf.MemoryStore()
    cf.create(inner, (100,), path="a", chunk_shape=10).write(np.arange(100.0))
    counting = Counting(inner)
    a = cf.open(counting, "a")
    counting.gets.clear()
    assert a[[5, 95]].tolist() == [5, 95] and counting.gets == ["a/c/0", "a/c/9"]
    counting.gets.clear()
    a[90:100] = np.zeros(10)  # a full chunk isn't read first
    assert counting.gets == []
    b = cf.create(counting, (5,), path="edge", chunk_shape=4)
    counting.gets.clear()
    b[4:5] = np.ones(1)  # neither is a chunk that overhangs the edge
    assert counting.gets == []


def test_elision(store):
    a = cf.create(store, (4, 4), "int32", path="a", chunk_shape=(2, 2))
    a.write(np.zeros((4, 4)))
    assert not [k for k in store.list() if k.startswith("a/c")]
    a[0:1, 0:1] = 5
    assert [k for k in store.list() if k.startswith("a/c")] == ["a/c/0/0"]
    a[0:1, 0:1] = 0
    assert not store.exists("a/c/0/0")
    b = cf.create(store, (2,), path="b", write_empty_chunks=True)
    b.write(np.zeros(2))
    assert store.exists("b/c/0")
    n = cf.create(store, (2,), path="n", fill_value=float("nan"))
    n.write(np.full(2, np.nan))
    assert not store.exists("n/c/0")
    z = cf.create(store, (2,), path="z")
    z.write(np.array([-0.0, 0.0]))  # negative zero isn't the fill value
    assert np.signbit(z.read()).tolist() == [True, False]


@pytest.mark.parametrize("shape", [(9000,), (1, 1, 9000), (3, 5000), (5000, 3)])
def test_elision_of_large_chunks(store, shape):
    """A first look at a part must not decide that a block is empty."""
    a = cf.create(store, shape, "int16", path="a")
    x = np.zeros(shape, "int16")
    a.write(x)
    assert not store.exists("a/" + a.meta.chunk_key((0,) * len(shape)))
    x[(-1,) * len(shape)] = 7
    a.write(x)
    assert (cf.open(store, "a").read() == x).all()


def test_resize_and_append(store):
    a = cf.create(store, (4, 4), path="a", chunk_shape=(2, 2))
    x = np.arange(1.0, 17).reshape(4, 4)
    a.write(x)
    a.resize((6, 4))
    assert (a.read()[:4] == x).all() and (a.read()[4:] == 0).all()
    a.resize((3, 2))
    assert (cf.open(store, "a").read() == x[:3, :2]).all() and not store.exists("a/c/0/1")
    a.resize((4, 4))
    want = np.zeros((4, 4))
    want[:3, :2] = x[:3, :2]
    assert (a.read() == want).all()  # cells that fell outside don't come back
    with pytest.raises(errors.ShapeMismatch):
        a.resize((4,))
    b = cf.create(store, (2, 3), path="b", chunk_shape=(2, 2))
    b.write(np.ones((2, 3)))
    b.append(np.full((2, 2), 2.0), 1)
    b.append(np.full((1, 5), 3.0))
    assert cf.open(store, "b").shape == (3, 5) and b.read().sum() == 6 + 8 + 15
    with pytest.raises(errors.ShapeMismatch):
        b.append(np.ones((2, 2)))
    assert cf.open(store, "b").shape == (3, 5)
    with pytest.raises(errors.ShapeMismatch):
        cf.create(store, (), path="s").append(np.float64(1))


def test_hierarchy(store):
    root = cf.create_group(store, attributes={"title": "t"})
    root.create_array("g/h/a", (3,), "int8", attributes={"units": "mm"}, dimension_names=["x"])
    assert store.exists(f"g/{METADATA_KEY}") and store.exists(f"g/h/{METADATA_KEY}")
    a = root["g/h/a"]
    assert a.attrs == {"units": "mm"} and a.dimension_names == ["x"]
    a.set_attr("scale", 1.5)
    assert cf.open(store, "g/h/a").attrs == {"units": "mm", "scale": 1.5}
    a.set_attrs({})
    assert cf.open(store, "g/h/a").attrs == {}
    root.create_group("e", {"k": 1})
    assert root.children() == ([], ["e", "g"]) and "e" in root and "nope" not in root
    with pytest.warns(UserWarning):
        assert cf.create_group(store, "e", {"k": 2}).attrs == {"k": 1}
    for error, call in [(errors.NodeExists, lambda: cf.create(store, (1,), path="e")), (errors.NodeExists, lambda: cf.create_group(store, "g/h/a")), (errors.NodeExists, lambda: cf.create(store, (1,), path="g/h/a/b")),
                        (errors.NodeNotFound, lambda: cf.open(store, "x")), (errors.NodeNotFound, lambda: cf.delete_node(store, "x")), (errors.InvalidPath, lambda: cf.open(store, "../x")), (errors.InvalidStore, lambda: cf.open(3))]:
        with pytest.raises(error):
            call()
    a.write(np.ones(3))
    cf.create(store, (2,), path="g/h/a", overwrite=True)
    assert cf.open(store, "g/h/a").read().tolist() == [0, 0]  # old chunks went with the old array
    assert [p for p, _, _ in root.walk()] == ["", "e", "g", "g/h", "g/h/a"] and [p for p, _, _ in root.walk(1)] == ["", "e", "g"]
    assert "a (2,) float64" in root.tree()
    cf.delete_node(store, "g")
    assert root.children() == ([], ["e"])
    cf.delete_node(store)
    assert store.list() == []


def test_consolidated():
    inner = cf.MemoryStore()
    root = cf.create_group(inner, attributes={"t": "root"})
    root.create_array("x", (4, 4))
    root.create_array("sub/y", (3,), "int32")
    cf.consolidate_metadata(inner)
    counting = Counting(inner)
    g = cf.open(counting)
    counting.gets.clear()
    assert g["x"].shape == (4, 4) and g["sub"]["y"].dtype == "int32" and g["sub/y"].shape == (3,)
    assert g.children() == (["x"], ["sub"]) and g["sub"].children() == (["y"], []) and counting.gets == []
    cf.create(inner, (1,), path="late")
    assert "late" not in g and g["late"].shape == (1,)  # item falls back, membership is a snapshot
    g.set_attr("a", 1)
    assert cf.open(inner).meta.consolidated is not None
    with pytest.raises(errors.InvalidMetadata):
        s = cf.MemoryStore()
        cf.create(s, (1,))
        cf.consolidate_metadata(s)


def test_local_store(tmp_path):
    s = cf.LocalStore(tmp_path / "x")
    assert s.get("a") is None and s.list() == [] and s.list_dir("a") == []
    s.set("a/b/c", b"0123456789")
    assert s.get_partial("a/b/c", 3, 4) == b"3456" and s.get_partial("a/b/c", 8, 9) == b"89" and s.get_suffix("a/b/c", 3) == b"789" and s.get_suffix("a/b/c", 99) == b"0123456789"
    assert s.get("a/b") is None and not s.exists("a/b") and s.list() == ["a/b/c"] and s.list_dir() == ["a"] and s.list("a/b") == ["a/b/c"]
    s.erase("a/b/c")
    s.erase("a/b/c")
    assert s.list() == []
    with pytest.raises(errors.StoreError):
        s.set("a", b"a folder is there")
    assert os.listdir(tmp_path / "x") == ["a"]


def test_arrow_store(tmp_path):
    import pickle

    s = pickle.loads(pickle.dumps(cf.ArrowStore(f"file://{tmp_path}/x")))
    assert s.get("a") is None and s.list() == [] and s.size("a") is None and not s.exists("a")
    s.set("a/b", b"0123456789")
    assert s.get_partial("a/b", 8, 9) == b"89" and s.get_partial("a/b", 20, 1) == b"" and s.get_suffix("a/b", 3) == b"789" and s.get_suffix("a/b", 99) == b"0123456789"
    assert s.list() == ["a/b"] == s.list("a") == s.list("a/b") and s.list_dir() == ["a"] and s.size("a/b") == 10 and s.get("a") is None
    s.erase("a/b")
    s.erase("a/b")
    assert s.list() == []


def test_zip_store(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    with cf.ZipStore("z.zip", "w") as z:
        cf.create_group(z, attributes={"k": 1})
        cf.create(z, (6, 8), path="d", chunk_shape=(3, 4), codecs=[{"name": "gzip"}]).write(np.arange(48.0).reshape(6, 8))
        assert cf.open(z, "d").read()[5, 7] == 47
    monkeypatch.chdir("/")
    r = cf.ZipStore(tmp_path / "z.zip")
    assert cf.open(r).attrs == {"k": 1} and (cf.open(r, "d").read() == np.arange(48).reshape(6, 8)).all()
    assert r.list("d/c") == [f"d/c/{i}/{j}" for i in range(2) for j in range(2)] and r.list_dir() == ["d", METADATA_KEY] and r.get_suffix(METADATA_KEY, 1) == b"}"
    for call in (lambda: r.set("a", b""), lambda: r.erase("d"), lambda: z.get("d"), lambda: cf.ZipStore(tmp_path / "none.zip")):
        with pytest.raises(errors.StoreError):
            call()
    bad = cf.ZipStore(tmp_path / "nowhere" / "z.zip", "w")
    bad.set("a", b"1")
    with pytest.raises(errors.StoreError):
        bad.close()
    bad._entries.clear()


class Quiet(SimpleHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def do_GET(self):
        if "secret" in self.path:
            return self.send_error(403)
        if "broken" in self.path:
            return self.send_error(500)
        return super().do_GET()


@pytest.fixture
def served(tmp_path):
    server = ThreadingHTTPServer(("127.0.0.1", 0), partial(Quiet, directory=tmp_path))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_http_store(tmp_path, served):
    local = cf.LocalStore(tmp_path)
    cf.create_group(local)
    cf.create(local, (10, 8), path="a b", chunk_shape=(5, 4), codecs=[{"name": "gzip"}]).write(np.arange(80.0).reshape(10, 8))
    cf.create(local, (8, 8), "int32", path="s", chunk_shape=(2, 2), shard_shape=(8, 8)).write(np.arange(64).reshape(8, 8))
    cf.consolidate_metadata(local)
    g = cf.open(served)
    assert g.children() == (["a b", "s"], []) and (g["a b"].read() == np.arange(80).reshape(10, 8)).all()
    assert (g["s"][2:4, 1:7] == np.arange(64).reshape(8, 8)[2:4, 1:7]).all()
    h = cf.HttpStore(served)
    whole = local.get("s/c/0/0")
    assert h.get_partial("s/c/0/0", 3, 5) == whole[3:8] and h.get_suffix("s/c/0/0", 7) == whole[-7:] and h.exists(METADATA_KEY) and not h.exists("nope")
    assert h.get("nope") is None and h.get("secret") is None
    for call in (lambda: h.get("broken"), lambda: h.set("a", b""), lambda: h.erase("a"), lambda: h.list(), lambda: h.list_dir()):
        with pytest.raises(errors.StoreError):
            call()


def test_manifest_store(tmp_path, served):
    x = np.arange(64).reshape(8, 8)
    for name, options in {"plain": {"chunk_shape": (4, 4)}, "shard": {"chunk_shape": (2, 2), "shard_shape": (4, 4)}}.items():
        source, index = cf.LocalStore(tmp_path / f"{name}-src"), cf.LocalStore(tmp_path / name)
        cf.create(source, (8, 8), "int32", path="a", **options).write(x)
        blob, chunks = bytearray(b"p" * 13), {}
        for n, key in enumerate(k for k in source.list() if "/c/" in k):
            data = source.get(key)
            chunks[key] = {"inline": base64.b64encode(data).decode()} if n == 0 else {"path": f"../{name}.bin", "offset": len(blob), "length": len(data)}
            blob += data if n else b""
        (tmp_path / f"{name}.bin").write_bytes(blob)
        index.set(f"a/{METADATA_KEY}", source.get(f"a/{METADATA_KEY}"))
        index.set("manifest.json", json.dumps({"manifest_format": 1, "chunks": chunks}).encode())
        for root in (str(tmp_path / name), f"{served}/{name}"):
            m = cf.ManifestStore(root)
            assert (cf.open(m, "a").read() == x).all() and (cf.open(m, "a")[1:7, 5:8] == x[1:7, 5:8]).all()
            key = sorted(chunks)[1]
            assert m.get_suffix(key, 5) == source.get(key)[-5:] and m.get_partial(key, 2, 10**6) == source.get(key)[2:] and m.exists(key)
            with pytest.raises(errors.StoreError):
                m.set("a", b"")
        assert "manifest.json" not in cf.ManifestStore(str(tmp_path / name)).list() and set(chunks) <= set(cf.ManifestStore(str(tmp_path / name)).list())
    with pytest.raises(errors.StoreError):
        cf.ManifestStore(str(tmp_path / "nowhere"))


def test_relative():
    assert relative("/a/b", "../c/./d") == "/a/c/d" and relative("http://h/x/y", "../z") == "http://h/x/z" and relative("/a", "/b") == "/b" and relative("/a", "http://h/b") == "http://h/b"
    for bad in (("/a", "../../b"), ("http://h/x", "../../b")):
        with pytest.raises(errors.InvalidPath):
            relative(*bad)


def test_closed_writer_warns(tmp_path):
    z = cf.ZipStore(tmp_path / "w.zip", "w")
    z.set("a", b"1")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        z.__del__()
    assert any(issubclass(w.category, ResourceWarning) for w in seen)
    z._entries.clear()


def test_error_identifiers():
    names = {"NodeNotFound", "NodeExists", "Indexing", "ShapeMismatch", "InvalidChunkShape", "InvalidCodecs", "InvalidMetadata", "InvalidFillValue", "InvalidPath", "InvalidStore", "UnsupportedFeature",
             "UnsupportedDataType", "UnsupportedCodec", "UnsupportedValue", "ValueError", "TypeMismatch", "CodecError", "ChecksumError", "MissingCodecLibrary", "StoreError", "InternalError"}
    assert names <= {e("x").identifier for e in vars(errors).values() if isinstance(e, type) and issubclass(e, errors.ChunkframeError)}


def test_erase_below(tmp_path):
    """In one call where the store has one; names that only begin alike stay."""
    for store in (cf.MemoryStore(), cf.LocalStore(tmp_path / "l"), cf.ArrowStore(f"file://{tmp_path}/w")):
        for key in ("a/zarr.json", "a/c/0/0", "a/b/zarr.json", "ab/zarr.json", "zarr.json"):
            store.set(key, b"{}")
        store.erase_below("a")
        assert store.list() == ["ab/zarr.json", "zarr.json"]
        store.erase_below("a")
        store.erase_below()
        assert store.list() == [] and store.list_dir() == []
        store.set("k", b"1")  # the store itself is still there
        assert store.list() == ["k"]


def test_consolidation_lists_no_chunk(tmp_path):
    class Listed(cf.LocalStore):
        folders = []

        def list(self, prefix=""):
            raise AssertionError("all keys are listed")

        def list_dir(self, prefix=""):
            self.folders.append(prefix)
            return super().list_dir(prefix)

    store = cf.LocalStore(tmp_path)
    cf.create_group(store)
    for path in ("a", "g/b", "g/h/c", "g-x"):
        cf.create(store, (8,), path=path, chunk_shape=(2,)).write(np.ones(8))
    cf.consolidate_metadata(Listed(tmp_path))
    assert sorted(cf.open(store).meta.consolidated) == ["a", "g", "g-x", "g/b", "g/h", "g/h/c"]
    assert sorted(Listed.folders) == ["", "g", "g/h"]


@pytest.mark.parametrize("dtype,fill,values", [
    ("float64", float("nan"), [1.0, float("nan"), -0.0]), ("float64", 0.0, [0.0, -0.0, 1.0]), ("float16", 2.0, [2.0, 1.0]), ("int64", -1, [-1, 2**62]), ("bool", True, [True, False]), ("string", "?", ["?", "", "x"]),
    ("bytes", b"", [b"", b"a"]), ("complex128", complex(0, float("nan")), [complex(0, float("nan")), 0j]), ("datetime64[s]", None, [np.datetime64("NaT"), np.datetime64(5, "s")]),
])
def test_fill_masks(dtype, fill, values):
    a = cf.create(cf.MemoryStore(), (len(values),), dtype, **({} if fill is None else {"fill_value": fill}))
    a.write(values)
    cells = a.read()
    kind = a.meta.dtype
    assert kind.fills(cells, a.meta.fill).tolist() == [kind.is_fill(cells[k : k + 1], a.meta.fill) for k in range(len(cells))]
