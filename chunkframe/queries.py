"""The registered queries of the array engine.

Each writes columns of the tables into a fresh array store and reads them back through
the operator in its name, so agreement with SQL on the tables proves write, codec and
read together.
"""

from __future__ import annotations

import base64
import json
import threading
from functools import cache, partial
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import catalog
from .errors import ChunkframeError
from .functions.cells import chunk_columns, chunk_coords, chunk_key, saturating_cast
from .functions.session import shared_folder
from .operators.array import Array
from .stores import ArrowStore, LocalStore, ManifestStore, MemoryStore, Store, ZipStore, resolve

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def enter(f):
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return enter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _store(spark: SparkSession) -> Store:
    return resolve(shared_folder(spark, "store"))


def _length(df: DataFrame, key: str) -> int:
    return (df.agg(F.max(key)).first()[0] if df.columns else 0) + 1


def vector(spark, sf_dir, table: str, key: str, value, dtype="float64", chunk: int = 1024, path: str = "a", store=None, **options) -> Array:
    """A rank-1 array of a column over a dense key."""
    df = _table(spark, sf_dir, table)
    value = F.col(value) if isinstance(value, str) else value
    array = catalog.create(store or _store(spark), [_length(df, key)], dtype, path=path, chunk_shape=[chunk], **options)
    array.write_df(df.select(F.col(key).alias("i0"), value.alias("value")))
    return array


def embeddings(spark, sf_dir, chunk=(100, 24), dtype="float32", **options) -> Array:
    """The embeddings as a matrix."""
    df = _table(spark, sf_dir, "embeddings")
    array = catalog.create(_store(spark), [_length(df, "vec_id"), 64], dtype, path="embeddings", chunk_shape=list(chunk), **options)
    cells = df.select(F.col("vec_id").alias("i0"), F.posexplode("embedding").alias("i1", "value"))
    array.write_df(cells.select("i0", F.col("i1").cast("bigint").alias("i1"), "value"))
    return array


_E = "(SELECT vec_id AS i0, CAST(j AS BIGINT) AS i1, CAST(embedding[j + 1] AS DOUBLE) AS value FROM embeddings, range(64) t(j))"
_double = lambda df: df.withColumn("value", F.col("value").cast("double"))


# -- reads -------------------------------------------------------------------
@_query("SELECT event_id AS i0, value FROM events")
def scan_full_f64(spark, sf_dir):
    return vector(spark, sf_dir, "events", "event_id", "value").cells(spark)


@_query("SELECT event_id AS i0, value FROM events WHERE event_id >= 100 AND event_id < 900")
def slice_contiguous(spark, sf_dir):
    return vector(spark, sf_dir, "events", "event_id", "value").cells(spark).where("i0 >= 100 AND i0 < 900")


@_query("SELECT event_id AS i0, value FROM events WHERE event_id BETWEEN 50 AND 749")
def region_read(spark, sf_dir):
    return vector(spark, sf_dir, "events", "event_id", "value").cells(spark, [50], [700])


@_query(f"SELECT * FROM {_E} WHERE i0 >= 37 AND i0 < 310 AND i1 BETWEEN 10 AND 30")
def slice_2d(spark, sf_dir):
    return _double(embeddings(spark, sf_dir).cells(spark).where("i0 >= 37 AND i0 < 310 AND i1 BETWEEN 10 AND 30"))


@_query(f"""SELECT CAST(a.o AS BIGINT) AS o0, CAST(b.o AS BIGINT) AS o1, e.i0, e.i1, e.value FROM {_E} e
JOIN (VALUES (0, 250), (1, 3), (2, 250), (3, 17)) a(o, i) ON a.i = e.i0 JOIN (VALUES (0, 63), (1, 0), (2, 5)) b(o, i) ON b.i = e.i1""")
def fancy_outer(spark, sf_dir):
    return _double(embeddings(spark, sf_dir).select(spark, ([250, 3, 250, 17], [63, 0, 5])))


@_query(f"SELECT i0 // 3 AS o0, i1 AS o1, i0, i1, value FROM {_E} WHERE i0 % 3 = 0 AND i1 < 2")
def mask_index(spark, sf_dir):
    array = embeddings(spark, sf_dir)
    import numpy as np

    return _double(array.select(spark, (np.arange(array.shape[0]) % 3 == 0, slice(0, 2))))


@_query(f"SELECT i0 + (SELECT max(vec_id) + 1 FROM embeddings) * i1 AS lin, value FROM {_E}")
def flatten_f_order(spark, sf_dir):
    return _double(embeddings(spark, sf_dir).flat(spark, "F"))


@_query("SELECT d.doc_id AS i0, coalesce(l.quality, -1) AS value FROM documents d LEFT JOIN labels l USING (doc_id)")
def missing_chunk_fill(spark, sf_dir):
    n = _length(_table(spark, sf_dir, "documents"), "doc_id")
    array = catalog.create(_store(spark), [n], "int32", chunk_shape=[8], fill_value=-1)
    array.write_df(_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("i0"), F.col("quality").alias("value")))
    return array.cells(spark)


@_query("SELECT doc_id AS i0, quality AS value FROM labels")
def stored_cells_only(spark, sf_dir):
    n = _length(_table(spark, sf_dir, "documents"), "doc_id")
    array = catalog.create(_store(spark), [n], "int32", chunk_shape=[8], fill_value=-1)
    array.write_df(_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("i0"), F.col("quality").alias("value")))
    return array.cells(spark, emit_fill=False, null_fill=True).where("value is not null")


@_query("SELECT sum(l_quantity) AS value FROM lineitem")
def scalar_rank0(spark, sf_dir):
    array = catalog.create(_store(spark), [], "float64")
    array.write_df(_table(spark, sf_dir, "lineitem").agg(F.sum("l_quantity").alias("value")))
    return array.cells(spark)


@_query(f"SELECT (i0 // 100) * 3 + i1 // 24 AS block, count(*) AS cells FROM {_E} GROUP BY 1")
def block_scan(spark, sf_dir):
    df = embeddings(spark, sf_dir).blocks(spark)
    return df.select((F.col("chunk")[0] * 3 + F.col("chunk")[1]).alias("block"), (F.length("data") / 4).cast("bigint").alias("cells"))


@_query("SELECT event_id // 1024 AS chunk, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS greatest FROM events GROUP BY 1")
def chunk_statistics(spark, sf_dir):
    df = vector(spark, sf_dir, "events", "event_id", "value").statistics(spark)
    return df.select(F.col("chunk")[0].alias("chunk"), "n", F.round("total", 4).alias("total"), "least", "greatest")


# -- writes ------------------------------------------------------------------
@_query("SELECT CAST(j AS BIGINT) AS i0, CAST(j * j AS DOUBLE) AS value FROM range(5000) t(j)")
def map_blocks(spark, sf_dir):
    import numpy as np

    array = catalog.create(_store(spark), [5000], "float64", chunk_shape=[512], codecs=[_entry("zstd")])
    array.map_blocks(spark, lambda start, extent: np.arange(start[0], start[0] + extent[0], dtype=float) ** 2)
    return array.cells(spark)


@_query("SELECT event_id AS i0, CASE WHEN event_id BETWEEN 300 AND 899 THEN -value ELSE value END AS value FROM events")
def rmw_update(spark, sf_dir):
    array = vector(spark, sf_dir, "events", "event_id", "value")
    part = _table(spark, sf_dir, "events").where("event_id BETWEEN 300 AND 899")
    array.write_df(part.select(F.col("event_id").alias("i0"), (-F.col("value")).alias("value")))
    return array.cells(spark)


@_query("SELECT event_id AS i0, CASE WHEN event_id % 7 = 0 THEN 0.5 ELSE value END AS value FROM events")
def scattered_assign(spark, sf_dir):
    array = vector(spark, sf_dir, "events", "event_id", "value")
    array.write_df(_table(spark, sf_dir, "events").where("event_id % 7 = 0").select(F.col("event_id").alias("i0"), F.lit(0.5).alias("value")))
    return array.cells(spark)


@_query("SELECT event_id AS i0, CASE WHEN event_id BETWEEN 10 AND 909 THEN 7 ELSE value END AS value FROM events")
def broadcast_assign(spark, sf_dir):
    array = vector(spark, sf_dir, "events", "event_id", "value")
    array.fill(spark, 7.0, [10], [900])
    return array.cells(spark)


@_query("SELECT user_id AS i0, max(event_id) AS value FROM events GROUP BY user_id")
def last_write_wins(spark, sf_dir):
    df = _table(spark, sf_dir, "events")
    array = catalog.create(_store(spark), [_length(df, "user_id")], "int64", chunk_shape=[128], fill_value=-1)
    array.write_df(df.select(F.col("user_id").alias("i0"), F.col("event_id").alias("value"), "event_id"), order_by="event_id")
    return array.cells(spark).where("value >= 0")


@_query("SELECT event_id AS i0, value FROM events")
def sink_source_round_trip(spark, sf_dir):
    df = _table(spark, sf_dir, "events")
    array = catalog.create(_store(spark), [_length(df, "event_id")], "float64", path="a", chunk_shape=[1024])
    source = array.cells(spark)
    cells = array.by_chunk(df.select(F.col("event_id").alias("i0"), "value"))
    cells.write.format("chunkframe").mode("append").option("node", "a").save(array.store.root)
    return source


@_query("SELECT event_id AS i0, value FROM events")
def append_rows(spark, sf_dir):
    df = _table(spark, sf_dir, "events").select(F.col("event_id").alias("i0"), "value")
    n = _length(df, "i0")
    half = n // 2
    array = catalog.create(_store(spark), [half], "float64", chunk_shape=[700])
    array.write_df(df.where(F.col("i0") < half))
    array.append_df(df.where(F.col("i0") >= half).withColumn("i0", F.col("i0") - half), n - half)
    return array.cells(spark)


@_query("SELECT event_id AS i0, value FROM events WHERE event_id < 500")
def resize_shrink(spark, sf_dir):
    array = vector(spark, sf_dir, "events", "event_id", "value", chunk=300)
    array.resize([500])
    return array.cells(spark)


@_query("SELECT event_id AS i0, value FROM events WHERE event_id < 500 UNION ALL SELECT CAST(j AS BIGINT), CAST(-1 AS DOUBLE) FROM range(500, 800) t(j)")
def resize_grow(spark, sf_dir):
    array = vector(spark, sf_dir, "events", "event_id", "value", chunk=300, fill_value=-1.0)
    array.resize([500], spark)
    array.resize([800])
    return array.cells(spark)


@_query("SELECT p_partkey AS i0, CAST(greatest(-128, least(127, round(p_retailprice - 1000))) AS INTEGER) AS value FROM part")
def coerce_saturate(spark, sf_dir):
    array = vector(spark, sf_dir, "part", "p_partkey", F.col("p_retailprice") - 1000, dtype="int8")
    return array.cells(spark).withColumn("value", F.col("value").cast("int"))


@_query("SELECT p_partkey, CAST(greatest(-128, least(127, round(p_retailprice - 1000))) AS INTEGER) AS small, CAST(greatest(0, least(65535, round(p_retailprice * 50))) AS INTEGER) AS unsigned FROM part")
def saturating_cast_column(spark, sf_dir):
    x = F.col("p_retailprice")
    return _table(spark, sf_dir, "part").select("p_partkey", saturating_cast(x - 1000, "int8").cast("int").alias("small"), saturating_cast(x * 50, "uint16").alias("unsigned"))


@_query("SELECT i0 // 64 AS chunk, count(*) AS cells FROM (SELECT doc_id AS i0 FROM labels WHERE quality = 0) GROUP BY 1")
def empty_chunk_elision(spark, sf_dir):
    df = _table(spark, sf_dir, "labels")
    array = catalog.create(_store(spark), [_length(_table(spark, sf_dir, "documents"), "doc_id")], "int8", chunk_shape=[64], fill_value=1)
    array.write_df(df.select(F.col("doc_id").alias("i0"), F.col("quality").alias("value")))
    stored = array.chunks_df(spark).select(F.col("chunk")[0].alias("chunk"))  # chunks of ones aren't stored
    cells = array.cells(spark).where("value = 0").groupBy(chunk_columns(["i0"], [64])[0].alias("chunk")).agg(F.count("*").alias("cells"))
    return cells.join(stored, "chunk", "right")


# -- codecs ------------------------------------------------------------------
def _codec(name: str, entries: list, **options):
    @_query("SELECT o_orderkey AS i0, o_totalprice AS value FROM orders", f"codec_{name}")
    def run(spark, sf_dir):
        return vector(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", codecs=entries, chunk=4000, **options).cells(spark)


def _entry(name: str, **configuration) -> dict:
    return {"name": name, "configuration": configuration} if configuration else {"name": name}


_codec("big_endian", [_entry("bytes", endian="big")])
_codec("gzip", [_entry("gzip", level=1)])
_codec("zlib", [_entry("numcodecs.zlib", level=5)])
_codec("zstd", [_entry("zstd", level=3, checksum=True)])
_codec("crc32c", [_entry("gzip", level=1), _entry("crc32c")])
_codec("shuffle_zlib", [_entry("numcodecs.shuffle", elementsize=8), _entry("numcodecs.zlib", level=1)])
for _c, _s in (("lz4", "shuffle"), ("lz4hc", "shuffle"), ("zstd", "bitshuffle"), ("zlib", "shuffle"), ("snappy", "noshuffle"), ("blosclz", "noshuffle")):
    _codec(f"blosc_{_c}_{_s}", [_entry("blosc", cname=_c, clevel=5, shuffle=_s, typesize=0)])
_codec("v2_keys", [_entry("zstd")], chunk_key_encoding="v2")


@_query(f"SELECT * FROM {_E}")
def codec_transpose(spark, sf_dir):
    return _double(embeddings(spark, sf_dir, order="F", codecs=[_entry("zstd")]).cells(spark))


def _sharded(name: str, **options):
    @_query(f"SELECT * FROM {_E} WHERE i0 >= 120 AND i0 < 260 AND i1 >= 20 AND i1 < 40", name)
    def run(spark, sf_dir):
        return _double(embeddings(spark, sf_dir, **options).cells(spark).where("i0 >= 120 AND i0 < 260 AND i1 >= 20 AND i1 < 40"))


_sharded("shard_partial_end", chunk=(50, 16), shard_shape=(200, 64), codecs=[_entry("zstd")])
_sharded("shard_partial_start", chunk=(50, 16), shard_shape=(200, 64), index_location="start", codecs=[_entry("gzip", level=1), _entry("crc32c")])
_sharded("shard_nested", chunk=(200, 64), codecs=[_entry("sharding_indexed", chunk_shape=[100, 32], codecs=[_entry("sharding_indexed", chunk_shape=[50, 16], codecs=[_entry("bytes"), _entry("zstd")])])])


# -- types -------------------------------------------------------------------
def _dtype(name: str, spark_value: str, sql_value: str, back: str = "bigint", sql_back: str = "BIGINT", **options):
    @_query(f"SELECT p_partkey AS i0, CAST({sql_value} AS {sql_back}) AS value FROM part", f"dtype_{name}")
    def run(spark, sf_dir):
        array = vector(spark, sf_dir, "part", "p_partkey", F.expr(spark_value), dtype=name, codecs=[_entry("zstd")], **options)
        return array.cells(spark).withColumn("value", F.col("value").cast(back))


_dtype("bool", "p_size % 2 = 0", "p_size % 2 = 0", "boolean", "BOOLEAN")
for _b in (8, 16, 32, 64):
    _k = {8: "p_size - 25", 16: "p_size * 100 - 2500", 32: "p_size * 1000000 - 5", 64: "p_partkey * 1000000007 - 9"}[_b]
    _dtype(f"int{_b}", f"cast({_k} as bigint)", _k)
    _u = {8: "p_size * 5", 16: "p_size * 1300", 32: "CAST(p_size AS BIGINT) * 80000000", 64: "p_partkey * 1000000007"}[_b]
    _dtype(f"uint{_b}", f"cast({_u} as bigint)", _u)
_dtype("float16", "cast(p_size as float)", "p_size", "double", "DOUBLE")
_dtype("float32", "cast(p_size / 4 as float)", "CAST(p_size AS DOUBLE) / 4", "double", "DOUBLE")
_dtype("float64", "p_retailprice / 3", "p_retailprice / 3", "double", "DOUBLE")


def _complex(name: str, part: str):
    @_query("SELECT p_partkey AS i0, CAST(p_size AS DOUBLE) AS re, CAST(-p_size AS DOUBLE) / 2 AS im FROM part", f"dtype_{name}")
    def run(spark, sf_dir):
        value = F.expr(f"named_struct('re', cast(p_size as {part}), 'im', cast(-p_size / 2 as {part}))")
        df = vector(spark, sf_dir, "part", "p_partkey", value, dtype=name).cells(spark)
        return df.select("i0", F.col("value.re").cast("double").alias("re"), F.col("value.im").cast("double").alias("im"))


_complex("complex64", "float")
_complex("complex128", "double")


@_query("SELECT event_id AS i0, epoch_us(ts) AS value FROM events")
def datetime_ticks_us(spark, sf_dir):
    ticks = F.expr("unix_micros(cast(ts as timestamp))")
    return vector(spark, sf_dir, "events", "event_id", ticks, dtype="datetime64[us]").cells(spark)


@_query("SELECT doc_id AS i0, text AS value FROM documents")
def vlen_string(spark, sf_dir):
    return vector(spark, sf_dir, "documents", "doc_id", "text", dtype="string", chunk=100, codecs=[_entry("zstd")]).cells(spark)


@_query("SELECT page_id AS i0, md5(html) AS digest, CAST(strlen(html) AS BIGINT) AS n FROM pages")
def vlen_bytes(spark, sf_dir):
    df = vector(spark, sf_dir, "pages", "page_id", F.col("html").cast("binary"), dtype="bytes", chunk=50, codecs=[_entry("gzip", level=1)]).cells(spark)
    return df.select("i0", F.md5("value").alias("digest"), F.length("value").cast("bigint").alias("n"))


@_query("SELECT CAST(n_nationkey AS BIGINT) AS i0, n_name AS value FROM nation")
def fixed_utf32(spark, sf_dir):
    kind = {"name": "fixed_length_utf32", "configuration": {"length_bytes": 128}}
    return vector(spark, sf_dir, "nation", "n_nationkey", "n_name", dtype=kind, chunk=10).cells(spark)


_RECORD = T.StructType([T.StructField("nation", T.IntegerType()), T.StructField("balance", T.DoubleType()), T.StructField("segment", T.StringType())])


def _customers(spark, sf_dir):
    value = F.struct(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return vector(spark, sf_dir, "customer", "c_custkey", value, dtype=_RECORD, chunk=200, codecs=[_entry("zstd")])


@_query("SELECT c_custkey AS i0, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def structured_record(spark, sf_dir):
    return _customers(spark, sf_dir).cells(spark).select("i0", "value.*")


@_query("SELECT c_custkey AS i0, c_acctbal AS balance FROM customer")
def structured_field(spark, sf_dir):
    return _customers(spark, sf_dir).cells(spark, fields=["balance"]).select("i0", "value.balance")


# -- stores ------------------------------------------------------------------
def _zipped(store: Store) -> ZipStore:
    path = store.root + ".zip"
    with ZipStore(path, "w") as packed:
        for key in store.list():
            packed.set(key, store.get(key))
    return ZipStore(path)


def _manifest(store: Store) -> ManifestStore:
    """The chunks of a store in one file behind a manifest, every third one inline."""
    index, blob, entries = LocalStore(store.root + "-index"), bytearray(b"padding"), {}
    for n, key in enumerate(store.list()):
        data = store.get(key)
        if key.endswith(".json"):
            index.set(key, data)
        elif n % 3 == 0:
            entries[key] = {"inline": base64.b64encode(data).decode()}
        else:
            entries[key] = {"offset": len(blob), "length": len(data)}
            blob += data
    index.set("blob.bin", bytes(blob))
    index.set("manifest.json", json.dumps({"manifest_format": 1, "default_path": "blob.bin", "chunks": entries}).encode())
    return ManifestStore(index.root)


_ORDERS = "SELECT o_orderkey AS i0, o_totalprice AS value FROM orders"


@_query(_ORDERS)
def zip_scan(spark, sf_dir):
    array = vector(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", chunk=2000, codecs=[_entry("zstd")])
    return catalog.open(_zipped(array.store), "a").cells(spark)


@_query(_ORDERS)
def manifest_scan(spark, sf_dir):
    array = vector(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", chunk=2000, codecs=[_entry("gzip", level=1)])
    return catalog.open(_manifest(array.store), "a").cells(spark)


class _Ranges(SimpleHTTPRequestHandler):
    """Files, and byte ranges of them."""

    def log_message(self, *_):
        pass

    def do_GET(self):
        asked, path = self.headers.get("Range", ""), Path(self.translate_path(self.path))
        if not asked.startswith("bytes=") or not path.is_file():
            return super().do_GET()
        data = path.read_bytes()
        first, _, last = asked[6:].partition("-")
        start = int(first) if first else max(0, len(data) - int(last))
        part = data[start : int(last) + 1 if first and last else len(data)]
        if not part:
            return self.send_error(416)
        self.send_response(206)
        self.send_header("Content-Range", f"bytes {start}-{start + len(part) - 1}/{len(data)}")
        self.send_header("Content-Length", str(len(part)))
        self.end_headers()
        self.wfile.write(part)


@cache
def _server(folder: str) -> ThreadingHTTPServer:
    """One server for all stores below a folder, as long as the process lives."""
    server = ThreadingHTTPServer(("127.0.0.1", 0), partial(_Ranges, directory=folder))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def _served(store: Store) -> str:
    root = Path(store.root)
    return f"http://127.0.0.1:{_server(str(root.parent)).server_port}/{root.name}"


@_query(_ORDERS)
def http_scan(spark, sf_dir):
    """Over a server on the driver's loopback (local sessions only)."""
    array = vector(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", chunk=2000, codecs=[_entry("zstd")])
    return catalog.open(_served(array.store), "a").cells(spark)


def _shards_behind(name: str, behind):
    @_query(f"SELECT * FROM {_E} WHERE i0 >= 120 AND i0 < 260 AND i1 >= 20 AND i1 < 40", name)
    def run(spark, sf_dir):
        array = embeddings(spark, sf_dir, chunk=(50, 16), shard_shape=(200, 64), codecs=[_entry("zstd")])
        return _double(catalog.open(behind(array.store), "embeddings").cells(spark).where("i0 >= 120 AND i0 < 260 AND i1 >= 20 AND i1 < 40"))


_shards_behind("http_shard_ranges", _served)
_shards_behind("manifest_shard_ranges", _manifest)
_shards_behind("zip_shard_ranges", _zipped)
_shards_behind("arrow_shard_ranges", lambda store: ArrowStore(f"file://{store.root}"))


@_query("SELECT n_nationkey AS i0, n_name AS value FROM nation")
def memory_scan(spark, sf_dir):
    """Written on the driver into memory and shipped to the tasks with the plan."""
    rows = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").toArrow()
    array = catalog.create(MemoryStore(), [rows.num_rows], "string", path="a", chunk_shape=[10])
    array.write(rows.column("n_name").to_pylist())
    return array.cells(spark)


@_query("""SELECT store, call, bytes FROM (VALUES ('local'), ('memory'), ('zip'), ('http'), ('arrow'), ('manifest')) s(store), (VALUES ('range', '345'), ('clipped', '89'),
('suffix', '789'), ('long suffix', '0123456789'), ('missing', NULL)) c(call, bytes)""")
def store_ranges(spark, sf_dir):
    """The byte ranges that shards are read by, of every store."""
    local, memory = _store(spark), MemoryStore()
    for store in (local, memory):
        for key in ("first", "k"):  # of a manifest one is inline, one in the file
            store.set(key, b"0123456789")
    stores = {"local": local, "memory": memory, "zip": _zipped(local), "http": resolve(_served(local)), "arrow": ArrowStore(f"file://{local.root}"), "manifest": _manifest(local)}
    rows = []
    for name, store in stores.items():
        got = {"range": store.get_partial("k", 3, 3), "clipped": store.get_partial("k", 8, 9), "suffix": store.get_suffix("k", 3), "long suffix": store.get_suffix("k", 99), "missing": store.get_partial("x", 0, 3)}
        rows += [(name, call, data if data is None else bytes(data).decode()) for call, data in got.items()]
    return spark.createDataFrame(rows, "store string, call string, bytes string")


# -- hierarchy ---------------------------------------------------------------
def _hierarchy(spark, sf_dir):
    store = _store(spark)
    root = catalog.create_group(store, attributes={"title": "tables"})
    vector(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", path="orders/totalprice", store=store)
    vector(spark, sf_dir, "nation", "n_nationkey", "n_name", dtype="string", path="nation/name", chunk=10, store=store)
    vector(spark, sf_dir, "nation", "n_nationkey", "n_regionkey", dtype="int32", path="nation/regionkey", chunk=10, store=store)
    root.item("nation").set_attr("rows", 25)
    return store


_TREE = """SELECT * FROM (VALUES ('', 0, 'group', NULL, NULL), ('nation', 1, 'group', NULL, NULL), ('nation/name', 2, 'array', 25, 'string'),
('nation/regionkey', 2, 'array', 25, 'int32'), ('orders', 1, 'group', NULL, NULL),
('orders/totalprice', 2, 'array', (SELECT max(o_orderkey) + 1 FROM orders), 'float64')) t(path, depth, node_type, n, dtype)"""


@_query(_TREE)
def catalog_tree(spark, sf_dir):
    df = catalog.open(_hierarchy(spark, sf_dir)).catalog_df(spark)
    return df.select("path", "depth", "node_type", F.col("shape")[0].alias("n"), "dtype")


@_query("SELECT * FROM (VALUES ('name', 'array'), ('regionkey', 'array')) t(name, node_type)")
def consolidated_children(spark, sf_dir):
    return catalog.consolidate_metadata(_hierarchy(spark, sf_dir)).item("nation").children_df(spark)


@_query(_TREE.replace("FROM (VALUES", "FROM (SELECT path, depth - 1 AS depth, node_type, n, dtype FROM (VALUES").replace("t(path, depth, node_type, n, dtype)", "t(path, depth, node_type, n, dtype)) WHERE path LIKE 'nation%'"))
def subgroup_tree(spark, sf_dir):
    df = catalog.open(_hierarchy(spark, sf_dir), "nation").catalog_df(spark)
    return df.select("path", "depth", "node_type", F.col("shape")[0].alias("n"), "dtype")


_LOOKUP = {"nation": True, "nation/name": True, "nation/comment": False, "orders/totalprice": True, "part": False}


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{name}', {str(found).lower()})" for name, found in _LOOKUP.items()) + ") t(name, found)")
def child_exists(spark, sf_dir):
    root = catalog.open(_hierarchy(spark, sf_dir))
    return spark.createDataFrame([(name, name in root) for name in _LOOKUP], "name string, found boolean")


@_query("SELECT n_nationkey AS i0, n_name AS value FROM nation")
def overwrite_node(spark, sf_dir):
    """A longer array of another type at the same path leaves nothing behind."""
    store = _store(spark)
    vector(spark, sf_dir, "customer", "c_custkey", "c_acctbal", chunk=10, store=store)
    return vector(spark, sf_dir, "nation", "n_nationkey", "n_name", dtype="string", chunk=10, store=store, overwrite=True).cells(spark)


@_query("SELECT CAST(0 AS BIGINT) AS chunk, CAST(0 AS BIGINT) AS start, count(*) AS extent FROM nation")
def default_chunks(spark, sf_dir):
    """Without a chunk shape the array is one chunk."""
    df = _table(spark, sf_dir, "nation")
    array = catalog.create(_store(spark), [_length(df, "n_nationkey")], "int32", path="a")
    array.write_df(df.select(F.col("n_nationkey").alias("i0"), F.col("n_regionkey").alias("value")))
    return array.blocks(spark).select(*(F.col(c)[0].alias(c) for c in ("chunk", "start", "extent")))


#: Wrong calls and the identifiers of their errors.
_ERRORS = {
    "open a missing node": "NodeNotFound", "delete a missing node": "NodeNotFound", "create twice": "NodeExists", "create below an array": "NodeExists",
    "climb out of the store": "InvalidPath", "open a number": "InvalidStore", "subscript too large": "Indexing", "subscripts of another rank": "Indexing", "empty subscript": "Indexing",
    "region too large": "Indexing", "delete a cell": "Indexing", "resize to another rank": "ShapeMismatch", "append another width": "ShapeMismatch", "assign too few values": "ShapeMismatch",
    "chunk of zero cells": "InvalidChunkShape", "shard no multiple of chunk": "InvalidChunkShape", "unknown type": "UnsupportedDataType", "unknown codec": "UnsupportedCodec",
    "order twice": "InvalidCodecs", "broken document": "InvalidMetadata", "unknown format": "UnsupportedFeature", "broken checksum": "ChecksumError", "write over HTTP": "StoreError", "write into a zip opened to read": "StoreError",
}


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{call}', '{error}')" for call, error in _ERRORS.items()) + ") t(call, error)")
def error_identifiers(spark, sf_dir):
    store = _hierarchy(spark, sf_dir)
    array = catalog.open(store, "nation/regionkey")
    square = catalog.create(store, [4, 6], "int32", path="square", chunk_shape=[2, 2], codecs=[_entry("crc32c")])
    square.write([[1] * 6] * 4)
    square.store.set("square/c/0/0", square.store.get("square/c/0/0")[:-1] + b"?")
    store.set("broken/zarr.json", b"{")
    store.set("old/zarr.json", json.dumps({**json.loads(square.meta.to_json()), "storage_transformers": [{"name": "x"}]}).encode())
    calls = {
        "open a missing node": lambda: catalog.open(store, "x"), "delete a missing node": lambda: catalog.delete_node(store, "x"),
        "create twice": lambda: catalog.create(store, [2], path="square"), "create below an array": lambda: catalog.create(store, [2], path="square/x"),
        "climb out of the store": lambda: catalog.open(store, "../x"), "open a number": lambda: catalog.open(3), "subscript too large": lambda: array[[25]],
        "subscripts of another rank": lambda: array[0, 0], "empty subscript": lambda: array[[]], "region too large": lambda: array.read([20], [6]), "delete a cell": lambda: array.__delitem__(0),
        "resize to another rank": lambda: array.resize([2, 2]), "append another width": lambda: square.append([[1, 2]]), "assign too few values": lambda: square.__setitem__((slice(0, 2), slice(0, 2)), [1, 2, 3]),
        "chunk of zero cells": lambda: catalog.create(store, [2], path="y", chunk_shape=[0]), "shard no multiple of chunk": lambda: catalog.create(store, [8], path="y", chunk_shape=[2], shard_shape=[3]),
        "unknown type": lambda: catalog.create(store, [2], "float8", path="y"), "unknown codec": lambda: catalog.create(store, [2], path="y", codecs=[_entry("nope")]),
        "order twice": lambda: catalog.create(store, [2, 2], path="y", order="F", codecs=[_entry("transpose", order=[1, 0])]), "broken document": lambda: catalog.open(store, "broken"),
        "unknown format": lambda: catalog.open(store, "old"), "broken checksum": lambda: square.read(), "write over HTTP": lambda: resolve("http://127.0.0.1:9").set("k", b""),
        "write into a zip opened to read": lambda: _zipped(store).set("k", b""),
    }
    rows = []
    for call, run in calls.items():
        try:
            run()
            rows.append((call, None))
        except ChunkframeError as e:
            rows.append((call, e.identifier))
    return spark.createDataFrame(rows, "call string, error string")


@_query("SELECT * FROM (VALUES ('nation', 'group')) t(name, node_type)")
def delete_node(spark, sf_dir):
    store = _hierarchy(spark, sf_dir)
    catalog.delete_node(store, "orders")
    return catalog.open(store).children_df(spark)


@_query("SELECT 'nation/name' AS path, 25 AS size, 'string' AS dtype, 'EUROPE' AS region, '{\"region\": \"EUROPE\"}' AS attributes")
def describe_and_attributes(spark, sf_dir):
    store = _hierarchy(spark, sf_dir)
    catalog.open(store, "nation/name").set_attr("region", "EUROPE")
    df = catalog.open(store, "nation/name").describe_df(spark)
    return df.select("path", F.col("size").cast("int").alias("size"), "dtype", F.get_json_object("attributes", "$.region").alias("region"), "attributes")


@_query("SELECT n_nationkey::BIGINT AS nation, n_name AS value FROM nation")
def named_dimensions(spark, sf_dir):
    return vector(spark, sf_dir, "nation", "n_nationkey", "n_name", dtype="string", chunk=10, dimension_names=["nation"]).cells(spark, named=True)


@_query("SELECT event_id // 1024 AS chunk, count(*) AS cells FROM events GROUP BY 1")
def chunk_stats(spark, sf_dir):
    cells = vector(spark, sf_dir, "events", "event_id", "value").cells(spark)
    return cells.groupBy(chunk_columns(["i0"], [1024])[0].alias("chunk")).agg(F.count("*").alias("cells"))


@_query("SELECT DISTINCT 'c/' || (event_id // 1024) AS key, event_id // 1024 AS chunk FROM events")
def chunk_keys(spark, sf_dir):
    stored = vector(spark, sf_dir, "events", "event_id", "value").chunks_df(spark)
    return stored.select(chunk_key([F.col("chunk")[0]]).alias("key"), chunk_coords(F.col("key"), 1)[0].alias("chunk"))


# -- relational work over cells ------------------------------------------------
@_query(f"SELECT i1, round(avg(value), 6) AS mean FROM {_E} GROUP BY i1")
def axis_mean(spark, sf_dir):
    return embeddings(spark, sf_dir).cells(spark).groupBy("i1").agg(F.round(F.avg(F.col("value").cast("double")), 6).alias("mean"))


@_query("SELECT event_id AS i0, round(avg(value) OVER (ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def rolling_mean(spark, sf_dir):
    cells = vector(spark, sf_dir, "events", "event_id", "value").cells(spark)
    # a halo of three cells lets each block of 4096 be a window of its own
    block = F.floor(F.col("i0") / 4096)
    halo = F.when((F.col("i0") % 4096 >= 4093), F.array(block, block + 1)).otherwise(F.array(block))
    dealt = cells.withColumn("own", block).withColumn("block", F.explode(halo))
    mean = F.avg("value").over(W.partitionBy("block").orderBy("i0").rowsBetween(-3, 0))
    return dealt.withColumn("mean", F.round(mean, 6)).where("own = block").select("i0", "mean")


@_query("SELECT r.r_name AS region, count(*) AS nations FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1")
def array_join(spark, sf_dir):
    keys = vector(spark, sf_dir, "nation", "n_nationkey", "n_regionkey", dtype="int64", chunk=10).cells(spark)
    names = vector(spark, sf_dir, "region", "r_regionkey", "r_name", dtype="string", chunk=2).cells(spark)
    joined = keys.withColumnRenamed("value", "r").join(names.select(F.col("i0").alias("k"), F.col("value").alias("region")), F.col("r") == F.col("k"))
    return joined.groupBy("region").agg(F.count("*").alias("nations"))


@_query("SELECT o_orderstatus AS status, CAST(m AS BIGINT) AS month, count(*) AS n FROM (SELECT *, month(o_orderdate) AS m FROM orders) GROUP BY 1, 2")
def histogram_cube(spark, sf_dir):
    """A rank-3 count array (priority, status, month) and a roll-up of it."""
    df = _table(spark, sf_dir, "orders")
    def axis(name):
        """The distinct values in order, with their positions: ``<name>, at``."""
        return df.select(name).distinct().withColumn("at", (F.row_number().over(W.orderBy(name)) - 1).cast("bigint"))

    status, priority = axis("o_orderstatus"), axis("o_orderpriority")
    placed = df.join(priority.withColumnRenamed("at", "i0"), "o_orderpriority").join(status.withColumnRenamed("at", "i1"), "o_orderstatus")
    counts = placed.groupBy("i0", "i1", (F.month("o_orderdate") - 1).cast("bigint").alias("i2")).agg(F.count("*").alias("value"))
    array = catalog.create(_store(spark), [priority.count(), status.count(), 12], "int64", chunk_shape=[2, 2, 5], codecs=[_entry("zstd")])
    array.write_df(counts)
    rolled = array.cells(spark).groupBy("i1", "i2").agg(F.sum("value").alias("n")).where("n > 0")
    return rolled.join(status, F.col("i1") == F.col("at")).select(F.col("o_orderstatus").alias("status"), (F.col("i2") + 1).alias("month"), "n")


@_query("SELECT CAST(event_id % 1000 // 100 AS BIGINT) AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def flagship(spark, sf_dir):
    """A stored array, grouped."""
    cells = vector(spark, sf_dir, "events", "event_id", "value", codecs=[_entry("gzip", level=1)]).cells(spark)
    bucket = F.floor(F.col("i0") % 1000 / 100)
    return cells.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
