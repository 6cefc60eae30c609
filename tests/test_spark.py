"""Arrays through Spark: scans with pruning, distributed writes, the sink and streams."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import chunkframe as cf
from chunkframe import errors
from chunkframe.functions.cells import chunk_columns, chunk_coords, chunk_key, linear_index, saturating_cast
from chunkframe.sources.cells import CellReader, CellSource
from chunkframe.streaming.append import appender


@pytest.fixture
def store(tmp_path):
    return cf.LocalStore(tmp_path / "s")


def grid(spark, rows, cols):
    return spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("i0"), (F.col("id") % cols).alias("i1"), F.col("id").cast("double").alias("value"))


def dense(df, shape, fill=0):
    out = np.full(shape, fill, float)
    for r in df.collect():
        out[tuple(r[f"i{d}"] for d in range(len(shape)))] = r["value"]
    return out


def test_distributed_write_and_scan(spark, store):
    a = cf.create(store, (30, 17), chunk_shape=(8, 8), codecs=[{"name": "zstd"}])
    x = np.arange(510.0).reshape(30, 17)
    assert a.write_df(grid(spark, 30, 17)) == 12
    assert (a.read() == x).all() and (dense(a.cells(spark), (30, 17), -1) == x).all()
    df = a.cells(spark, (3, 2), (10, 9))
    assert df.count() == 90 and df.agg(F.sum("value")).first()[0] == x[3:13, 2:11].sum()
    assert a.cells(spark).where("i0 in (1, 29) and i1 > 14.5 and i1 <= 99").count() == 4
    assert a.cells(spark).where("i0 = 5 or i1 = 2").count() == 17 + 29
    assert a.cells(spark).where("i0 > 40").count() == 0
    with pytest.raises(errors.Indexing):
        a.cells(spark, (0, 0), (31, 1))


def test_pushdown_prunes_chunks(store):
    """The filters that Spark hands over decide which chunks tasks get."""
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    a = cf.create(store, (100, 100), path="a", chunk_shape=(10, 10))
    source = CellSource({"path": str(store.root), "node": "a"})
    for filters, chunks in [([], 100), ([EqualTo(("i0",), 5)], 10), ([GreaterThanOrEqual(("i0",), 15), LessThan(("i0",), 21), In(("i1",), (3, 99))], 4), ([EqualTo(("value",), 5.0)], 100)]:
        reader = source.reader(source.schema())
        assert isinstance(reader, CellReader) and list(reader.pushFilters(filters)) == filters  # Spark checks all again
        assert sum(len(list(p.chunks)) for p in reader.partitions()) == chunks
    assert a.shape == (100, 100)


def test_scan_touches_only_hit_chunks(spark, store):
    """All other chunks are broken, and nobody notices."""
    a = cf.create(store, (100,), chunk_shape=10, codecs=[{"name": "gzip"}])
    a.write(np.arange(100.0))
    for k in (0, 1, 4, 5, 6, 7, 8, 9):
        store.set(f"c/{k}", b"broken")
    assert a.cells(spark).where("i0 >= 20 and i0 < 40").agg(F.sum("value")).first()[0] == sum(range(20, 40))
    assert a.cells(spark).where("i0 in (25, 31)").count() == 2 and a.select(spark, [39, 20]).count() == 2
    with pytest.raises(Exception, match="gzip"):
        a.cells(spark).count()


def test_plan_shows_one_scan_without_shuffle(spark, store):
    a = cf.create(store, (100,), chunk_shape=10)
    plan = a.cells(spark).where("i0 < 5")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Exchange" not in plan


def test_updates_fill_and_order(spark, store):
    a = cf.create(store, (20,), "int32", chunk_shape=6, fill_value=-1)
    rows = [(3, 1, 0), (3, 2, 1), (19, 7, 0), (4, None, 0), (None, 5, 0)]
    a.write_df(spark.createDataFrame(rows, "i0 int, value int, o int"), order_by="o")
    want = np.full(20, -1)
    want[3], want[19] = 2, 7
    assert (a.read() == want).all() and not store.exists("c/1")
    assert a.fill(spark, 5, [2], [9]) == 2
    want[2:11] = 5
    assert (a.read() == want).all()
    with pytest.raises(Exception, match="Indexing|dimension"):
        a.write_df(spark.createDataFrame([(20, 1)], "i0 int, value int"))
    b = cf.create(cf.MemoryStore(), (3,))
    with pytest.raises(errors.StoreError):
        b.write_df(spark.createDataFrame([(0, 1.0)], "i0 int, value double"))
    b.write(np.arange(3.0))
    assert dense(b.cells(spark), (3,)).tolist() == [0, 1, 2]  # a copy goes to the tasks


@pytest.mark.parametrize("location", ["start", "end"])
def test_shards(spark, store, location):
    a = cf.create(store, (40, 30), chunk_shape=(5, 5), shard_shape=(20, 15), index_location=location, codecs=[{"name": "gzip"}, {"name": "crc32c"}])
    a.write_df(grid(spark, 40, 30))
    x = np.arange(1200.0).reshape(40, 30)
    assert (a.read() == x).all() and a.cells(spark).where("i0 between 18 and 22 and i1 = 14").agg(F.sum("value")).first()[0] == x[18:23, 14].sum()
    assert a.blocks(spark).count() == 4


def test_sink_needs_whole_chunks(spark, store):
    a = cf.create(store, (64,), path="a", chunk_shape=16)
    cells = spark.range(64).select(F.col("id").alias("i0"), F.col("id").cast("double").alias("value"))
    source = a.cells(spark)
    a.by_chunk(cells).write.format("chunkframe").mode("append").option("node", "a").save(store.root)
    assert source.agg(F.sum("value")).first()[0] == 2016
    with pytest.raises(Exception, match="by_chunk"):
        cells.repartition(4).write.format("chunkframe").mode("append").option("node", "a").save(store.root)


@pytest.mark.parametrize("dtype, kind, values", [
    ("uint64", "decimal(20,0)", [0, 2**64 - 1]), ("int64", "bigint", [-(2**63), 5]), ("bool", "boolean", [True, False]), ("float16", "float", [0.5, 65504.0]), ("string", "string", ["é", ""]), ("bytes", "binary", [b"\0", b""]),
])
def test_types(spark, store, dtype, kind, values):
    a = cf.create(store, (2,), dtype, chunk_shape=1)
    schema = T.StructType([T.StructField("i0", T.LongType()), T.StructField("value", a.meta.dtype.spark)])
    assert schema["value"].dataType.simpleString() == kind
    from decimal import Decimal

    rows = [(i, Decimal(v) if dtype == "uint64" else v) for i, v in enumerate(values)]
    a.write_df(spark.createDataFrame(rows, schema))
    got = [r["value"] for r in a.cells(spark).orderBy("i0").collect()]
    assert [bytes(v) if dtype == "bytes" else v for v in got] == values


def test_records_and_fields(spark, store):
    schema = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("p", T.StructType([T.StructField("y", T.DoubleType()), T.StructField("s", T.StringType())]))])
    a = cf.create(store, (3,), schema, chunk_shape=2)
    df = spark.createDataFrame([(0, (1, (2.5, "é"))), (2, (3, (-1.0, "z")))], T.StructType([T.StructField("i0", T.LongType()), T.StructField("value", schema)]))
    a.write_df(df)
    got = [r["value"] for r in a.cells(spark).orderBy("i0").collect()]
    assert got[0] == (1, (2.5, "é")) and got[1] == (0, (0.0, "")) and a.cells(spark, fields=["x"]).select("value.*").columns == ["x"]


def test_select(spark, store):
    a = cf.create(store, (8, 8), "int32", chunk_shape=(3, 3))
    a.write(np.arange(64).reshape(8, 8))
    got = {(r["o0"], r["o1"]): r["value"] for r in a.select(spark, ([7, 1, 7], slice(2, 4))).collect()}
    assert got == {(i, j): 8 * p + 2 + j for i, p in enumerate([7, 1, 7]) for j in range(2)}
    assert a.select(spark, ([2], slice(0, 0))).count() == 0
    flat = [r["value"] for r in a.flat(spark).orderBy("lin").collect()]
    assert flat == np.arange(64).reshape(8, 8).reshape(-1, order="F").tolist()
    with pytest.raises(errors.Indexing):
        a.select(spark, ([8], 0))


def test_append_df_publishes_last(spark, store):
    a = cf.create(store, (5, 2), chunk_shape=(4, 2))
    a.write(np.ones((5, 2)))
    a.append_df(grid(spark, 3, 2), 3)
    assert cf.open(store).shape == (8, 2) and (a.read()[5:] == np.arange(6).reshape(3, 2)).all()
    with pytest.raises(errors.Indexing):
        a.append_df(grid(spark, 3, 2), 3, dim=2)


def test_expressions(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (float("nan"),), (1e30,), (-1e30,), (126.7,), (None,), (0.49999999999999994,)], "x double")
    got = [tuple(r) for r in df.select(*(saturating_cast(F.col("x"), t) for t in ("int8", "uint8", "int64"))).collect()]
    assert got == [(3, 3, 3), (-3, 0, -3), (0, 0, 0), (127, 255, 2**63 - 1), (-128, 0, -(2**63)), (127, 127, 127), (None, None, None), (0, 0, 0)]
    one = spark.range(1).select(F.lit(17).alias("i0"), F.lit(9).alias("i1"))
    r = one.select(chunk_key(chunk_columns(["i0", "i1"], (5, 4))).alias("k"), linear_index(["i0", "i1"], (20, 10), "F").alias("f"), linear_index(["i0", "i1"], (20, 10)).alias("c")).first()
    assert (r["k"], r["f"], r["c"]) == ("c/3/2", 17 + 20 * 9, 179)
    keys = spark.createDataFrame([("c/3/2",), ("c/3",), ("metadata.json",), ("c/03/2",)], "k string")
    assert [x[0] for x in keys.select(chunk_coords(F.col("k"), 2)).collect()] == [[3, 2], None, None, None]


def test_catalog_frames(spark, store):
    root = cf.create_group(store)
    root.create_array("g/a", (3,), "int8", attributes={"k": 1})
    rows = [(r["path"], r["depth"], r["node_type"], r["dtype"]) for r in root.catalog_df(spark).collect()]
    assert rows == [("", 0, "group", None), ("g", 1, "group", None), ("g/a", 2, "array", "int8")]
    assert root["g/a"].describe_df(spark).first()["chunk_shape"] == [3] and root["g"].children_df(spark).first()["name"] == "a"


def test_stream_appends_once(spark, store, tmp_path):
    a = cf.create(store, (0,), path="a", chunk_shape=7)
    source = tmp_path / "in"
    cells = spark.range(20).select(F.col("id").alias("t"), (F.col("id") * 2).cast("double").alias("v"))
    cells.where("t < 12").repartition(3).write.parquet(f"{source}/1")
    run = appender(store, "a", "v", "t")
    stream = spark.readStream.schema(cells.schema).option("recursiveFileLookup", "true").parquet(str(source))
    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert cf.open(store, "a").read().tolist() == [2.0 * i for i in range(12)]
    run(cells.where("t < 12"), 0)  # a replay
    run(cells.where("t >= 12"), 1)
    a = cf.open(store, "a")
    assert a.shape == (20,) and a.read().tolist() == [2.0 * i for i in range(20)]


def test_stream_replays_a_batch_that_crashed(spark, store, monkeypatch):
    """A crash before, and one after, the array's document is written."""
    from chunkframe.operators.array import Array

    cf.create(store, (0,), path="a", chunk_shape=7)
    run = appender(store, "a", "v", "t")
    cells = spark.range(20).select((F.col("id") % 5).alias("t"), F.col("id").cast("double").alias("v"))
    want = [float(i) for t in range(5) for i in range(t, 20, 5)]
    save = Array._save
    for before in (True, False):
        batch = 0 if before else 1

        def crash(self):
            if not before:
                save(self)
            raise RuntimeError("lost")

        monkeypatch.setattr(Array, "_save", crash)
        with pytest.raises(RuntimeError):
            run(cells, batch)
        monkeypatch.undo()
        run(cells, batch)
        assert cf.open(store, "a").read().tolist() == want * (1 if before else 2)


def test_empty_subscripts_and_rank_0(spark, store):
    a = cf.create(store, (4,), path="e", chunk_shape=2)
    for index in ([], [False] * 4):
        with pytest.raises(errors.Indexing):
            a[index]
        with pytest.raises(errors.Indexing):
            a.select(spark, index)
    with pytest.raises(errors.ShapeMismatch):
        cf.create(store, (), path="z").append(1.0)
    with pytest.raises(errors.UnsupportedCodec):
        cf.create(store, (4,), path="s", chunk_shape=4, codecs=[{"name": "sharding_indexed", "configuration": {"chunk_shape": [2], "codecs": [{"name": "bytes"}], "index_codecs": [{"name": "bytes"}, {"name": "gzip"}]}}])


def test_sink_holds_few_rows(spark, tmp_path, monkeypatch):
    """Rows of a chunk may come in several lots; the last of a cell stays."""
    from chunkframe.sources import cells as sink

    store = cf.LocalStore(tmp_path)
    a = cf.create(store, (40, 6), "int32", path="a", chunk_shape=(8, 4))
    rng = np.random.default_rng(3)
    rows = np.stack([rng.integers(0, 40, 900), rng.integers(0, 6, 900), np.arange(900) + 1], axis=1)
    want = np.zeros((40, 6), "int32")
    for i, j, v in rows:
        want[i, j] = v
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in part.T], names=["i0", "i1", "value"]) for part in np.split(rows, 30)]
    monkeypatch.setattr(sink, "HELD_BYTES", 2000)
    message = sink.CellWriter(store, "a", a.meta, ["i0", "i1"]).write(iter([batches[0].slice(0, 0), *batches]))
    assert (a.read() == want).all() and len(message.chunks) == len(set(message.chunks)) == 10
    assert sink.CellWriter(store, "a", a.meta, ["i0", "i1"]).write(iter([])).chunks == []


@pytest.mark.parametrize("shape", [(5, 9), (20, 3), (0, 0), (8, 4), (17, 10), (30, 2)])
@pytest.mark.parametrize("keep", [False, True])
def test_resize_in_tasks_equals_driver(spark, tmp_path, shape, keep):
    made = []
    for name in ("tasks", "driver"):
        a = cf.create(tmp_path / name, (20, 10), "int32", path="a", chunk_shape=(4, 4), write_empty_chunks=keep)
        a.write(np.arange(1, 81).reshape(8, 10))  # not all chunks are stored
        made.append(a)
    tasks, driver = made
    tasks.store.list = None  # no key may be listed
    tasks.resize(shape, spark)
    del tasks.store.list
    driver.resize(shape)
    assert tasks.store.list() == driver.store.list()
    assert all(tasks.store.get(k) == driver.store.get(k) for k in driver.store.list())
    rows = {(r["key"], tuple(r["chunk"]), r["bytes"]) for r in tasks.chunks_df(spark).collect()}
    assert rows == {(k, c, tasks.store.size(f"a/{k}")) for k, c in tasks._stored()}
