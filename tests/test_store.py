import random

import pytest
from pyspark.sql import functions as F

from stratalog import Store, StoreOptions
from stratalog.functions import workloads
from stratalog.manifest import Manifest, Version, replay
from stratalog.sources.blobs import Blobs, MemoryBlobs, check_name
from stratalog.sources.wal import MAJOR, MERGE, MINOR, SNAPSHOT
from stratalog.streaming.upsert import into_store, upsert_all


def check(store, model):
    assert list(store.scan()) == sorted((k, v) for k, v in model.items())


def test_against_a_dict(spark, tmp_path):
    rng = random.Random(1)
    path, model = f"file://{tmp_path}/db", {}
    store = Store.create(spark, path, StoreOptions(max_wal_bytes=400))
    for step in range(6):
        for _ in range(25):
            k = bytes([rng.randrange(60)]) * rng.randint(0, 2)
            if rng.random() < 0.3:
                store.remove(k)
                model.pop(k, None)
            else:
                v = bytes([rng.randrange(256)]) * rng.randint(0, 3)
                store.set(k, v)
                model[k] = v
        if step == 1:
            rows = [(bytearray([i]), None if i % 3 == 0 else bytearray([i, i])) for i in range(30)]
            store.put_df(spark.createDataFrame(rows, "key binary, value binary"))
            for k, v in rows:
                model.pop(bytes(k), None)
                if v is not None:
                    model[bytes(k)] = bytes(v)
        elif step == 2:
            while store.maintain():
                pass
        elif step == 3:
            store.close()
            store = Store.recover(spark, path)
        elif step == 4:
            store.compact()
            assert store.log().where("value IS NULL").count() == 0
        check(store, model)
    for k in [*model][:5] + [b"nothing"]:
        assert store.get(k) == model.get(k)
    lo, hi = b"\x05", b"\x20"
    assert list(store.scan().from_(lo).to(hi)) == sorted((k, v) for k, v in model.items() if lo <= k < hi)
    store.compact()
    store.vacuum()
    check(store, model)
    assert store.fsck().count() == 0
    store.close()
    check(Store.recover(spark, path), model)


def test_edges(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    store = Store.create(spark, path)
    with pytest.raises(FileExistsError):
        Store.create(spark, path)
    with pytest.raises(FileNotFoundError):
        Store.recover(spark, f"file://{tmp_path}/none")
    store.flush()
    store.compact()
    assert list(store.scan()) == [] and store.get(b"") is None
    store.remove(b"never")
    store.set(b"", b"")
    assert store.get(b"") == b"" and store.async_get(b"").result() == b""
    store.async_set(b"x", b"y").result()
    store.async_remove(b"").result()
    before = store.scan()
    store.set(b"later", b"1")
    assert list(before) == [(b"x", b"y")]
    store.remove(b"x")
    store.remove(b"later")
    store.compact()
    assert list(store.scan()) == []
    store.register_views("t")
    assert spark.table("t_live").count() == 0
    store.close()
    with pytest.raises(ValueError):
        store.set(b"a", b"b")


def test_damaged_log(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    store = Store.create(spark, path)
    for i in range(10):
        store.set(bytes([i]), b"v")
    store.close()
    file = tmp_path / "db" / "wal" / "wal.0.log"
    raw = bytearray(file.read_bytes())
    raw[4 + 5 * 10 + 3] ^= 0xFF
    file.write_bytes(bytes(raw))
    back = Store.recover(spark, path)
    assert [k for k, _ in back.scan()] == [bytes([i]) for i in range(5)]


def test_second_writer_fails(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    a = Store.create(spark, path)
    b = Store.recover(spark, path)
    rows = spark.createDataFrame([(bytearray(b"k"), bytearray(b"v"))], "key binary, value binary")
    a.put_df(rows)
    with pytest.raises(FileExistsError):
        b.put_df(rows)
    assert a.fsck().where("problem = 'untracked'").count() == 1


def test_replay_rules():
    events = [(MINOR, ("wal.0.log",), "a"), (MINOR, ("wal.1.log",), "b"), (MINOR, ("wal.2.log",), "c")]
    assert replay(events) == (["a", "b", "c"], {"wal.0.log", "wal.1.log", "wal.2.log"}, set())
    runs, _, dead = replay([*events, (MERGE, ("b", "c"), "d"), (SNAPSHOT, ("a", "d"), None), (MAJOR, ("a", "d"), "e")])
    assert runs == ["e"] and dead == {"a", "b", "c", "d"}
    with pytest.raises(ValueError):
        replay([(MERGE, ("a",), "b")])
    with pytest.raises(ValueError):
        replay([*events, (SNAPSHOT, ("a",), None)])


def test_blobs_and_manifest(spark, tmp_path):
    for blobs in (MemoryBlobs(), Blobs(spark, f"file://{tmp_path}/blobs")):
        m = Manifest(blobs)
        assert m.load() is None
        m.commit(Version())
        m.commit(Version(version=1, event="x"))
        with pytest.raises(FileExistsError):
            m.commit(Version(version=1))
        assert m.load().event == "x" and m.load(0).event == "create"
        assert m.expire(1) == [0] and m.versions() == [1]
    for bad in ("", ".a", "a/b", "a b"):
        with pytest.raises(ValueError):
            check_name(bad)


def test_streams(spark, tmp_path):
    rows = [(bytearray([i % 7]), None if i % 5 == 0 else bytearray([i]), i) for i in range(50)]
    df = spark.createDataFrame(rows, "key binary, value binary, seq long")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    model = {}
    for k, v, _ in rows:
        model[bytes(k)] = v
    want = sorted((k, bytes(v)) for k, v in model.items() if v is not None)
    got = upsert_all(spark, stream(), str(tmp_path / "out"))
    assert sorted((bytes(r.key), bytes(r.value)) for r in got.collect()) == want
    store = Store.create(spark, f"file://{tmp_path}/db")
    whole = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    into_store(whole, store, str(tmp_path / "cp")).awaitTermination()
    assert list(store.scan()) == want


def test_bulk_order(spark, tmp_path):
    store = Store.create(spark, f"file://{tmp_path}/db")
    df = spark.createDataFrame([(bytearray(b"k"), bytearray(b"z"), 1), (bytearray(b"k"), bytearray(b"a"), 2)], "key binary, value binary, n int")
    store.put_df(df, order="n")
    assert store.get(b"k") == b"a"
    store.put_df(df.drop("n"))
    assert store.get(b"k") == b"z"
    assert store.multi_get(spark.createDataFrame([(bytearray(b"k"),), (bytearray(b"q"),)], "key binary")).count() == 1
    assert store.runs().where(F.col("kind") == "minor").count() == 2


def test_layers_and_series(spark, tmp_path):
    store, model = Store.create(spark, f"file://{tmp_path}/db"), {}
    for batch in workloads.layers(256):
        store.put_df(spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v)) for k, v in batch], "key binary, value binary"))
        model.update(batch)
    live = {k: v for k, v in model.items() if v is not None}
    check(store, live)
    assert store.maintain() == "minor"
    check(store, live)
    for rows in (workloads.series_rows(200), workloads.varied_values(200)):
        rows = list(rows)
        store.put_df(spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in rows], "key binary, value binary"))
        live.update(rows)
    store.compact()
    check(store, live)
    assert {r.kind for r in store.runs().collect()} == {"base"}
