import random

from pyspark.sql import functions as F

from stratalog.operators import compaction as C
from stratalog.operators import resolve as R


def log(spark, n=300, seed=0, keys=40):
    rng = random.Random(seed)
    rows = [(bytes([rng.choice([0, 1, 127, 128, 255])]) * rng.randint(0, 3) + bytes([rng.randrange(keys)]), None if rng.random() < 0.3 else bytes([rng.randrange(256)]) * rng.randint(0, 2), i) for i in range(n)]
    return rows, spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v), s) for k, v, s in rows], "key binary, value binary, seq long")


def pairs(df):
    return [(bytes(r.key), None if r.value is None else bytes(r.value)) for r in df.collect()]


def model(rows):
    out = {}
    for k, v, _ in rows:
        out[k] = v
    return out


def test_live_and_order(spark):
    rows, df = log(spark)
    want = sorted((k, v) for k, v in model(rows).items() if v is not None)
    assert pairs(R.scan(df)) == want
    assert pairs(R.scan(df, limit=5)) == want[:5]
    assert sorted(pairs(R.live(df))) == want
    assert sorted(bytes(r.key) for r in R.tombstones(df).collect()) == sorted(k for k, v in model(rows).items() if v is None)


def test_half_open_ranges_join_up(spark):
    rows, df = log(spark)
    a, b, c = bytearray(b"\x01"), bytearray(b"\x7f\x05"), bytearray(b"\xff")
    assert pairs(R.scan(df, a, b)) + pairs(R.scan(df, b, c)) == pairs(R.scan(df, a, c))
    assert pairs(R.scan(df, c, a)) == []
    assert pairs(R.scan(df, bytearray(b"\xff\xff\xff\xff\xff"))) == []


def test_merges(spark):
    rows, df = log(spark)
    runs = [R.lww(df.where(F.floor(F.col("seq") / 60) == i)).select("key", "value") for i in range(5)]
    want = sorted(pairs(R.lww(df).select("key", "value")))
    assert sorted(pairs(R.merge_runs(runs))) == want
    step = runs[0]
    for r in runs[1:]:
        step = R.joined(r, step)
    assert sorted(pairs(step)) == want


def test_compaction_keeps_live_rows(spark):
    _, df = log(spark)
    want = pairs(R.scan(df))
    top, low = df.where("seq >= 150"), df.where("seq < 150")
    kept = C.merge(top, False).unionByName(low)
    assert pairs(R.scan(kept)) == want
    done = C.merge(df, True)
    assert pairs(R.scan(done)) == want == pairs(R.scan(C.merge(done, True)))
    assert done.where("value IS NULL").count() == 0
    assert C.flush(df).where("value IS NULL").count() > 0


def test_recover_prefix_and_as_of(spark):
    rows, df = log(spark)
    marked = df.withColumn("block", F.floor(F.col("seq") / 50))
    blocks = marked.select("block").distinct()
    for bad in (0, 3, 99):
        got = R.recover_prefix(marked, blocks.withColumn("ok", F.col("block") != bad))
        want = model([r for r in rows if r[2] // 50 < bad])
        assert sorted(pairs(got)) == sorted((k, v) for k, v in want.items() if v is not None)
    assert sorted(pairs(R.as_of(df, 99))) == sorted((k, v) for k, v in model(rows[:100]).items() if v is not None)


def test_key_filters_reach_the_scan(spark, tmp_path):
    _, df = log(spark)
    df.write.parquet(str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    plan = R.between(R.live(back), bytearray(b"\x01"), bytearray(b"\x80"))._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(key" in pushed and "LessThan(key" in pushed
    assert "value" not in pushed[: pushed.index("]")]


def run(i, level, lo, hi, size=1):
    return C.Run(i, "level", level, lo, hi, 1, size, False, 0, 0, f"p{i}")


def test_policy():
    minors = [run(0, -1, "00", "10"), run(1, -1, "05", "20")]
    zero = [run(2, 0, "00", "30")]
    order = C.most_urgent(minors + zero)
    assert order.event == "minor" and len(order.runs) == 3 and not order.bottom
    assert C.most_urgent(minors[:1] + zero) is None
    big = C.level_bytes(0)
    zero = [run(3, 0, "00", "0A", big), run(4, 0, "0B", "1A", big), run(5, 0, "1B", "2A", 5)]
    one = [run(6, 1, "00", "05"), run(7, 1, "1A", "1C"), run(8, 1, "2B", "FF")]
    order = C.most_urgent(zero + one)
    assert [r.run_id for r in order.runs] == [3, 4, 6, 7] and order.level == 1 and not order.bottom
    assert C.regular_order([run(0, 6, "00", "01")], 6).bottom
    assert C.major_order([]) is None and C.major_order(zero).level == 7


def test_whole_table_orders(spark, tmp_path):
    from stratalog.plans import catalogue

    rng = random.Random(9)
    rows = [(seq, rng.randrange(300), rng.choice("FOP"), float(seq)) for seq in rng.sample(range(30_000), 3000)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    run = lambda seq: seq // catalogue.RUN_ROWS
    last = max(run(r[0]) for r in rows)
    newest = lambda keep: {k: (None if s == "F" else v, seq) for seq, k, s, v in sorted(rows) if keep(run(seq))}
    got = {name: {r.key: r for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()} for name in ("kv_minor_order_all", "kv_joined_halves", "kv_recover_last")}
    assert {k: (r.value, r.seq) for k, r in got["kv_minor_order_all"].items()} == newest(lambda n: True)
    assert any(run(r.seq) == last for r in got["kv_minor_order_all"].values())
    old, new = newest(lambda n: n <= last // 2), newest(lambda n: n > last // 2)
    assert {k: r.value for k, r in got["kv_joined_halves"].items()} == {k: v for k, (v, _) in (old | new).items()}
    assert {k: r.value for k, r in got["kv_recover_last"].items()} == {k: v for k, (v, _) in newest(lambda n: n < last).items() if v is not None}
