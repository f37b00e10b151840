"""Partitioning and merging, types, functions, joins, plans, sources."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera import functions as fn
from tessera import sources, streaming, types
from tessera.operators import joins, merge, partition
from tessera.operators.merge import Agg
from tessera.plans import contains_scan, deal, partition_info, passes_text_gate
from tessera.queries import QUERIES

AGGS = [Agg("count", "*", "n"), Agg("sum", "v", "s"), Agg("avg", "v", "a"), Agg("min", "v", "lo"), Agg("max", "v", "hi"), Agg("count_distinct", "v", "d")]


@pytest.fixture(scope="module")
def numbers(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('numbers')}/t"
    i = F.col("id")
    spark.range(0, 5000, 1, 5).select(i, F.when(i % 7 != 0, i % 3).alias("k"), F.when(i % 11 != 0, i % 50).alias("v")).write.parquet(path)
    return spark.read.parquet(path)


def test_rows_are_dense_over_files(numbers):
    placed = partition.with_row(numbers.select("*", "_metadata"))
    assert [r[0] for r in placed.select(partition.ROW).orderBy(partition.ROW).collect()] == list(range(5000))


def test_rows_keep_their_places_behind_a_filter(numbers):
    whole = {r["id"]: r[partition.ROW] for r in partition.with_row(numbers.select("*", "_metadata")).collect()}
    some = partition.with_row(numbers.select("*", "_metadata").where("v > 40 or k = 1")).collect()
    assert some and all(r[partition.ROW] == whole[r["id"]] and r[partition.ROWS] == 5000 for r in some)


@pytest.fixture
def large(spark):
    """Tables count as too large to be broadcast."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def rows_in_a_task(spark, df):
    """The most rows that a task gets by a shuffle, of all tasks that df is worked out in."""
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def stages():
        bus.waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {s.stageId(): s for s in map(found.apply, range(found.size())) if s.numCompleteTasks()}

    before = stages()
    df.write.format("noop").mode("overwrite").save()
    tasks = [store.taskList(k, s.attemptId(), 10_000) for k, s in stages().items() if k not in before]
    return max(t.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for t in tasks for i in range(t.size()))


@pytest.mark.parametrize("name", ["part_modulo", "part_range", "part_row_group", "part_small", "merge_ungrouped", "merge_distinct"])
def test_rows_of_a_file_are_not_sent_to_one_task(spark, large, name):
    d = "/root/testdata/sf0.01"
    assert rows_in_a_task(spark, QUERIES[name](spark, d)) < spark.read.parquet(f"{d}/lineitem.parquet").count() / 3


def test_asof_over_buckets_and_odd_rows(spark):
    import random

    rng = random.Random(3)
    left = [(rng.choice(["a", "b", None]), rng.choice([None, *range(60)]), i) for i in range(200)]
    right = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(0, 60, 7)]), i) for i in range(30)]
    l, r = spark.createDataFrame(left, "k string, t int, i int"), spark.createDataFrame(right, "k string, u int, v int")
    want = {}
    for k, t, i in left:
        before = [(u, v) for kk, u, v in right if kk == k and None not in (k, t, u) and u <= t]
        want[i] = max(before)[1] if before else None
    for width in (1.0, 5.0, 1000.0):
        got = {x["i"]: x["v"] for x in joins.asof_join(l, r, ["k"], "t", "u", ["v"], width).collect()}
        assert got == want
    moments = spark.createDataFrame([("a", datetime.datetime(2024, 1, d, 5), d) for d in (1, 9, 20)], "k string, t timestamp_ntz, i int")
    known = spark.createDataFrame([("a", datetime.datetime(2024, 1, 2), 7), ("a", datetime.datetime(2024, 1, 20, 5), 8)], "k string, u timestamp_ntz, v int")
    assert {x["i"]: x["v"] for x in joins.asof_join(moments, known, ["k"], "t", "u", ["v"]).collect()} == {1: None, 9: 7, 20: 8}


def test_intervals_of_all_lengths(spark):
    import random

    rng = random.Random(4)
    intervals = [(a, a + rng.choice([0, 1, 3, 40, 700, 10**9]), i) for i, a in enumerate(rng.randrange(-50, 500) for _ in range(60))] + [(None, 5, 98), (5, None, 99)]
    points = [(rng.randrange(-60, 900),) for _ in range(150)] + [(None,), (10**8,)]
    got = joins.interval_join(spark.createDataFrame(points, "p int"), spark.createDataFrame(intervals, "lo int, hi int, i int"), "p", "lo", "hi", 2.0)
    want = sorted((p, i) for (p,) in points for lo, hi, i in intervals if None not in (p, lo, hi) and lo <= p < hi)
    assert sorted((r["p"], r["i"]) for r in got.collect()) == want


@pytest.mark.parametrize("n", [1, 3, 8])
@pytest.mark.parametrize("kind", ["range", "modulo", "row_group"])
@pytest.mark.parametrize("where", ["true", "v > 40 or k = 1", "false"])
def test_parts_merge_to_the_whole(numbers, n, kind, where):
    part = {"range": partition.range_part(n), "modulo": partition.modulo_part(n), "row_group": partition.aligned_part(n, 300)}[kind]
    dealt = partition.partitioned(numbers.select("*", "_metadata"), part).where(where)
    for keys in (["k"], []):
        whole = numbers.where(where).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.avg("v").alias("a"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.countDistinct("v").alias("d"))
        got = sorted(map(str, merge.two_step(dealt, partition.PART, keys, AGGS).collect()))
        assert got == sorted(map(str, whole.collect()))
    assert merge.distinct_merge(dealt.select(partition.PART, "k", "v"), partition.PART).count() == numbers.where(where).select("k", "v").distinct().count()


def test_small_tables_are_one_part(numbers):
    dealt = partition.partitioned(numbers.select("*", "_metadata"), partition.single_part(partition.range_part(4)))
    assert dealt.select(partition.PART).distinct().count() == 1


def test_modes():
    assert [(deal(n, 4).mode, deal(n, 4).tasks) for n in (4, 200_000, 250_000, 500_000)] == [("DELEGATED", 1), ("NATURAL_PARTITION", 4), ("NATURAL_PARTITION", 4), ("ROW_GROUP_PARTITION", 3)]
    assert deal(500_000, 4).ranges == ((0, 245_759), (245_760, 491_519), (491_520, 499_999))
    assert deal(10, 0).mode == "LOCAL"
    for n in (1, 122_880, 250_001, 999_999):
        ranges = deal(n, 3, 5).ranges
        assert sum(b - a + 1 for a, b in ranges) == n and all(x[1] + 1 == y[0] for x, y in zip(ranges, ranges[1:], strict=False))
    assert partition_info(1000, 4) == {"rows_per_partition": 250, "worthwhile": True, "row_groups": 1}


def test_gates(spark, numbers):
    assert passes_text_gate("select a\nfrom t") and not passes_text_gate("SELECT 1") and not passes_text_gate("SELECT a FROM t OFFSET 1")
    assert contains_scan(numbers) and contains_scan(numbers.groupBy("k").count())


def test_wide_integers(spark):
    values = [str(x) for x in (-(1 << 127), -1, -10, 0, 7, (1 << 127) - 1)]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", types.wide_text(F.col("v")).alias("w"))
    assert [r["v"] for r in df.orderBy("w").collect()] == sorted(values, key=int)
    assert [r[0] for r in df.select(types.wide_number(F.col("w"))).collect()] == values
    for bad, signed in ((str(1 << 127), True), ("-1", False), (str(1 << 128), False)):
        with pytest.raises(Exception, match="out of range"):
            spark.createDataFrame([(bad,)], "v string").select(types.wide_text(F.col("v"), signed)).collect()


def test_type_names():
    assert types.spark_type("INTEGER[]").simpleString() == "array<int>"
    assert types.spark_type("decimal(10,2)").simpleString() == "decimal(10,2)"
    assert types.spark_type("UBIGINT").simpleString() == "decimal(20,0)"
    with pytest.raises(ValueError):
        types.spark_type("NO SUCH TYPE")


def test_times_and_intervals(spark):
    df = spark.createDataFrame([("23:59:59.999999",), ("00:00:00",), ("12:30:45.5",)], "t string").select("t", types.time_micros(F.col("t")).alias("m"))
    assert [r["m"] for r in df.collect()] == [86_399_999_999, 0, 45_045_500_000]
    assert [r[0] for r in df.select(types.time_text(F.col("m"))).collect()] == ["23:59:59.999999", "00:00:00", "12:30:45.500000"]
    assert spark.range(1).select(types.interval_micros(types.interval(months=1)) == types.interval_micros(types.interval(days=30))).first()[0]


def test_lists(spark):
    df = spark.createDataFrame([([1, 2],), ([],), (None,), ([1, None],)], "l array<int>")
    assert [tuple(r) for r in df.select(fn.list_len("l"), fn.list_get("l", 2), fn.list_get("l", 9), fn.list_contains("l", 1), fn.list_contains("l", 5)).collect()] == [(2, 2, None, True, False), (0, None, None, False, False), (None,) * 5, (2, None, None, True, False)]


def test_enums(spark):
    labels = ["low", "mid", "high"]
    df = spark.createDataFrame([("high",), (None,), ("low",), ("mid",)], "e string")
    assert [r[0] for r in df.orderBy(fn.enum_order("e", labels)).collect()] == ["low", "mid", "high", None]
    assert [r[0] for r in df.orderBy(fn.enum_order("e", labels, True)).collect()] == ["high", "mid", "low", None]
    assert tuple(df.agg(fn.enum_min("e", labels), fn.enum_max("e", labels)).first()) == ("low", "high")


def test_asof_takes_the_last_row_at_or_before(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9), (None, 3)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("b", 10, 1)], "k string, t int, v int")
    got = {(r["k"], r["t"]): r["v"] for r in joins.asof_join(left, right, ["k"], "t", "t", ["v"]).collect()}
    assert got == {("a", 5): 50, ("a", 1): None, ("b", 9): None, (None, 3): None}


def test_interval_join_equals_the_plain_one(spark):
    points = spark.range(300).select((F.col("id") * 0.7).alias("x"))
    spans = spark.range(40).select(F.col("id").alias("s"), (F.col("id") * 5.0).alias("lo"), (F.col("id") * 5.0 + F.col("id") % 9).alias("hi"))
    want = points.join(spans, (F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi")))
    got = joins.interval_join(points, spans, "x", "lo", "hi", 4.0)
    assert sorted(map(tuple, got.select("x", "s").collect())) == sorted(map(tuple, want.select("x", "s").collect()))


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_files(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    sources.write(df, f"file://{tmp_path}/t", fmt)
    assert sorted(map(tuple, sources.scan(spark, f"file://{tmp_path}/t", ["i", "s"], "i < 5", fmt, "i int, s string").collect())) == [(1, "a"), (2, None)]


def test_pages_and_missing_tables(spark):
    df = spark.range(10).toDF("i")
    assert [r[0] for r in sources.page(df, ["i"], 3, 4).collect()] == [4, 5, 6]
    assert sources.table_or_empty(spark, "none_such", "a int").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    events = spark.createDataFrame([(i, at + datetime.timedelta(hours=i), i % 3, "view" if i % 2 else "click", float(i), "{}") for i in range(60)], streaming.EVENTS)
    events.coalesce(1).write.parquet(f"file://{tmp_path}/events")
    q = streaming.windowed(streaming.read_events(spark, f"file://{tmp_path}/events")).writeStream.format("memory").queryName("windowed").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = streaming.windowed(spark.read.parquet(f"file://{tmp_path}/events").withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(str, spark.table("windowed").collect())) == sorted(map(str, batch.collect()))
