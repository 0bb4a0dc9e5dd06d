"""Running values by slices, order statistics by ranges and interval joins against plain loops, with one busy key."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.operators import metrics as mt
from tickloom.operators.intervals import interval_join
from tickloom.operators.scan import islands, last_before, running_count, running_max, running_sum, scan

T0 = dt.datetime(2024, 1, 20)


def rows_of(n=400, seed=5):
    rng = random.Random(seed)
    keys = [None, "a", "b"] + ["hot"] * 9
    return [(rng.choice(keys), rng.choice([None, *range(60)]) if rng.random() < 0.1 else rng.randrange(60), i, None if rng.random() < 0.2 else rng.randrange(-9, 99)) for i in range(n)]


@pytest.mark.parametrize("width", [1, 7, 1_000_000])
def test_scan(spark, width):
    rows = rows_of()
    df = spark.createDataFrame(rows, "k string, at long, i long, v long")
    added = {"most": running_max("v"), "so_far": running_max("v", True), "total": running_sum("v", True), "n": running_count(), "last": last_before("v"), "own": last_before("v", True)}
    got = {r.i: r for r in scan(df, ["k"], ["at", "i"], added, width).collect()}
    assert len(got) == len(rows)
    seen = defaultdict(list)
    for k, at, i, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        there = [x for x in seen[k] if x is not None]
        own = there + ([v] if v is not None else [])
        want = (max(there, default=None), max(own, default=None), sum(own) if own else None, len(seen[k]), there[-1] if there else None, own[-1] if own else None)
        assert tuple(got[i][c] for c in added) == want and (got[i].k, got[i].at, got[i].v) == (k, at, v)
        seen[k].append(v)


def test_one_key_is_many_tasks(spark):
    """No partition of the window holds more than a slice of the busy key."""
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("at"), F.col("id").alias("v"))
    names = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("false", "16"), strict=True):
        spark.conf.set(n, v)
    try:
        sizes = scan(df, ["k"], ["at"], {"m": running_max("v")}, 500).select(F.spark_partition_id().alias("p"), "m").groupBy("p").agg(F.count("*").alias("count"), F.max("m")).collect()
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    assert sum(r["count"] for r in sizes) == 20_000 and max(r["count"] for r in sizes) < 8_000 and len(sizes) > 8


@pytest.mark.parametrize("width", [3, 1_000_000])
def test_islands(spark, width):
    rows = rows_of(seed=6)
    df = spark.createDataFrame(rows, "k string, at long, i long, v long")
    got = {r.i: (r.run, r.run_on) for r in islands(df, ["k"], ["at", "i"], F.col("v") > 40, "run", width).collect()}
    state = defaultdict(lambda: (0, False))
    for k, _, i, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        n, on = state[k]
        now = v is not None and v > 40
        state[k] = (n + (now != on), now)
        assert got[i] == state[k]


@pytest.mark.parametrize("values", ["few", "skewed", "decimal", "beyond doubles"])
def test_order_statistics(spark, values):
    rng = random.Random(values)
    draw = {"few": lambda: rng.randrange(5), "skewed": lambda: int(10 ** rng.uniform(0, 15)), "decimal": lambda: rng.randrange(10**6), "beyond doubles": lambda: 2**60 + rng.randrange(40)}[values]
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), None if rng.random() < 0.1 else draw()) for _ in range(1500)] + [("one", 7), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v long")
    if values == "decimal":
        df = df.withColumn("v", (F.col("v") / 100).cast("decimal(18,2)"))
    qs = (0.0, 0.5, 0.95, 1.0)
    got = {r.k: tuple(r)[1:] for r in mt.nearest_rank(df, ["k"], "v", qs, ranges=32, most=20).collect()}
    have = defaultdict(list)
    for r in df.filter("v IS NOT NULL").collect():
        have[r.k].append(r.v)
    assert got == {k: tuple(sorted(v)[round((len(v) - 1) * q)] for q in qs) for k, v in have.items()} and "none" not in got


@pytest.mark.parametrize("rows", [100_000, 10])
def test_interval_join(spark, rows):
    """Instants at the ends of intervals, long and short ones, a busy key dealt to several tasks, nulls and repeated rows."""
    rng = random.Random(7)
    at = lambda s: T0 + dt.timedelta(seconds=s)
    symbols = ["A", "A", "A", "A", "B", None]
    quotes = [(rng.choice(symbols), at(rng.choice([rng.randrange(0, 4_000_000, 60), rng.uniform(0, 4_000_000)])), i) for i in range(300)] + [("A", None, 1000), ("A", at(60), 1001), ("A", at(60), 1001)]
    held = [(rng.choice(symbols), a := at(rng.randrange(0, 4_000_000, 30)), a + dt.timedelta(seconds=rng.choice([1, 60, 3600, 100_000, 2_000_000])), i) for i in range(120)]
    held += [("A", at(60), at(60), 500), ("A", at(90), at(60), 501), ("A", None, at(60), 502), ("A", at(60), at(61), 503), ("A", at(0), at(60), 504), ("A", at(0), at(40_000_000), 505)]
    q = spark.createDataFrame(quotes, "symbol string, at timestamp_ntz, event_id long")
    h = spark.createDataFrame(held, "symbol string, start timestamp_ntz, expires timestamp_ntz, connection long")
    got = sorted((r.event_id, r.connection) for r in interval_join(q, h, ["symbol"], "at", "start", "expires", rows=rows).collect())
    want = sorted((i, c) for s, t, i in quotes for x, a, b, c in held if s is not None and s == x and t is not None and a is not None and a <= t < b)
    assert got == want and len(want) > 300


def test_intervals_are_few_cells(spark):
    """A year of seconds in minutes is no more than a few hundred cells, and covers each minute once."""
    from tickloom.operators.intervals import _cells

    for first, last in ((0, 0), (5, 4_000), (31, 33), (32, 63), (17, 525_600), (-70, 700)):
        got = spark.range(1).select(_cells(F.lit(first).cast("long"), F.lit(last).cast("long"), 32, 4).alias("c")).first().c
        covered = sorted(m for c in got for m in range(c._cell * 32**c._level, (c._cell + 1) * 32**c._level))
        assert covered == list(range(first, last + 1)) and len(got) < 4 * 62 + 20


def test_interval_join_moves_little(spark):
    """Intervals of minutes, days, years and without an end, from before 1970 on: the rows of a plain join, and few bytes on the disk."""
    n = 5_000
    minutes = "CASE WHEN event_id % 500 = 0 THEN 3000000000 WHEN event_id % 250 = 0 THEN 3000000 WHEN event_id % 50 = 0 THEN 5000 ELSE 1 + event_id % 100 END"
    q = spark.range(n).selectExpr("id AS event_id", "concat('PURCHASE', id % 5) AS symbol", "timestamp_ntz'1969-12-20 00:00:07' + make_dt_interval(0, 0, 0, id * 518.4) AS at")
    h = q.selectExpr("event_id AS connection", "symbol", "at AS start", f"CAST(timestamp_micros(unix_micros(timestamp(at)) + 60000000 * ({minutes})) AS timestamp_ntz) AS expires")

    def written():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        executors = context.statusStore().executorList(True)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("event_id", "connection").cast("decimal(38,0)"))).first()
    want = total(q.join(h, "symbol").filter("start <= at AND at < expires"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        start = written()
        got = total(interval_join(q, h, ["symbol"], "at", "start", "expires"))
        moved = written() - start
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert tuple(got) == tuple(want) and got[0] > 2 * n
    assert 20 * n < moved < 400 * n, moved / n
