"""The sinks' store: every event once over batches, runs, queries and days; merging, clean-up, and what a batch reads."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tickloom.operators import candles as cd
from tickloom.operators import quality as ql
from tickloom.plans import fixtures as fx
from tickloom.streaming import jobs
from tickloom.streaming.store import Store

SIZES = {"buckets": 4, "fan": 3}
LATEST = ("symbol", ["arrival", "event_id"], ["price"])


@pytest.fixture(scope="module")
def quotes(spark, sf_dir):
    q = fx.quotes(spark, sf_dir).select("symbol", "provider_timestamp", "event_id", "price", "arrival")
    return q.withColumn("provider_timestamp", F.col("provider_timestamp").cast("timestamp")).cache()


def candles(rows):
    return {(r.symbol, r.open_time): (r.open, r.high, r.low, r.close, r.n) for r in rows.collect()}


def test_every_event_once_over_batches_and_checkpoints(spark, quotes, tmp_path):
    """Redelivery in other batches, batches that run again, and a new checkpoint on an old target; as many merges on the way."""
    sinks = {"a": jobs.archive_batch(str(tmp_path / "a"), **SIZES), "r": jobs.append_new(str(tmp_path / "r"), ["event_id"], ["arrival"], **SIZES), "l": jobs.keep_latest(str(tmp_path / "l"), *LATEST, **SIZES)}
    parts = [quotes.filter("event_id % 2 = 0"), quotes.filter("event_id % 3 = 0"), quotes.filter("event_id % 5 = 0")]
    for sink in sinks.values():
        for n in (0, 1, 1, 2):
            sink(parts[n], n)
    for run, part in enumerate((quotes.filter("event_id % 7 = 0"), quotes)):  # two queries with checkpoints of their own, both from batch 0
        part.repartition(2).write.parquet(str(tmp_path / f"in{run}"))
        for name, sink in sinks.items():
            stream = spark.readStream.schema(quotes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"in{run}"))
            jobs.run_available(stream, str(tmp_path / f"cp{run}{name}"), sink)
    assert candles(jobs.read_archive(spark, str(tmp_path / "a"))) == candles(cd.candles_1m(quotes))
    kept = jobs.read_new(spark, str(tmp_path / "r"), ["event_id"])
    assert kept.count() == kept.select("event_id").distinct().count() == quotes.count()
    newest = {r.symbol: r.event_id for r in jobs.latest_table(spark, str(tmp_path / "l"), *LATEST).collect()}
    assert newest == {r.symbol: r.event_id for r in ql.latest(quotes, "symbol", ["arrival", "event_id"], ["event_id"]).collect()}
    for name in sinks:
        queries = Store(spark, str(tmp_path / name)).last_batches()
        assert len(queries) == 3 and queries["direct"] == 2


def row(i, at, price, symbol="AAPL"):
    return (symbol, at, i, price)


SCHEMA = "symbol string, provider_timestamp timestamp, event_id string, price decimal(18,2)"


def test_out_of_order_candles_and_redelivery_on_another_day(spark, tmp_path):
    from decimal import Decimal

    t = dt.datetime(2024, 8, 4, 10, 0)
    events = [row("3", t + dt.timedelta(seconds=40), Decimal(101)), row("2", t + dt.timedelta(seconds=5), Decimal(100)), row("1", t + dt.timedelta(seconds=20), Decimal(105)), row("4", t + dt.timedelta(minutes=2), Decimal(98))]
    again = [row("1", t + dt.timedelta(days=1), Decimal(999))]  # the same event with another time
    sink = jobs.archive_batch(str(tmp_path / "a"), **SIZES)
    for n, part in enumerate([events[:1], events[1:2], events[2:3], events[2:3], events[3:], again]):
        sink(spark.createDataFrame(part, SCHEMA), n)
    got = sorted(candles(jobs.read_archive(spark, str(tmp_path / "a"))).values(), key=lambda r: r[4], reverse=True)
    assert [tuple(map(int, r)) for r in got] == [(100, 105, 100, 101, 3), (98, 98, 98, 98, 1)]


def test_first_row_by_order_nulls_and_empty_batches(spark, tmp_path):
    schema = "k string, d int, n long"
    sink = jobs.append_new(str(tmp_path / "r"), ["k", "d"], ["n"], **SIZES)
    assert jobs.read_new(spark, str(tmp_path / "r"), ["k", "d"]) is None
    batches = [[], [("a", 1, 5), ("a", 1, 2), (None, 1, 7)], [("a", 1, 1), (None, 1, 1), (None, None, 3), ("b", None, 4)], [], [("b", None, 0), ("c", 0, 2**53 + 1)]]
    for n, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, schema), n)
    got = sorted((tuple(r) for r in jobs.read_new(spark, str(tmp_path / "r"), ["k", "d"]).collect()), key=str)
    assert got == sorted([("a", 1, 2), (None, 1, 7), (None, None, 3), ("b", None, 4), ("c", 0, 2**53 + 1)], key=str)


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    """New keys are told by the filters alone; keys of one bucket read that bucket's folders."""
    store = Store(spark, str(tmp_path / "s"), ["k"], buckets=16, fan=100)
    for n in range(4):
        store.commit(spark.range(n * 1000, (n + 1) * 1000).select(F.col("id").alias("k")), n, "q")
    asked = []
    kept = store._kept
    store._kept = lambda what, commits, schema, buckets: asked.append((what, len(buckets))) or kept(what, commits, schema, buckets)
    known = spark.createDataFrame([(17,)], "k long")
    assert store.fresh(known).count() == 0 and asked == [("filters", 1), ("keys", 1)]
    asked.clear()
    new = spark.range(10_000, 10_100).select(F.col("id").alias("k"))
    assert store.fresh(new).count() == 100 and [w for w, _ in asked][0] == "filters"
    bits = spark.read.parquet(*[str(p) for p in (tmp_path / "s" / "filters").iterdir()]).selectExpr("sum(length(bits)) AS n").first().n
    assert bits < 4000 * 2, "filters are a fraction of the keys"
    plan = store._kept("keys", store._live(store._entries()), "k long, _h1 long, _h2 long, _bucket long", [3])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "_bucket" in plan.split("PartitionFilters")[1][:120]


def test_merges_and_clean_up(spark, tmp_path):
    """Nine commits by threes are one; replaced folders go with a later merge or the vacuum, and so does what no line names."""
    store = Store(spark, str(tmp_path / "s"), ["k"], buckets=2, fan=3)
    for n in range(9):
        assert store.commit(spark.createDataFrame([(n,)], "k long"), n, "q")
    assert [e["level"] for e in store._live(store._entries())] == [2]
    assert len(list((tmp_path / "s" / "rows").iterdir())) < 6
    (tmp_path / "s" / "rows" / "left-behind").mkdir()
    store.vacuum()
    assert [len(list((tmp_path / "s" / what).iterdir())) for what in ("rows", "keys", "filters", "manifest")] == [1, 1, 1, 1]
    assert not store.commit(spark.createDataFrame([(99,)], "k long"), 8, "q") and store.commit(spark.createDataFrame([(99,)], "k long"), 0, "other")
    assert sorted(r.k for r in store.read().collect()) == [*range(9), 99]
    assert store.fresh(spark.createDataFrame([(5,), (100,)], "k long")).collect()[0].k == 100


def test_a_run_that_ends_before_its_line_is_written_leaves_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), ["k"], **SIZES)
    store.commit(spark.createDataFrame([(1,)], "k long"), 0, "q")
    spark.createDataFrame([(2,)], "k long").write.parquet(f"{store.target}/rows/unfinished")
    assert [r.k for r in store.read().collect()] == [1] and store.commit(spark.createDataFrame([(2,)], "k long"), 1, "q")
    assert sorted(r.k for r in store.read().collect()) == [1, 2] and Path(f"{store.target}/rows/unfinished").exists()
