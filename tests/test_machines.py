"""Folds and state machines: whole numbers, deadlines, and streams that equal tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import fanout as fo
from tickloom.operators import ledger as lg
from tickloom.operators import machines as ma
from tickloom.operators.fold import keyed_fold
from tickloom.streaming.stateful import machine_stream

T0 = dt.datetime(2024, 1, 20, 12, 0, 0)
BIG = 2**53


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture(params=[1, 3, 10_000])
def batches(spark, request):
    """Arrow batches of this many rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(request.param))
    yield request.param
    spark.conf.set(key, before)


def test_fold_keeps_whole_numbers(spark, batches):
    rows = [("a", i, None if i % 3 == 1 else BIG + i) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, i long, n long")

    def step(state, row):
        total = (state or 0) + (row["n"] or 0)
        return total, (total, str(row["n"]))

    got = keyed_fold(df, ["k"], ["i"], step, {"total": "long", "seen": "string"})
    total = 0
    for r in got.orderBy("i").collect():
        total += r.n or 0
        assert (r.k, r.i, r.n) == rows[r.i] and r.total == total and r.seen == str(rows[r.i][2])


def test_ledger_hashes_do_not_depend_on_batches(spark, batches):
    df = spark.createDataFrame([("a", i, None if i == 2 else BIG + i) for i in range(6)], "ledger string, arrival long, sequence long")
    built = lg.build_ledger(df, "ledger", ["arrival"], ["sequence"]).orderBy("arrival").collect()
    assert [f'"sequence":{BIG + i}' in r.value if i != 2 else '"sequence":null' in r.value for i, r in enumerate(built)] == [True] * 6
    alone = lg.build_ledger(df.filter("arrival < 2"), "ledger", ["arrival"], ["sequence"]).orderBy("arrival").collect()
    assert [r.record_hash for r in alone] == [r.record_hash for r in built[:2]]


def test_throttle_sends_the_last_one_by_its_deadline(spark):
    times = [0, 0.2, 0.9, 1.0, 1.5, 5, 5.999999, 9, 9.5]
    df = spark.createDataFrame([("c", at(s), i, 1.0) for i, s in enumerate(times)], "client string, at timestamp_ntz, arrival long, interval_seconds double")
    got = [(r.sent_at, r.replaced) for r in fo.conflate_latest(df, ["client"], "at").orderBy("arrival").collect()]
    none = (None, True)
    assert got == [(at(0), False), none, (at(1), False), none, (at(2), False), (at(5), False), (at(6), False), (at(9), False), (at(10), False)]


def test_bucket_with_cost_burst_and_tier(spark):
    """The bucket of 10 for 60 a minute; a cost of 4 is refused without taking anything; a burst of its own; no rate, no admission."""
    rows = [("c", at(0), 1, 6, None), ("c", at(0), 2, 5, None), ("c", at(0), 3, 4, None), ("c", at(3), 4, 3, None), ("d", at(0), 5, None, 2), ("d", at(0), 6, 2, 2)]
    df = spark.createDataFrame(rows, "client string, ts timestamp_ntz, event_id long, cost long, burst long")
    got = {r.event_id: (r.allowed, round(r.remaining, 6)) for r in fo.token_bucket(df, "client", "ts", 60, "cost", "burst").collect()}
    assert got == {1: (True, 4.0), 2: (False, 4.0), 3: (True, 0.0), 4: (True, 0.0), 5: (True, 1.0), 6: (False, 1.0)}
    assert not fo.token_bucket(df, "client", "ts", 0).filter("allowed OR remaining > 0").count()
    tiers = df.withColumn("tier", F.when(F.col("client") == "c", "basic").otherwise("premium"))
    limits = {r.tier: r.rpm for r in fo.policies(spark).collect()}
    by_tier = fo.token_bucket(fo.with_policy(tiers), "client", "ts", "rpm").groupBy("tier").agg(F.max("remaining").alias("r")).collect()
    assert {r.tier: r.r for r in by_tier} == {t: float(max(5, -(-limits[t] // 6)) - 1) for t in ("basic", "premium")}


def test_leases(spark):
    """A refused connection holds no place; heartbeats renew, late ones do not; releases and expiry give places back."""
    log = [(0, "acquire", "a"), (1, "acquire", "b"), (2, "acquire", "c"), (30, "heartbeat", "a"), (61, "acquire", "c"), (61, "heartbeat", "b"), (62, "release", "c"), (62, "release", "c"), (63, "acquire", "d"), (64, "acquire", "a"), (125, "acquire", "e")]
    df = spark.createDataFrame([("x", at(s), i, e, c) for i, (s, e, c) in enumerate(log)], "client string, at timestamp_ntz, n long, event string, connection_id string")
    got = [(r.allowed, r.connections) for r in fo.connection_leases(df, "client", "at", ["n"], 2).orderBy("n").collect()]
    assert got == [(True, 1), (True, 2), (False, 2), (True, 2), (True, 2), (False, 2), (True, 1), (False, 1), (True, 2), (True, 2), (True, 1)]
    tiered = fo.connection_leases(df.withColumn("tier", F.lit("basic")), "client", "at", ["n"])
    assert tiered.filter("connections > max_connections").count() == 0


def test_failures_are_forgotten(spark):
    from tickloom.operators import quality as ql

    times = [0, 10, 3609, 7209, 7210, 7211]
    df = spark.createDataFrame([("e", at(s), i) for i, s in enumerate(times)], "entry string, at timestamp_ntz, n long")
    got = [(r.n, r.retries) for r in ql.exhausted_within(df, ["entry"], "at", ["n"]).collect()]
    assert got == [(2, 3), (5, 3)], "3600 s after the third the count starts again"


def test_guard_forgets_the_oldest_ids_and_may_refuse_resets(spark):
    rows = [("p", i, str(e), 1, at(0), None) for i, e in enumerate([0, 1, 2, 3, 0, 3, 2])]
    schema = "provider string, arrival long, event_id string, generation long, provider_timestamp timestamp_ntz, sequence long"
    got = ma.run_machine(spark.createDataFrame(rows, schema), ["provider"], "provider_timestamp", ["arrival"], ma.TemporalGuard(3), arrival=True)
    assert [r.outcome for r in got.orderBy("arrival").collect()] == ["accepted"] * 5 + ["duplicate"] * 2
    later = spark.createDataFrame([("p", 0, "a", 1, at(0), 9), ("p", 1, "b", 2, at(0), 5)], schema)
    for resets, reason in ((True, "generation_advanced"), (False, "sequence_regression")):
        out = ma.run_machine(later, ["provider"], "provider_timestamp", ["arrival"], ma.TemporalGuard(resets=resets), arrival=True)
        assert out.orderBy("arrival").collect()[1].reason == reason


def machines():
    return {
        "throttle": ma.Throttle("gap"), "window": ma.WindowLimit("most", 5), "bucket": ma.TokenBucket("rpm", "cost"), "leases": ma.Connections("most", 6), "first": ma.FirstWithin(4), "failures": ma.FailureCount(3, 2),
    }


@pytest.mark.parametrize("name", list(machines()))
def test_stream_equals_table(spark, tmp_path, name):
    """Rows that arrive in any order within the watermark's lateness, over two runs of one checkpoint, give what the table gives;
    what only a deadline finishes comes without a further row of its key."""
    rng = random.Random(name)
    rows = [(f"k{rng.randrange(5)}", at(round(rng.uniform(0, 90), 6)), BIG + i, None if rng.random() < 0.3 else BIG + rng.randrange(9), 1.5, 2, 60, rng.randrange(1, 4), rng.choice(["acquire", "acquire", "heartbeat", "release"]), f"c{rng.randrange(4)}") for i in range(300)]
    schema = "k string, at timestamp, id long, note long, gap double, most long, rpm long, cost long, event string, connection_id string"
    df = spark.createDataFrame(rows, schema)
    late = sorted(rows, key=lambda r: (r[1] + dt.timedelta(seconds=rng.uniform(0, 20))))  # arrives up to 20 s late
    end = [("end", at(s), BIG + 1000 + s, None, 1.5, 2, 60, 1, "acquire", "z") for s in (200, 400)]
    for n, part in enumerate((late[:150], late[150:], end[:1], end[1:])):  # a run each
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = machine_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["k"], "at", ["id"], machines()[name], "40 seconds")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).filter("k <> 'end'").collect()))
    want = sorted(map(str, ma.run_machine(df, ["k"], "at", ["id"], machines()[name]).collect()))
    assert got == want and len(got) == 300
