"""Counters with resets, latency of a histogram's last minutes, and the backlog of a log with redeliveries."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.operators import metrics as mt

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("width", [300, 86_400])
def test_increase_over_the_last_minutes(spark, width):
    rng, rows, total = random.Random(3), [], defaultdict(int)
    for i in range(240):
        for series in ("a", "b"):
            total[series] = 0 if rng.random() < 0.05 else total[series] + rng.randrange(5)
            rows.append((series, T0 + dt.timedelta(seconds=15 * i + (rng.random() if series == "b" else 0)), None if rng.random() < 0.05 else total[series]))
    df = spark.createDataFrame(rows, "series string, at timestamp_ntz, c long")
    got = {(r.series, r.at): r.c_increase for r in mt.counter_increase(df, ["series"], "at", ["c"], 300, width).collect()}
    assert len(got) == len(rows)
    for series in ("a", "b"):
        mine, rises, last = sorted(r[1:] for r in rows if r[0] == series), [], None
        for at, c in mine:
            rises.append((at, 0 if c is None or last is None else c if c < last else c - last))
            last = c if c is not None else last
        for at, _ in mine:
            inside = [x for t, x in rises if at - dt.timedelta(seconds=300) <= t <= at]
            assert got[series, at] == sum(inside[1:])


def test_latency_quantile(spark):
    bounds = {"b0": 0.1, "b1": 0.5, "b2": float("inf")}
    rows = [(1, 90, 100, 100), (2, 0, 100, 100), (3, 0, 0, 0), (4, 10, 20, 100), (5, 100, 100, 100)]
    df = spark.createDataFrame(rows, "at int, b0 long, b1 long, b2 long")
    got = {r.at: r.value and round(r.value, 9) for r in mt.latency_quantile(df, [], "at", bounds).collect()}
    assert got == {1: 0.3, 2: 0.48, 3: None, 4: 0.5, 5: 0.095}


def test_backlog_counts_an_entry_once(spark):
    """Redelivered, claimed and acked again: one entry; the oldest open one is found by the first gap."""
    at = lambda s: T0 + dt.timedelta(seconds=s)
    log = spark.createDataFrame([(i, at(10 * i)) for i in range(5)], "entry_id long, entered_at timestamp_ntz")
    rows = [("a", 0, None, "x"), ("a", 0, at(1), "y"), ("a", 0, at(2), "y"), ("a", 1, at(1), "x"), ("a", 99, at(1), "z"), ("b", 0, at(1), "x"), ("b", 2, None, "x")] + [("c", i, at(1), "x") for i in range(5)]
    acks = spark.createDataFrame(rows, "`group` string, entry_id long, acked_at timestamp_ntz, consumer string")
    groups = spark.createDataFrame([("a",), ("b",), ("c",), ("none",)], "`group` string")
    out = mt.consumer_backlog(log, acks, groups, 4, F.lit(T0 + dt.timedelta(seconds=100)), "consumer").collect()
    got = {r.group: (r.pending, r.undelivered, r.backlog, r.headroom, r.consumers, r.group_present, r.oldest_age_seconds) for r in out}
    assert got == {"a": (0, 3, 3, 1, 3, True, 80), "b": (1, 3, 4, 0, 1, True, 90), "c": (0, 0, 0, 4, 1, True, 0), "none": (0, 5, 5, 0, 0, False, 100)}
