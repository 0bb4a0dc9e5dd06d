"""Counters, histograms, percentiles, rates, backlog, outages and alerts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.scan import islands, last_before, running_count, scan
from tickloom.plans.lineage import cut

#: Upper bounds in seconds of the latency histogram.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)


def histogram(rows: DataFrame, keys: list[str], value: str, bounds: tuple[float, ...] = LATENCY_BOUNDS) -> DataFrame:
    """Cumulative counts of each bound: one sum a bound in one pass, then a row a bound."""
    counts = rows.groupBy(*keys).agg(F.count(value).alias("total"), *[F.sum((F.col(value) <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(bounds)])
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)])
    return counts.select(*keys, "total", F.inline(pairs))


def histogram_quantile(hist: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Quantile by linear interpolation inside the first bound that reaches it; the last bound if none does."""
    w = Window.partitionBy(*keys).orderBy("le")
    rows = hist.withColumn("_low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("_before", F.coalesce(F.lag("n").over(w), F.lit(0)))
    rank = F.lit(q) * F.col("total")
    inside = F.col("_low") + (F.col("le") - F.col("_low")) * F.try_divide(rank - F.col("_before"), F.col("n") - F.col("_before"))
    rows = rows.withColumn("_value", F.when(F.col("n") >= rank, inside))
    return rows.groupBy(*keys).agg(F.coalesce(F.min_by("_value", F.when(F.col("_value").isNotNull(), F.col("le"))), F.max("le")).alias("value"))


#: Value ranges that a key's values are counted by at once, and the rows of a range that one task may sort.
RANGES, RANGE_ROWS = 256, 100_000


def nearest_rank(rows: DataFrame, keys: list[str], value: str, qs: tuple[float, ...], ranges: int = RANGES, most: int = RANGE_ROWS) -> DataFrame:
    """Exact percentiles at index round((n - 1) q), half to even; null values do not count.

    Values are counted by ranges between a key's least and greatest; the range that holds the rank is cut again until it has at
    most `most` rows or one value. Only those rows are sorted, so no key is sorted in one task.
    """
    values = rows.filter(F.col(value).isNotNull()).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).alias("_v"))
    named = [f"_k{i}" for i in range(len(keys))]
    targets = F.array(*[F.struct(F.lit(i).alias("_q"), F.bround((F.col("_n") - 1) * F.lit(q)).cast("long").alias("_rank")) for i, q in enumerate(qs)])
    wanted = values.groupBy(*named).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).select("*", F.inline(targets))
    lo, hi, v = (F.col(c).cast("double") for c in ("_lo", "_hi", "_v"))

    def inside(of: DataFrame) -> DataFrame:
        """The values of each wanted range, with its bounds."""
        there = of.select(*[F.col(k).alias(f"{k}_") for k in named], "_q", "_rank", "_lo", "_hi")
        same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in named]
        return values.join(there, [*same, F.col("_v").between(F.col("_lo"), F.col("_hi"))]).drop(*[f"{k}_" for k in named])

    done = []
    while True:
        wanted = cut(wanted)  # a row for each key and percentile
        wide = wanted.filter((F.col("_n") > most) & (lo < hi))
        if not wide.limit(1).count():
            break
        done.append(wanted.filter(~((F.col("_n") > most) & (lo < hi))))
        place = F.least(F.floor((v - lo) / (hi - lo) * ranges), F.lit(ranges - 1))
        counts = inside(wide).groupBy(*named, "_q", "_rank", place.alias("_cut")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*named, "_q").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = counts.withColumn("_rank", F.col("_rank") - before).filter((F.col("_rank") >= 0) & (F.col("_rank") < F.col("_n")))
        wanted = held.select(*named, "_n", "_lo", "_hi", "_q", "_rank")
    found = reduce(DataFrame.unionByName, done, wanted)
    order = F.row_number().over(Window.partitionBy(*named, "_q").orderBy("_v"))
    sorted_ = inside(found.filter("_lo <> _hi")).withColumn("_r", order - 1).filter("_r = _rank").select(*named, "_q", "_v")
    both = found.filter("_lo = _hi").select(*named, "_q", F.col("_lo").alias("_v")).unionByName(sorted_)
    out = both.groupBy(*named).agg(*[F.max(F.when(F.col("_q") == i, F.col("_v"))).alias(f"p{round(q * 100)}") for i, q in enumerate(qs)])
    return out.withColumnsRenamed(dict(zip(named, keys, strict=True)))


def throughput(rows: DataFrame, at: str, keys: list[str], seconds: int, slide: int, size: Column | None = None) -> DataFrame:
    """Rows a second in sliding windows; with `size` (bytes of a row) also bytes and bytes a second."""
    w = F.window(F.col(at), f"{seconds} seconds", f"{slide} seconds")
    sums = [F.count("*").alias("n")] if size is None else [F.count("*").alias("n"), F.sum(size).alias("bytes")]
    rates = [(F.col(c) / seconds).alias(name) for c, name in (("n", "per_second"), ("bytes", "bytes_per_second"))][: len(sums)]
    counted = rows.groupBy(*keys, w.alias("_w")).agg(*sums)
    return counted.select(*keys, F.col("_w.start").alias("window_start"), *counted.columns[len(keys) + 1 :], *rates)


def run_rates(rows: DataFrame, run: str, at: str, size: Column) -> DataFrame:
    """Messages and bytes of each run, its seconds, and both a second (null for runs that took no time)."""
    out = rows.groupBy(run).agg(F.count("*").alias("messages"), F.sum(size).alias("bytes"), F.min(at).alias("_a"), F.max(at).alias("_b"))
    out = out.withColumn("seconds", (F.unix_micros(F.col("_b").cast("timestamp")) - F.unix_micros(F.col("_a").cast("timestamp"))) / 1e6)
    return out.select(run, "messages", "bytes", "seconds", F.try_divide("messages", "seconds").alias("messages_per_second"), F.try_divide("bytes", "seconds").alias("bytes_per_second"))


def counts_by(rows: DataFrame, key: str, by: str, name: str) -> DataFrame:
    """A map of counts by the values of a column of few values (channels, error types), for each key."""
    per = rows.filter(F.col(by).isNotNull()).groupBy(key, by).agg(F.count("*").alias("_n"))
    return per.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(by, "_n")))).alias(name))


def session_diagnostics(rows: DataFrame, session: str, channel: str, at: str, projected: Column | None = None, error: str | None = None, ack: str | None = None) -> DataFrame:
    """Messages, channels, first and last time and the longest silence of each session.

    With `projected` (which messages became events): their number and longest silence, and messages by channel; with `error` and
    `ack`, columns that name a reject's type and an acknowledged channel: counts by these.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    sums = [F.count("*").alias("messages"), F.countDistinct(channel).alias("channels"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.max("_gap").alias("max_gap_micros")]
    mine = F.when(F.lit(False) if projected is None else projected, micros)
    out = scan(rows, [session], [at, "event_id"], {"_last": last_before(micros), "_last_own": last_before(mine)}).withColumn("_gap", micros - F.col("_last"))
    if projected is not None:
        out = out.withColumn("_own", mine - F.col("_last_own"))
        sums += [F.count_if(projected).alias("projected"), F.max("_own").alias("max_projected_gap_micros")]
    out = out.groupBy(session).agg(*sums)
    maps = ([(channel, "by_channel")] if projected is not None else []) + [(c, n) for c, n in ((error, "rejects"), (ack, "acks")) if c]
    for by, name in maps:
        out = out.join(counts_by(rows, session, by, name), session, "left")
    return out


def consumer_backlog(log: DataFrame, acks: DataFrame, groups: DataFrame, maxlen: int, now: Column | None = None, consumer: str | None = None) -> DataFrame:
    """Pending, undelivered, backlog, its share of maxlen and the headroom of each group; a group without rows has seen nothing.

    `acks` has a row for each delivery, claim or acknowledgement (acked_at) of an entry: however often one is delivered or acked,
    it counts once. Rows of entries that the log no longer has do not count. With `now`, and entered_at in the log: group_present,
    and the age in seconds of the oldest entry not acked (0 if none). With `consumer`, a column of `acks`: consumers.
    """
    total = log.agg(F.count("*").alias("entries"))
    once = acks.groupBy("group", "entry_id").agg(F.max("acked_at").alias("acked_at"))
    mine = once.join(log.select("entry_id"), "entry_id", "left_semi")
    seen = mine.groupBy("group").agg(F.count("*").alias("delivered"), F.count("acked_at").alias("acked"))
    out = groups.join(seen, "group", "left").withColumn("group_present", F.col("delivered").isNotNull())
    out = out.crossJoin(F.broadcast(total)).na.fill(0, ["delivered", "acked"])  # total is one row
    out = out.withColumn("pending", F.col("delivered") - F.col("acked")).withColumn("undelivered", F.col("entries") - F.col("delivered"))
    out = out.withColumn("backlog", F.col("pending") + F.col("undelivered"))
    columns = ["group", "pending", "undelivered", "backlog", (F.col("backlog") / maxlen).alias("ratio"), F.greatest(F.lit(0), maxlen - F.col("backlog")).alias("headroom")]
    if consumer is not None:
        counted = acks.groupBy("group").agg(F.countDistinct(consumer).alias("consumers"))
        out = out.join(counted, "group", "left").na.fill(0, ["consumers"])
        columns.append("consumers")
    if now is None:
        return out.select(*columns)
    low = low_watermark(log, mine.filter("acked_at IS NOT NULL"))
    age = F.coalesce(F.greatest(F.lit(0), F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("entered_at").cast("timestamp"))), F.lit(0))
    first = log.agg(F.min("entered_at").alias("_first"))  # one row, for groups that have acked nothing
    out = out.join(low, "group", "left").crossJoin(F.broadcast(first)).withColumn("entered_at", F.when(F.col("acked") == 0, F.col("_first")).otherwise(F.col("entered_at")))
    return out.select(*columns, "group_present", age.alias("oldest_age_seconds"))


def low_watermark(log: DataFrame, acked: DataFrame) -> DataFrame:
    """(group, entered_at) of the first log entry that a group has not acked, null where it has acked all; groups that have acked
    nothing have no row. Entries are numbered by time once; a group's acked entries, numbered among themselves, agree with those
    numbers up to the first gap: no pair of a group and an entry that is open is ever made."""
    numbers = scan(log.select("entry_id", "entered_at"), [], ["entered_at", "entry_id"], {"_n": running_count()})
    mine = scan(acked.select("group", "entry_id").join(numbers, "entry_id"), ["group"], ["_n"], {"_r": running_count()})
    gaps = mine.groupBy("group").agg(F.coalesce(F.min(F.when(F.col("_n") > F.col("_r"), F.col("_r"))), F.count("*")).alias("_n"))
    return gaps.join(numbers.select("_n", "entered_at"), "_n", "left").select("group", "entered_at")


def outages(samples: DataFrame, keys: list[str], at: list[str], failed: Column) -> DataFrame:
    """From the first failed attempt to the next success: since, until (null while it lasts) and reconnects (failed attempts)."""
    rows = islands(samples, keys, at, failed, "_run").withColumn("_outage", F.ceil(F.col("_run") / 2)).filter("_outage > 0")
    bad = F.col("_run_on")
    return rows.groupBy(*keys, "_outage").agg(F.min(F.when(bad, F.col(at[0]))).alias("since"), F.min(F.when(~bad, F.col(at[0]))).alias("until"), F.count_if(bad).alias("reconnects")).drop("_outage")


def counter_increase(samples: DataFrame, keys: list[str], at: str, counters: list[str], seconds: int = 300, width: int = 86_400) -> DataFrame:
    """Adds `counter`_increase: how much each counter of a series has risen over the `seconds` up to a sample, both ends
    included, from the first sample in that time; a fall is a reset, after which the counter starts from zero.

    A series is cut into slices of `width` seconds (at least `seconds`); rows near a slice's end are also in the next, as what
    its first rows look back on. Nothing is extrapolated to the ends of the time.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = scan(samples, keys, [at], {f"_was_{c}": last_before(c) for c in counters}, width).withColumn("_at", micros)
    rise = lambda c: F.when(F.col(f"_was_{c}").isNull() | F.col(c).isNull(), 0).when(F.col(c) < F.col(f"_was_{c}"), F.col(c)).otherwise(F.col(c) - F.col(f"_was_{c}"))
    step, reach = max(width, seconds) * 1_000_000, seconds * 1_000_000
    rows = rows.withColumns({f"_rise_{c}": rise(c) for c in counters}).withColumn("_own", F.floor(F.col("_at") / step))
    rows = rows.withColumn("_slice", F.explode(F.array_distinct(F.array("_own", F.floor((F.col("_at") + reach) / step)))))
    w = Window.partitionBy(*keys, "_slice").orderBy("_at").rangeBetween(-reach, 0)
    found = {f"{c}_increase": F.sum(f"_rise_{c}").over(w) - F.first(f"_rise_{c}").over(w) for c in counters}
    return rows.withColumns(found).filter("_slice = _own").select(*samples.columns, *found)


def latency_quantile(samples: DataFrame, keys: list[str], at: str, bounds: dict[str, float], q: float = 0.95) -> DataFrame:
    """(keys, at, value): the quantile of a cumulative histogram whose counts over the last minutes stand in the columns of
    `bounds` (column to upper bound, infinity for the last); null where nothing was counted."""
    cells = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(c).cast("double").alias("n")) for c, b in sorted(bounds.items(), key=lambda x: x[1])])
    total = F.get(cells, F.lit(len(bounds) - 1))["n"]
    rank = F.lit(q) * total
    # the first cell that reaches the rank; what it holds lies between the bound before and its own
    ahead = F.size(F.filter(cells, lambda c: c["n"] < rank))
    cell, below = F.get(cells, ahead), F.get(cells, ahead - 1)
    low, before = F.coalesce(below["le"], F.lit(0.0)), F.coalesce(below["n"], F.lit(0.0))
    inside = F.when(cell["le"] == float("inf"), low).otherwise(low + (cell["le"] - low) * F.try_divide(rank - before, cell["n"] - before))
    return samples.select(*keys, at, F.when(total > 0, inside).alias("value"))


#: Alert rules over sampled metrics: name, condition, seconds that it must hold, severity.
ALERTS = (
    ("provider_disconnected", "provider_connected = 0", 30, "critical"),
    ("no_active_upstream_subscriptions", "client_subscriptions > 0 AND unique_upstream_subscriptions = 0", 30, "critical"),
    ("high_delivery_latency", "delivery_latency_p95 > 0.25", 120, "warning"),
    ("high_coalescing", "coalesced_rate > 100", 120, "warning"),
    ("consumer_lag", "pending_entries > 1000", 60, "critical"),
    ("authentication_failures", "auth_failure_rate > 5", 120, "warning"),
    ("stale_reads", "stale_read_rate > 1", 120, "warning"),
    ("usage_buffer_drops", "usage_dropped_increase > 0", 60, "warning"),
    ("archive_exporter_down", "archive_up = 0", 60, "critical"),
    ("archive_monitor_unavailable", "archive_monitor_up = 0", 60, "critical"),
    ("archive_group_missing", "archive_group_present = 0", 60, "critical"),
    ("archive_no_consumers", "archive_consumers = 0 AND archive_backlog > 0", 60, "critical"),
    ("archive_backlog_stale", "archive_oldest_age > 300 AND archive_backlog > 0", 300, "warning"),
    ("archive_trim_risk", "archive_backlog_ratio > 0.5 AND archive_backlog_ratio < 0.8", 300, "warning"),
    ("archive_trim_imminent", "archive_backlog_ratio >= 0.8", 120, "critical"),
)


#: Seconds over which the rules look at counters, and the counters behind their columns.
LOOK_BACK = 300
RATES = {"coalesced_rate": "coalesced_total", "auth_failure_rate": "auth_failures_total", "stale_read_rate": "stale_reads_total"}
INCREASES = {"usage_dropped_increase": "usage_dropped_total"}


def alert_columns(samples: DataFrame, instance: str, at: str, buckets: dict[str, float]) -> DataFrame:
    """The rules' rates, increase and latency at each time, from raw counters and histogram buckets (column to upper bound) of all
    instances: each counter on its own, then sums over the instances that were sampled at that time."""
    counters = [*RATES.values(), *INCREASES.values(), *buckets]
    risen = counter_increase(samples.select(instance, at, *counters), [instance], at, counters, LOOK_BACK)
    total = cut(risen.groupBy(at).agg(*[F.sum(f"{c}_increase").alias(c) for c in counters]))  # a row a time; read more than once
    latency = latency_quantile(total, [], at, buckets).withColumnRenamed("value", "delivery_latency_p95")
    rates = [*[(F.col(c) / LOOK_BACK).alias(name) for name, c in RATES.items()], *[F.col(c).alias(name) for name, c in INCREASES.items()]]
    return total.select(at, *rates).join(latency, at)


def alerts(samples: DataFrame, keys: list[str], at: str, rules: tuple = ALERTS) -> DataFrame:
    """Firing stretches of every rule whose columns the samples have: alert, severity, keys, since, until, samples."""
    mine = [r for r in rules if all(word in samples.columns for word in re.findall(r"[a-z_][a-z_0-9]*", r[1]))]
    if not mine:
        raise ValueError("the samples have the columns of no rule")
    states = F.array(*[F.struct(F.lit(name).alias("alert"), F.lit(severity).alias("severity"), F.lit(seconds).alias("_least"), F.coalesce(F.expr(condition), F.lit(False)).alias("_on")) for name, condition, seconds, severity in mine])
    rows = cut(samples.select(*keys, at, F.inline(states)))  # a row for each rule; all rules in one pass, which reads them more than once
    return _stretches(rows, ["alert", "severity", "_least", *keys], at, F.col("_on"), F.col("_least")).select("alert", "severity", *keys, "since", "until", "samples")


def true_for(samples: DataFrame, keys: list[str], at: str, condition: Column, least_seconds: int, order: list[str] | None = None) -> DataFrame:
    """Stretches of consecutive samples that meet a condition for at least so long; `order` breaks ties of time."""
    return _stretches(samples, keys, at, condition, F.lit(least_seconds), order)


def _stretches(rows: DataFrame, keys: list[str], at: str, condition: Column, least: Column, order: list[str] | None = None) -> DataFrame:
    rows = islands(rows, keys, [at, *(order or [])], condition, "_run")
    out = rows.filter("_run_on").groupBy(*keys, "_run").agg(F.min(at).alias("since"), F.max(at).alias("until"), F.count("*").alias("samples")).drop("_run")
    return out.filter(F.unix_seconds(F.col("until").cast("timestamp")) - F.unix_seconds(F.col("since").cast("timestamp")) >= least)
