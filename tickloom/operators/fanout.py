"""Fan-out to tiered subscribers: joins, decimation, conflation, limits, subscriptions and their accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.scalar import TIERS, buffer_capacity, delivery_interval, floor_time
from tickloom.operators.fold import keyed_fold
from tickloom.operators.machines import Connections, Throttle, TokenBucket, WindowLimit, run_machine
from tickloom.operators.scan import running_count, running_max, running_sum, scan


def policies(spark: SparkSession) -> DataFrame:
    """The fixed table of tier limits: three rows."""
    return spark.createDataFrame([(t, *v) for t, v in TIERS.items()], "tier string, max_symbols long, max_connections long, rate long, rpm long, history boolean")


def with_policy(rows: DataFrame) -> DataFrame:
    """Tier limits, delivery interval and buffer capacity of each row's tier; the policy table has three rows."""
    p = policies(rows.sparkSession).withColumn("interval_seconds", delivery_interval(F.col("rate"))).withColumn("capacity", buffer_capacity(F.col("max_symbols")))
    return rows.join(F.broadcast(p), "tier")


def fanout(quotes: DataFrame, subs: DataFrame) -> DataFrame:
    """Each quote to each subscriber of its symbol."""
    return quotes.join(subs, "symbol")


def delivery_counts(quotes: DataFrame, subs: DataFrame, client: str) -> DataFrame:
    """Deliveries of each client and symbol: the rows of fanout() by these, counted without making them.

    Both sides are counted before they meet, so the work grows with quotes and subscriptions, not with their product.
    """
    sent, held = quotes.groupBy("symbol").agg(F.count("*").alias("_sent")), subs.groupBy(client, "symbol").agg(F.count("*").alias("_held"))
    return fanout(sent, held).select(client, "symbol", (F.col("_sent") * F.col("_held")).alias("deliveries"))


def divisor(rate: Column, provider_rate: int = 10) -> Column:
    return F.greatest(F.lit(1), F.bround(F.lit(float(provider_rate)) / rate)).cast("long")


def decimated(rows: DataFrame, keys: list[str], order: list[str], provider_rate: int = 10) -> DataFrame:
    """A row for each quote and tier that gets it: of a key's quotes, tier t gets those whose number (from 0) its divisor divides."""
    tiers = F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(max(1, round(provider_rate / v[2]))).alias("divisor")) for t, v in TIERS.items()])
    return scan(rows, keys, order, {"n": running_count()}).select("*", F.inline(tiers)).filter("n % divisor = 0").drop("divisor")


def savings(before: Column, after: Column) -> Column:
    """Percent saved; 0 where there was nothing before."""
    return F.when(before == 0, 0.0).otherwise((1 - after / before) * 100)


def symbol_limits(subs: DataFrame, client: str, limit: Column | str = "max_symbols") -> DataFrame:
    """Distinct symbols of each client and whether they exceed the limit of its tier (or the column given)."""
    rows = with_policy(subs) if limit == "max_symbols" else subs
    out = rows.groupBy(client).agg(F.countDistinct("symbol").alias("symbols"), F.max(limit).alias("allowed"))
    return out.withColumn("violation", F.col("symbols") > F.col("allowed"))


def desired_symbols(subs: DataFrame, client: str, acked: DataFrame, fresh: DataFrame, source_live: Column | None = None) -> DataFrame:
    """Consumers of each symbol, their sorted list, and whether it is live: source live, acknowledged and fresh.

    The list of a symbol grows with its subscribers; consumers alone is a plain count.
    """
    mark = lambda df, name: df.select("symbol").distinct().withColumn(name, F.lit(True))
    out = subs.groupBy("symbol").agg(F.countDistinct(client).alias("consumers"), F.array_sort(F.collect_set(client)).alias("clients"))
    out = out.join(mark(acked, "_acked"), "symbol", "left").join(mark(fresh, "_fresh"), "symbol", "left")
    live = (F.lit(True) if source_live is None else source_live) & F.coalesce("_acked", F.lit(False)) & F.coalesce("_fresh", F.lit(False))
    return out.withColumn("live", live).drop("_acked", "_fresh")


def fanout_accounting(quotes: DataFrame, subs: DataFrame, payload: int = 256) -> DataFrame:
    """Deliveries by mode without building them: events of a symbol times its subscribers, decimated for each tier."""
    events = quotes.groupBy("symbol").agg(F.count("*").alias("events"))
    by_tier = with_policy(subs.groupBy("symbol", "tier").agg(F.count("*").alias("subs")))
    kept = F.ceil(F.col("events") / divisor(F.col("rate")))
    rows = by_tier.join(events, "symbol").select("symbol", "subs", (F.col("events") * F.col("subs")).alias("all"), (kept * F.col("subs")).alias("some"))
    return rows.agg(F.sum("subs").alias("baseline_subscriptions"), F.countDistinct("symbol").alias("smart_subscriptions"), F.sum("all").alias("baseline_deliveries"), F.sum("some").cast("long").alias("smart_deliveries"), (F.sum("all") * payload).alias("baseline_bytes"), (F.sum("some") * payload).cast("long").alias("smart_bytes"))


def conflate_window(quotes: DataFrame, seconds: int) -> DataFrame:
    """Newest quote of each symbol and aligned interval, and how many it stands for; computed once for a tier, then joined."""
    at = F.struct("arrival", "event_id")
    return quotes.groupBy("symbol", floor_time(F.col("provider_timestamp"), seconds).alias("slot")).agg(F.max_by("price", at).alias("price"), F.max_by("event_id", at).alias("event_id"), (F.count("*") - 1).alias("coalesced"))


def conflate_latest(rows: DataFrame, keys: list[str], at: str, seconds: str = "interval_seconds") -> DataFrame:
    """Exact throttle with trailing edge: adds sent_at and replaced (a later quote took its place before it was due).

    A quote goes at once if the interval has passed since the last send; else it waits for last send plus interval, and a
    newer one takes its place.
    """
    return run_machine(rows, keys, at, ["arrival"], Throttle(seconds))


def bounded_buffer(rows: DataFrame, client: str, n: int) -> DataFrame:
    """Content of a client's buffer of n symbols: the n most recently received."""
    newest = rows.groupBy(client, "symbol").agg(F.max("received_at").alias("received_at"), F.max_by("event_id", F.struct("received_at", "arrival")).alias("event_id"))
    w = Window.partitionBy(client).orderBy(F.desc("received_at"), "symbol")
    return newest.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def buffer_counts(rows: DataFrame, client: str, n: int) -> DataFrame:
    """What a client's buffer of n symbols did between sends: coalesced, dropped, depth; the oldest received goes first."""

    def step(state, row):
        held = state or {}
        coalesced = row["symbol"] in held
        dropped = not coalesced and len(held) >= n
        if dropped:
            del held[min(held, key=held.get)]
        held[row["symbol"]] = row["received_at"]
        return held, (coalesced, dropped, len(held))

    done = keyed_fold(rows.select(client, "symbol", "received_at", "arrival"), [client], ["arrival"], step, {"coalesced": "boolean", "dropped": "boolean", "depth": "long"})
    return done.groupBy(client).agg(F.count_if("coalesced").alias("coalesced"), F.count_if("dropped").alias("dropped"), F.max_by("depth", "arrival").alias("depth"))


def slow_consumer_warnings(rows: DataFrame, client: str, order: list[str], threshold: int) -> DataFrame:
    """One row each time a client's running count of coalesced quotes has grown by the threshold since its last warning."""

    def step(state, row):
        total, warned = state or (0, 0)
        total += row["coalesced"] or 0
        warns = total - warned >= threshold
        return (total, total if warns else warned), (total, warns)

    return keyed_fold(rows, [client], order, step, {"total": "long", "warns": "boolean"}).filter("warns").drop("warns")


def activations(intervals: DataFrame, grace_seconds: int = 3, width: int = 86_400) -> DataFrame:
    """Islands of a symbol's live subscriptions, joined over gaps up to the grace: activate_at, release_at, subscriptions.

    A symbol's intervals are ordered slice by slice of their start (`width` seconds), side by side.
    """
    order, grace = ["start", "expires", "connection"], F.expr(f"INTERVAL {grace_seconds} SECOND")
    rows = scan(intervals, ["symbol"], order, {"_reach": running_max("expires")}, width)
    rows = rows.withColumn("_new", (F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + grace)).cast("long"))
    rows = scan(rows, ["symbol"], order, {"_island": running_sum("_new", inclusive=True)}, width)
    return rows.groupBy("symbol", "_island").agg(F.min("start").alias("activate_at"), (F.max("expires") + grace).alias("release_at"), F.count("*").alias("subscriptions")).drop("_island")


def subscription_stats(intervals: DataFrame, at: Column) -> DataFrame:
    """Live subscriptions at a time (expiry inclusive), unique symbols, their ratio and the reduction."""
    live = intervals.filter((F.col("start") <= at) & (F.col("expires") > at)).select("connection", "symbol").distinct()
    out = live.agg(F.count("*").alias("client_subscriptions"), F.countDistinct("symbol").alias("unique_symbols"))
    ratio = F.when(F.col("unique_symbols") > 0, F.col("client_subscriptions") / F.col("unique_symbols")).otherwise(0.0)
    return out.withColumn("ratio", ratio).withColumn("reduction", 1 - F.col("unique_symbols") / F.greatest("client_subscriptions", F.lit(1)))


def token_bucket(requests: DataFrame, key: str, at: str, rpm: Column | int | str, cost: str | None = None, burst: str | None = None) -> DataFrame:
    """Which requests a bucket admits and what remains. rpm is a number or a column (of the client's tier, by with_policy);
    `cost` and `burst` name columns: tokens of a request, and the capacity where it is not max(5, ceil(rpm / 6))."""
    rows = requests.withColumn("_rpm", F.col(rpm) if isinstance(rpm, str) else F.lit(rpm).cast("long") if isinstance(rpm, int) else rpm)
    return run_machine(rows, [key], at, ["event_id"], TokenBucket("_rpm", cost, burst)).drop("_rpm")


def anchored_window_limit(requests: DataFrame, key: str, at: str, limit: int | str, seconds: int = 60) -> DataFrame:
    """The first request opens a window; the first `limit` requests in it are allowed."""
    return run_machine(requests, [key], at, ["event_id"], WindowLimit(limit, seconds))


def connection_leases(events: DataFrame, client: str, at: str, order: list[str], most: int | str = "max_connections", seconds: int = 60) -> DataFrame:
    """Which acquire, heartbeat and release events take effect under a limit of living connections, and how many live then."""
    rows = with_policy(events) if most == "max_connections" and most not in events.columns else events
    return run_machine(rows, [client], at, order, Connections(most, seconds))


def connection_limit(sessions: DataFrame, key: str, most: int) -> DataFrame:
    """Which sessions (start, expires) a limit of concurrent ones admits; refused ones hold no place."""

    def step(state, row):
        live = [e for e in (state or []) if e > row["start"]]
        ok = len(live) < most
        return (live + [row["expires"]] if ok else live), (ok,)

    return keyed_fold(sessions, [key], ["start", "expires"], step, {"allowed": "boolean"})
