"""Validation, duplicates, sequence anomalies, temporal integrity, freshness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.machines import FailureCount, FirstWithin, TemporalGuard, run_machine
from tickloom.operators.scan import running_max, scan


def reasons(rules: dict[str, Column]) -> Column:
    """The names of broken rules, comma-joined in order; a rule that is null is not broken."""
    return F.array_join(F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules.items()])), ",")


def quote_rules() -> dict[str, Column]:
    """Rules of the plain quote contract: true where broken."""
    c = F.col
    return {
        "V2": ~c("symbol").rlike(r"^[A-Z0-9._:-]{1,32}$") | c("symbol").isNull(), "V3": (c("price") <= 0) | c("price").isNull(), "V4": (c("bid") <= 0) | (c("ask") <= 0),
        "V5": c("provider_timestamp").isNull() | c("received_at").isNull(), "V6": c("sequence") < 0, "V7": ~F.coalesce(F.length("provider").between(1, 64), F.lit(False)), "V8": c("bid") > c("ask"),
    }


def evidence_rules(c: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """Rules of rich quotes: semantics, capabilities, sizes and versions; true where broken. `c` gives a field's column."""
    has = lambda name: F.array_contains(c("capabilities"), name)
    there = lambda *names: F.coalesce(*[c(n).cast("string") for n in names]).isNotNull()
    volumes, flow, depth = there("volume", "buy_volume", "sell_volume", "trade_count"), there("buy_volume", "sell_volume"), there("bid_depth", "ask_depth")
    rich = volumes | depth | there("volume_kind", "volume_unit", "depth_unit", "depth_levels")
    return {
        "V1": ~F.coalesce(c("schema_version").rlike(r"^1\.[0-9]+$"), F.lit(False)), "V9": ~F.coalesce(has("level1_quote"), F.lit(False)), "V10": (c("volume_kind") == "interval") & c("window_ms").isNull(),
        "V11": (c("volume_kind") == "cumulative") & c("window_ms").isNotNull(), "V12": (c("volume_unit") == "quote_notional") & c("volume_currency").isNull(),
        "V13": (c("volume_unit") != "quote_notional") & c("volume_currency").isNotNull(), "V14": c("window_ms") <= 0,
        "V15": (c("depth_unit") == "quote_notional") & c("depth_currency").isNull(), "V16": (c("depth_unit") != "quote_notional") & c("depth_currency").isNotNull(), "V17": ~c("depth_levels").between(1, 20),
        "V18": rich & (F.regexp_extract(c("schema_version"), r"^1\.([0-9]+)$", 1).try_cast("int") < 1), "V19": volumes & c("volume_kind").isNull(),
        "V20": (c("volume").isNotNull() & ~has("volume")) | (c("trade_count").isNotNull() & ~has("trade_count")),
        "V21": (c("buy_volume").isNull() != c("sell_volume").isNull()) | (flow & ~has("aggressor_flow")) | (c("buy_volume") + c("sell_volume") > c("volume")),
        "V22": (c("bid_depth").isNull() != c("ask_depth").isNull()) | (depth & (c("depth_levels").isNull() | (c("depth_levels") != 1) | ~has("top_of_book_depth"))),
        "V23": (c("volume") < 0) | (c("buy_volume") < 0) | (c("sell_volume") < 0) | (c("bid_depth") < 0) | (c("ask_depth") < 0) | (c("trade_count") < 0),
    }


def unknown_fields(rows: DataFrame, known: list[str]) -> DataFrame:
    """Raw JSON objects (value) with rule V24: the fields outside the contract, comma-joined; empty where there are none."""
    names = F.coalesce(F.json_object_keys("value"), F.array())
    return rows.withColumn("unknown", F.array_join(F.array_sort(F.array_except(names, F.array(*map(F.lit, known)))), ","))


def validate(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds errors; empty where the row is accepted."""
    return rows.withColumn("errors", reasons(rules))


def dead_letters(rows: DataFrame, source: str, key: str, payload: Column, failed_at: Column, retry_count: Column | int = 0) -> DataFrame:
    """Rejected rows as dead letters: source, entry_id, payload, error, retry_count, failed_at."""
    retries = retry_count if isinstance(retry_count, Column) else F.lit(retry_count)
    return rows.filter("errors <> ''").select(F.lit(source).alias("source"), F.col(key).alias("entry_id"), payload.alias("payload"), F.col("errors").alias("error"), retries.alias("retry_count"), failed_at.alias("failed_at"))


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in arrival order."""
    return rows.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_first")).select("_first.*")


def dedupe_ttl(rows: DataFrame, key: str, at: str, ttl_seconds: int) -> DataFrame:
    """Accepts a key's first row and every row at least the TTL after the last accepted one; repeats do not extend it."""
    return run_machine(rows, [key], at, ["arrival"], FirstWithin(ttl_seconds))


def sequence_anomalies(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Gaps and out-of-order rows against the running maximum of the sequence; rows in order and first rows are left out."""
    out = scan(rows.filter("sequence IS NOT NULL"), keys, order, {"previous": running_max("sequence")}).filter("previous IS NOT NULL AND sequence <> previous + 1")
    return out.withColumn("gap", F.greatest(F.lit(0), F.col("sequence") - F.col("previous") - 1)).withColumn("out_of_order", F.col("sequence") <= F.col("previous"))


def stream_health(anomalies: DataFrame, keys: list[str], at: str, now: Column, valid_seconds: int = 300) -> DataFrame:
    """The last anomaly of each key and whether it still counts: degraded for so long after it."""
    out = anomalies.groupBy(*keys).agg(F.max(at).alias("last_anomaly"))
    return out.withColumn("degraded", (F.col("last_anomaly") > now - F.expr(f"INTERVAL {valid_seconds} SECOND")) & (F.col("last_anomaly") <= now))


def duplicate_counts(rows: DataFrame, keys: list[str], event: str = "event_id") -> DataFrame:
    """Deliveries beyond the first of each event, by key: partial counts by event first."""
    per = rows.groupBy(*keys, event).agg((F.count("*") - 1).alias("_x"))
    return per.groupBy(*keys).agg(F.sum("_x").alias("duplicates"))


def exhausted(failures: DataFrame, keys: list[str], order: list[str], limit: int = 3, transient: Column | None = None) -> DataFrame:
    """The failure that is an entry's `limit`-th, which sends it to the dead letters; transient failures do not count."""
    rows = failures if transient is None else failures.filter(~F.coalesce(transient, F.lit(False)))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") == limit).drop("_r")


def exhausted_within(failures: DataFrame, keys: list[str], at: str, order: list[str], limit: int = 3, seconds: int = 3600, transient: Column | None = None) -> DataFrame:
    """exhausted() with counts that are forgotten `seconds` after an entry's last failure; each renewed count may reach the limit."""
    rows = failures if transient is None else failures.filter(~F.coalesce(transient, F.lit(False)))
    return run_machine(rows, keys, at, order, FailureCount(limit, seconds)).filter("exhausted").drop("exhausted")


def recorder_filter(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds duplicate (sequence not above the running maximum) and gap_size."""
    prev = F.col("_previous")
    dup = F.coalesce(F.col("sequence") <= prev, F.lit(False))
    gap = F.when(dup | prev.isNull() | F.col("sequence").isNull(), 0).otherwise(F.col("sequence") - prev - 1).cast("long")
    return scan(rows, keys, order, {"_previous": running_max("sequence")}).withColumn("duplicate", dup).withColumn("gap_size", gap).drop("_previous")


def temporal_integrity(points: DataFrame, keys: list[str], order: list[str], retention: int = 10_000, resets: bool = True) -> DataFrame:
    """Adds outcome, reason and missing of the temporal guard's state machine."""
    return run_machine(points, keys, "provider_timestamp", order, TemporalGuard(retention, resets), arrival=True)


def quarantine_log(judged: DataFrame, at: str, order: list[str], most: int = 500) -> DataFrame:
    """The newest quarantined rows of all keys, as many as a guard's log keeps."""
    return judged.filter("outcome = 'quarantined'").orderBy(F.desc(at), *[F.desc(c) for c in order]).limit(most)


def rollbacks(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows earlier than the running maximum of their key: temporal_integrity where generation is constant and sequences are null."""
    return scan(rows, keys, order, {"latest": running_max("provider_timestamp")}).filter("provider_timestamp < latest")


def freshness(rows: DataFrame, now: Column, limit_seconds: int = 5) -> DataFrame:
    """Adds age_ms (never negative) and stale (strictly above the limit)."""
    age = F.greatest(F.lit(0), F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("received_at").cast("timestamp"))) / 1000).cast("long"))
    return rows.withColumn("age_ms", age).withColumn("stale", age > limit_seconds * 1000)


def latest(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Last row of each key by arrival."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v")).select(key, "v.*")
