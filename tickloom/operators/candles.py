"""Candles: minute aggregation, merging, roll-up, overlay, stitching, retention and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalar import TIMEFRAMES, ceil_time, decimal_places, floor_time
from tickloom.operators.scan import last_before, scan


def candles_1m(quotes: DataFrame, seconds: int = 60) -> DataFrame:
    """One candle for each symbol and minute; open and close by (provider_timestamp, event_id). One shuffle, partial sums."""
    at = F.struct("provider_timestamp", "event_id")
    return quotes.groupBy("symbol", floor_time(F.col("provider_timestamp"), seconds).alias("open_time")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("n"),
        F.min("provider_timestamp").alias("first_ts"), F.max("provider_timestamp").alias("last_ts"), F.min_by("event_id", at).alias("first_id"), F.max_by("event_id", at).alias("last_id"),
    )


def merge_candles(candles: DataFrame, open_time: Column | None = None) -> DataFrame:
    """Partial candles of equal buckets to one; in any order and grouping."""
    first, last = F.struct("first_ts", "first_id"), F.struct("last_ts", "last_id")
    return candles.groupBy("symbol", (F.col("open_time") if open_time is None else open_time).alias("open_time")).agg(
        F.min_by("open", first).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", last).alias("close"), F.sum("n").alias("n"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.min_by("first_id", first).alias("first_id"), F.max_by("last_id", last).alias("last_id"),
    )


def rollup_candles(minutes: DataFrame, timeframe: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Minute candles to a longer timeframe; with `end`, closed buckets alone; with `start`, buckets from it on.

    The bounds are also set on open_time itself, so that they reach a partitioned or sorted table's statistics.
    """
    seconds = TIMEFRAMES[timeframe]
    if end is not None:
        minutes = minutes.filter(F.col("open_time") < end)
    if start is not None:
        minutes = minutes.filter(F.col("open_time") >= start)
    out = merge_candles(minutes, floor_time(F.col("open_time"), seconds))
    if end is not None:
        out = out.filter(F.col("open_time") + F.expr(f"INTERVAL {seconds} SECOND") <= end)
    return out


def hybrid_overlay(archive: DataFrame, hot: DataFrame, now: Column, retention_seconds: int, timeframe: str, limit: int | None = None) -> DataFrame:
    """Archive candles with hot ones over them: hot wins from the first whole hot bucket on, or where the archive has none.

    With `limit`, the newest so many buckets of each symbol.
    """
    since = ceil_time(now - F.make_dt_interval(secs=F.lit(retention_seconds)), TIMEFRAMES[timeframe])
    values = [c for c in archive.columns if c not in ("symbol", "open_time")]
    a = archive.select("symbol", "open_time", F.struct(*values).alias("a"))
    h = hot.select("symbol", "open_time", F.struct(*values).alias("h"))
    best = F.when(F.col("h").isNotNull() & ((F.col("open_time") >= since) | F.col("a").isNull()), F.col("h")).otherwise(F.coalesce("a", "h"))
    out = a.join(h, ["symbol", "open_time"], "full_outer").select("symbol", "open_time", best.alias("v")).select("symbol", "open_time", "v.*")
    return out if limit is None else last_n(out, limit)


def stitch_history_live(history: DataFrame, live: DataFrame) -> DataFrame:
    """History up to its last bucket of each symbol, live rows after it."""
    last = history.groupBy("symbol").agg(F.max("open_time").alias("_last"))
    later = live.join(last, "symbol", "left").filter(F.col("_last").isNull() | (F.col("open_time") > F.col("_last"))).drop("_last")
    return history.unionByName(later)


def last_n(candles: DataFrame, n: int) -> DataFrame:
    """The newest n buckets of each symbol."""
    w = Window.partitionBy("symbol").orderBy(F.desc("open_time"))
    return candles.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def series_envelope(candles: DataFrame, limit: int) -> DataFrame:
    """One nested row a symbol: requested_limit, returned_count, period, the candles in order and warnings; at most `limit` candles."""
    values = [c for c in candles.columns if c not in ("symbol", "open_time")]
    kept = last_n(candles, limit)
    return kept.groupBy("symbol").agg(
        F.lit(limit).alias("requested_limit"), F.count("*").alias("returned_count"), F.min("open_time").alias("period_start"), F.max("open_time").alias("period_end"),
        F.array_sort(F.collect_list(F.struct("open_time", *values))).alias("candles"), F.array_compact(F.array(F.when(F.count("*") < limit, "fewer_candles_than_requested"))).alias("warnings"),
    )


def validate_envelope(series: DataFrame) -> DataFrame:
    """Adds errors of a nested series: count is not its size, times not ascending, outside the period, prices not positive."""
    c = F.col("candles")
    ascending = F.forall(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.get(c, i - 1)["open_time"] < F.get(c, i)["open_time"])
    checks = {
        "count": F.col("returned_count") == F.size(c), "order": (F.size(c) < 2) | ascending,
        "period": F.forall(c, lambda x: x["open_time"].between(F.col("period_start"), F.col("period_end"))), "prices": F.forall(c, lambda x: x["low"] > 0),
    }
    return series.withColumn("errors", F.concat_ws(",", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def chart_activity(source: Column, updates: Column, volume: Column) -> tuple[Column, Column]:
    """What a chart shows as activity: its source (updates, mixed or volume) and value."""
    name = F.when(source.isin("updates", "mixed"), source).otherwise("volume")
    return name, F.when(source == "updates", updates).otherwise(volume)


def activity_label(points: DataFrame, keys: list[str], source: str = "source") -> DataFrame:
    """Label of each key's points: Updates or Volume if they have one source, else Activity."""
    one = F.min(source) == F.max(source)
    return points.groupBy(*keys).agg(F.when(~one, "Activity").when(F.min(source) == "updates", "Updates").otherwise("Volume").alias("label"))


def price_precision(quotes: DataFrame, ticks: DataFrame | None = None, fallback: int = 2, most: int = 8) -> DataFrame:
    """Places and least move of each symbol: by its tick size if `ticks` (symbol, tick_size) has one, else by its positive prices."""
    seen = quotes.groupBy("symbol").agg(F.max(F.when(F.col("price") > 0, decimal_places(F.col("price")))).alias("_seen"))
    by_price = F.least(F.lit(most), F.greatest(F.lit(fallback), F.coalesce("_seen", F.lit(0))))
    if ticks is None:
        return seen.select("symbol", by_price.alias("places"), F.pow(F.lit(10.0), -by_price).alias("min_move"))
    tick = F.when(F.col("tick_size") > 0, F.col("tick_size"))
    out = seen.join(ticks, "symbol", "left")
    return out.select("symbol", F.when(tick.isNotNull(), F.least(F.lit(most), decimal_places(tick))).otherwise(by_price).alias("places"), F.coalesce(tick.cast("double"), F.pow(F.lit(10.0), -by_price)).alias("min_move"))


def retained(rows: DataFrame, now: Column, seconds: int, bucket_seconds: int = 60) -> DataFrame:
    """Buckets whose end plus the retention lies after `now`."""
    return rows.filter(F.col("open_time") + F.expr(f"INTERVAL {bucket_seconds + seconds} SECOND") > now)


def volume_delta(points: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds volume and source: the last size, else the rise of the cumulative volume (a fall is a reset), else one update."""
    points = scan(points, keys, order, {"_previous": last_before("cumulative")})
    prev, cum = F.col("_previous"), F.col("cumulative")
    delta = F.when(prev.isNull(), F.lit(0)).when(cum < prev, cum).otherwise(cum - prev)
    source = F.when(F.col("last_size").isNotNull(), "last_size").when(cum.isNotNull(), "cumulative").otherwise("updates")
    return points.withColumn("volume", F.when(F.col("last_size").isNotNull(), F.col("last_size")).when(cum.isNotNull(), delta).otherwise(F.lit(1)).cast("decimal(18,1)")).withColumn("source", source).drop("_previous")


def ohlcv(points: DataFrame, seconds: int, keys: list[str], order: list[str]) -> DataFrame:
    """Arrival-order candles with volume, its source (or mixed), number of updates and whether the bucket is complete."""
    at = F.struct(*order)
    bars = volume_delta(points, keys, order).groupBy(*keys, floor_time(F.col("provider_timestamp"), seconds).alias("open_time")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").cast("decimal(18,1)").alias("volume"),
        F.when(F.min("source") == F.max("source"), F.min("source")).otherwise("mixed").alias("volume_source"), F.count("*").alias("update_count"),
        F.min_by("event_id", at).alias("first_id"), F.max_by("event_id", at).alias("last_id"),
    )
    return completeness(bars, keys)


def completeness(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Adds complete: a later bucket of the key is there. The maximum is a partial sum that is joined back: a row a key."""
    newest = bars.groupBy(*keys).agg(F.max("open_time").alias("_newest"))
    return bars.join(newest, keys).withColumn("complete", F.col("open_time") < F.col("_newest")).drop("_newest")


def validate_series(candles: DataFrame, seconds: int) -> DataFrame:
    """Adds errors: which consumer rules a candle breaks."""
    checks = {"prices": (F.col("low") > 0), "high": (F.col("high") >= F.greatest("open", "close")), "low": (F.col("low") <= F.least("open", "close")), "count": F.col("n") > 0, "observation": F.col("last_ts") < F.col("open_time") + F.expr(f"INTERVAL {seconds} SECOND")}
    return candles.withColumn("errors", F.array_join(F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()])), ","))
