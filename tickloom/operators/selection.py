"""Which rows stay: newest and first rows of a key, retention, slices of a log, differences of row sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalar import TIMEFRAMES, floor_micros
from tickloom.operators.scan import running_count, scan


def _ranked(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def newest(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The newest n rows of each key."""
    return _ranked(rows, keys, [F.desc(c) for c in order], n)


def first_records(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key; 0 means no limit."""
    return _ranked(rows, keys, [F.asc(c) for c in order], n) if n else rows


def cap_log(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The newest n rows of the whole log: every task's own newest n first, then those of all."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)


def ordered_unique(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last values of each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*keys, "_v.*")


def local_sequence(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds local_sequence: the row's number in its key, from 1."""
    return scan(rows, keys, order, {"local_sequence": running_count(inclusive=True)})


def history_window(end: Column, timeframe: str, limit: int) -> tuple[Column, Column]:
    """Start and end of the buckets that a request for `limit` closed ones before `end` reads; as literals, they reach the scan."""
    seconds = TIMEFRAMES[timeframe]
    return (floor_micros(end, seconds) - F.expr(f"INTERVAL {seconds * limit} SECOND")).cast("timestamp_ntz"), end


def retained_since(rows: DataFrame, at: str, now: Column, seconds: int) -> DataFrame:
    """Rows not older than the retention."""
    return rows.filter(F.col(at) >= now - F.expr(f"INTERVAL {seconds} SECOND"))


def replay_slice(rows: DataFrame, symbols: list[str], at: str, start: Column, end: Column, order: list[str]) -> DataFrame:
    """Rows of some symbols from `start` up to before `end`, in order: what a replay sends."""
    return rows.filter(F.col("symbol").isin(symbols) & (F.col(at) >= start) & (F.col(at) < end)).orderBy(at, *order)


def unseen(rows: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key was not seen; null keys stay."""
    return rows.join(seen.select(*keys).distinct(), keys, "left_anti")


def refreshed(latest: DataFrame, repeats: DataFrame, keys: list[str], at: str, generation: str) -> DataFrame:
    """Latest rows with refreshed_at: the last arrival of the same event, of the same generation or a later one."""
    old = F.col(f"l.{generation}")
    same = reduce(lambda a, b: a & b, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]) & (F.col(f"r.{generation}") >= old)
    found = latest.alias("l").join(repeats.alias("r"), same, "left")
    return found.groupBy(*[F.col(f"l.{c}").alias(c) for c in latest.columns]).agg(F.max(f"r.{at}").alias("refreshed_at"))


def newest_generation(rows: DataFrame, keys: list[str], generation: str = "generation") -> DataFrame:
    """Rows of each key's newest generation: the maximum is gathered first, then joined."""
    top = rows.groupBy(*keys).agg(F.max(generation).alias(generation))
    return rows.join(top, [*keys, generation], "left_semi")


def union_layers(*layers: DataFrame) -> DataFrame:
    """All layers' rows, with the layer's number."""
    return reduce(DataFrame.unionByName, [df.withColumn("layer", F.lit(i)) for i, df in enumerate(layers)])


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct rows added, removed and kept between two row sets: change and their columns. One shuffle, no set operations."""
    both = old.distinct().withColumn("_side", F.lit(1)).unionByName(new.distinct().withColumn("_side", F.lit(2)))
    change = F.element_at(F.array(F.lit("removed"), F.lit("added"), F.lit("kept")), F.sum("_side").cast("int"))
    return both.groupBy(*old.columns).agg(change.alias("change")).select("change", *old.columns)


def entitled(rows: DataFrame, entitlements: DataFrame, client: str, channel: str | None = None) -> DataFrame:
    """Adds allowed: the symbol (and channel) is in the client's list, or the list is null; unknown clients have no rights."""
    out = rows.join(entitlements.withColumn("_known", F.lit(True)), client, "left")
    ok = lambda allowed, name: F.col(allowed).isNull() | F.array_contains(allowed, F.col(name))
    allowed = F.coalesce(F.col("_known"), F.lit(False)) & ok("allowed_symbols", "symbol")
    if channel:
        allowed = allowed & ok("allowed_channels", channel)
    return out.withColumn("allowed", allowed).select(*rows.columns, "allowed")


def denied(rows: DataFrame, entitlements: DataFrame, client: str, channel: str | None = None) -> DataFrame:
    """The distinct symbols that each client asked for and may not have."""
    return entitled(rows, entitlements, client, channel).filter("NOT allowed").select(client, "symbol").distinct()


def distinct_in_order(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Distinct values with the place where each stands first."""
    return rows.groupBy(column).agg(F.min(F.struct(*order)).alias("first"))


def unique_lists(*lists: Column) -> Column:
    """The lists one after another, each value where it stands first; null lists are empty."""
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))
