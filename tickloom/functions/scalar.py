"""Scalar helpers as Column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of each timeframe.
TIMEFRAMES = {"5s": 5, "1m": 60, "5m": 300, "15m": 900, "1h": 3600, "4h": 14_400, "1d": 86_400}
#: Tier limits (symbols, connections, updates a second, requests a minute, history).
TIERS = {"basic": (20, 2, 1, 120, False), "pro": (100, 5, 5, 600, True), "premium": (500, 20, 10, 3000, True)}


def floor_time(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket of `seconds`; keeps TIMESTAMP_NTZ."""
    return F.window(ts, f"{seconds} seconds")["start"]


def ceil_time(ts: Column, seconds: int) -> Column:
    low = F.timestamp_micros(F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long") * F.lit(seconds * 1_000_000)).cast("timestamp_ntz")
    return F.when(low < ts, low + F.expr(f"INTERVAL {seconds} SECOND")).otherwise(low)


def floor_micros(ts: Column, seconds: int) -> Column:
    """floor_time without the window operator: for expressions inside joins and filters."""
    step = F.lit(seconds * 1_000_000)
    return F.timestamp_micros(F.floor(F.unix_micros(ts.cast("timestamp")) / step).cast("long") * step).cast("timestamp_ntz")


def normalize_symbol(s: Column) -> Column:
    """Trimmed and upper-cased symbol; null where it breaks the pattern or the length of 32."""
    up = F.upper(F.trim(s))
    return F.when(up.rlike(r"^[A-Z0-9._:-]{1,32}$"), up)


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """Name-based UUID of version 5, without Python in the tasks."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


def parse_decimal(s: Column, least: int | None = None, strict: bool = False) -> Column:
    """Text to DECIMAL(38,18): empty and malformed text is null; below `least` (or equal, if strict) is null too."""
    x = F.nullif(F.trim(s), F.lit("")).try_cast("decimal(38,18)")
    if least is None:
        return x
    return F.when((x > least) if strict else (x >= least), x)


def parse_timestamp(s: Column) -> Column:
    """ISO-8601 with an offset; naive or malformed text is null."""
    return F.when(s.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(s))


def stream_id_age(entry: Column, now_ms: Column) -> Column:
    """Milliseconds since the entry id's time part; malformed ids count as age 0."""
    at = F.split_part(entry, F.lit("-"), F.lit(1)).try_cast("long")
    return F.greatest(F.lit(0), F.coalesce(now_ms - at, F.lit(0)))


def delivery_interval(rate: Column) -> Column:
    """Seconds between deliveries; an hour where the rate is not positive."""
    return F.when(rate > 0, 1 / rate).otherwise(F.lit(3600.0))


def decimal_places(x: Column) -> Column:
    """Places after the point without trailing zeros."""
    return F.length(F.regexp_extract(F.regexp_replace(x.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.([0-9]+)$", 1))


def format_price(x: Column, places: Column | int) -> Column:
    """A price with so many places (0 to 12), a dash where there is none; halves away from zero, no negative zero."""
    places = F.lit(places) if isinstance(places, int) else places
    cut = F.least(F.lit(12), F.greatest(F.lit(0), places)).cast("int")
    forms = F.when(F.lit(False), F.lit(""))
    for n in range(13):
        forms = forms.when(cut == n, F.round(x.cast("decimal(38,12)"), n).cast(f"decimal(38,{n})").cast("string"))
    return F.coalesce(forms, F.lit("\u2014"))


def is_sha256_hex(s: Column) -> Column:
    return F.coalesce(s.rlike("^[0-9a-f]{64}$"), F.lit(False))


def buffer_capacity(max_symbols: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(512), 2 * max_symbols))
