"""Messages and commands: JSON in and out, envelopes, redaction, subscriptions' commands, sessions of a capture."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tickloom.functions.scalar import normalize_symbol

#: Parts of a key whose value is never logged; and the symbols that one command may name.
SENSITIVE = "authorization|token|secret|password|credential|api_key"
MOST_SYMBOLS = 500


def wire_json(*columns: Column | str) -> Column:
    """A record as JSON without its null fields; lists in order."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def filter_symbols(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted symbols (normalised; a list of a request, so it is sent along)."""
    names = wanted.select(normalize_symbol(F.col("symbol")).alias("symbol")).filter("symbol IS NOT NULL").distinct()
    return rows.join(F.broadcast(names), "symbol", "left_semi")


def aggressor(side: Column) -> Column:
    """The side that took liquidity: the maker's side turned; null for anything else."""
    return F.when(side == "SELL", "buy").when(side == "BUY", "sell")


def delivery_latency_ms(received: Column, provided: Column) -> Column:
    """Milliseconds between provider and receipt; never negative."""
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    return F.greatest(F.lit(0), ms(received) - ms(provided))


def local_freshness(source_age_ms: Column, source_stale: Column, seen: Column, now: Column, limit_ms: Column | int) -> tuple[Column, Column]:
    """Age and staleness on the client's side: the source's age plus the time since it was first seen here."""
    passed = F.greatest(F.lit(0), F.unix_millis(now.cast("timestamp")) - F.unix_millis(seen.cast("timestamp")))
    age = source_age_ms + passed
    return age, source_stale | (age > limit_ms)


def redact_map(values: Column) -> Column:
    """A map with the values of sensitive keys replaced."""
    return F.transform_values(values, lambda k, v: F.when(k.rlike(f"(?i){SENSITIVE}"), F.lit("[redacted]")).otherwise(v))


@F.pandas_udf(StringType())
def redact_json(values: pd.Series) -> pd.Series:
    """JSON texts with the values of sensitive keys replaced at every depth; what is no JSON is replaced whole, null stays."""
    sensitive = re.compile(SENSITIVE, re.IGNORECASE)

    def clean(x):
        if isinstance(x, dict):
            return {k: "[redacted]" if sensitive.search(k) else clean(v) for k, v in x.items()}
        return [clean(v) for v in x] if isinstance(x, list) else x

    def one(text):
        if text is None:
            return None
        try:
            return json.dumps(clean(json.loads(text)), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return "[redacted]"

    return values.map(one)


def unwrap_envelope(lines: DataFrame, quote_schema: str) -> DataFrame:
    """Quote and snapshot messages to their quotes: type and the fields; other messages are left out."""
    schema = f"type string, data struct<quote: struct<{quote_schema}>, {quote_schema}>"
    names = [f.split(":")[0].strip() for f in re.split(r",(?![^<(]*[>)])", quote_schema)]
    m = lines.select(F.from_json("value", schema).alias("m")).filter("m.type in ('quote', 'snapshot')")
    return m.select(F.col("m.type").alias("message_type"), *[F.coalesce(f"m.data.quote.{n}", f"m.data.{n}").alias(n) for n in names])


def command_symbols(symbols: Column) -> Column:
    """Trimmed, upper-cased, without blanks, each where it stands first."""
    return F.array_distinct(F.filter(F.transform(symbols, lambda x: F.upper(F.trim(x))), lambda x: x != ""))


def command_errors(action: Column, symbols: Column) -> Column:
    """What a command breaks: too many symbols, or none where it needs them; empty if sound. Takes normalised symbols."""
    n = F.coalesce(F.size(symbols), F.lit(0))
    needed = action.isin("subscribe", "unsubscribe") & (n == 0)
    return F.concat_ws(",", F.when(n > MOST_SYMBOLS, "too_many_symbols"), F.when(needed, "symbols_required"))


def judge_controls(rows: DataFrame) -> DataFrame:
    """Control rows (action, symbol) with errors: an unknown action, a symbol that is none; empty if sound."""
    action = F.coalesce(F.col("action").isin("subscribe", "unsubscribe"), F.lit(False))
    return rows.withColumn("errors", F.concat_ws(",", F.when(~action, "action"), F.when(normalize_symbol(F.col("symbol")).isNull(), "symbol")))


def capture_summary(rows: DataFrame, session: str, at: str, max_records: int, max_seconds: int) -> DataFrame:
    """One row a session: records, started_at, finished_at, seconds, reason it ended and complete (only by time)."""
    out = rows.groupBy(session).agg(F.count("*").alias("records"), F.min(at).alias("started_at"), F.max(at).alias("finished_at"))
    out = out.withColumn("seconds", F.unix_seconds(F.col("finished_at").cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp")))
    full, late = F.lit(max_records > 0) & (F.col("records") >= max_records), F.lit(max_seconds > 0) & (F.col("seconds") >= max_seconds)
    out = out.withColumn("reason", F.when(full, "max_records").when(late, "max_seconds").otherwise("stream_ended"))
    return out.withColumn("complete", F.col("reason") == "max_seconds")
