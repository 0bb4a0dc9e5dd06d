"""Sources: quote payloads, provider messages, ledgers; provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE_SCHEMA = "event_id long, symbol string, price decimal(18,2), bid decimal(18,2), ask decimal(18,2), sequence long, provider string, provider_timestamp timestamp_ntz, received_at timestamp_ntz"
TRADES_SCHEMA = "channel string, sequence_num long, events array<struct<type:string, trades:array<struct<trade_id:string, product_id:string, price:string, size:string, side:string, time:string>>>>"
#: Fixed values that the recorder adds to every record.
PROVENANCE = {"provenance_system": "tickloom", "provenance_component": "recorder", "provenance_transport": "stream"}


def read_quotes(spark: SparkSession, path: str) -> DataFrame:
    """Quote payloads, one JSON object a line; broken lines keep their text in _corrupt."""
    return parse_quotes(spark.read.text(path), QUOTE_SCHEMA)


def parse_quotes(lines: DataFrame, schema: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return lines.select(F.from_json("value", f"{schema}, _corrupt string", options).alias("q")).select("q.*")


def trade_messages(trades: DataFrame) -> DataFrame:
    """Trade prints to provider messages as JSON lines, nested the way the provider sends them."""
    one = F.struct(F.col("pos"), F.struct(F.col("pos").cast("string").alias("trade_id"), F.col("product").alias("product_id"), F.col("price").cast("string").alias("price"), F.col("size").cast("string").alias("size"), "side", F.col("time").cast("string").alias("time")).alias("t"))
    grouped = trades.groupBy("message").agg(F.array_sort(F.collect_list(one)).alias("ts"))
    events = F.array(F.struct(F.lit("update").alias("type"), F.transform("ts", lambda x: x["t"]).alias("trades")))
    return grouped.select(F.to_json(F.struct(F.lit("market_trades").alias("channel"), F.col("message").alias("sequence_num"), events.alias("events"))).alias("value"))


def explode_trades(lines: DataFrame) -> DataFrame:
    """Provider messages to one row a trade, in array order."""
    m = lines.select(F.from_json("value", TRADES_SCHEMA).alias("m")).filter("m.channel = 'market_trades'")
    e = m.select(F.col("m.sequence_num").alias("message"), F.posexplode("m.events").alias("event_pos", "e"))
    t = e.select("message", "event_pos", F.posexplode("e.trades").alias("pos", "t"))
    return t.select("message", "event_pos", "pos", F.col("t.product_id").alias("product"), F.col("t.price").try_cast("decimal(18,2)").alias("price"), F.col("t.size").try_cast("decimal(18,2)").alias("size"), F.col("t.side").alias("side"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger files of JSON lines: ledger (its file), line (place in the file from 0) and value, the text.

    Files are read in splits side by side; a line's place follows from its split's start and its order there.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("ledger"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    place = F.row_number().over(Window.partitionBy("ledger").orderBy("_start", "_at")) - 1
    return rows.select("ledger", place.cast("long").alias("line"), "value")


def write_ledger(ledger: DataFrame, path: str, key: str, order: str) -> None:
    """Ledger lines in order, one folder a ledger."""
    ledger.repartition(key).sortWithinPartitions(key, order).select(key, "value").write.partitionBy(key).text(path)


def add_provenance(rows: DataFrame) -> DataFrame:
    """Adds the provenance constants; a row set that already has one of them is refused."""
    taken = sorted(set(PROVENANCE) & set(rows.columns))
    if taken:
        raise ValueError(f"reserved columns: {taken}")
    return rows.withColumns({c: F.lit(v) for c, v in PROVENANCE.items()})
