"""Provider feeds to quotes: as-of tickers, trade batches, sequence numbers and event ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalar import uuid5
from tickloom.operators.scan import last_before, running_count, scan


#: Arrival numbers in a slice: a product's rows are ordered slice by slice, side by side.
SLICE = 1_000_000


def asof_tickers(trades: DataFrame, tickers: DataFrame, at: str = "arrival", width: int = SLICE) -> DataFrame:
    """Adds the whole latest ticker of the product that arrived before the trade (or with it); null where there is none.

    One union and one scan by slices of arrival: no range join, and a busy product is many tasks.
    """
    values = [c for c in tickers.columns if c != "product"]
    names = [c for c in trades.columns if c not in ("product", at)]
    ticker_type = tickers.select(F.struct(*values).alias("x")).schema["x"].dataType
    t = trades.select("product", at, F.lit(1).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).cast(ticker_type).alias("ticker"))
    k = tickers.select("product", at, F.lit(0).alias("_side"), F.lit(None).cast(t.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("ticker"))
    both = scan(t.unionByName(k), ["product"], [at, "_side"], {"_last": last_before("ticker", inclusive=True)}, width)
    return both.filter("_side = 1").select("product", at, "_row.*", F.col("_last").alias("ticker"))


def numbered(rows: DataFrame, key: str, at: str, name: str, width: int = SLICE) -> DataFrame:
    """Adds the row's number in its key by `at`, from 1."""
    return scan(rows, [key], [at], {name: running_count(inclusive=True)}, width)


def trade_batches(trades: DataFrame) -> DataFrame:
    """One row a message and product: last price in order, volumes by aggressor, count, latest time; bad messages go whole.

    A maker's sell is an aggressive buy. A message with any price that is not positive is left out.
    """
    dec = "decimal(18,2)"
    per = trades.groupBy("message", "product").agg(
        F.max_by("price", "pos").alias("price"), F.sum("size").cast(dec).alias("volume"), F.sum(F.when(F.col("side") == "SELL", F.col("size")).otherwise(0)).cast(dec).alias("buy_volume"),
        F.sum(F.when(F.col("side") == "BUY", F.col("size")).otherwise(0)).cast(dec).alias("sell_volume"), F.count("*").alias("trade_count"), F.max("time").alias("provider_timestamp"),
        F.array_sort(F.collect_list("pos")).alias("trade_ids"), F.max((F.col("price") <= 0).cast("int")).alias("_bad"),
    )
    return per.withColumn("_bad", F.max("_bad").over(Window.partitionBy("message"))).filter("coalesce(_bad, 0) = 0").drop("_bad")


def normalize(trades: DataFrame, tickers: DataFrame) -> DataFrame:
    """Trade batches with the ticker's bid and ask, a local sequence of each product and a name-based event id."""
    batches = trade_batches(trades).withColumn("arrival", F.col("message"))
    out = asof_tickers(batches, tickers).withColumn("bid", F.col("ticker.bid")).withColumn("ask", F.col("ticker.ask")).drop("ticker", "arrival")
    name = F.concat_ws(":", "product", F.col("message").cast("string"), F.array_join(F.transform("trade_ids", lambda x: x.cast("string")), ","))
    return numbered(out, "product", "message", "local_sequence").withColumn("event_id", uuid5(name))
