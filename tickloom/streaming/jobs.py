"""Structured Streaming twins: closed candles, duplicates within a watermark, idempotent sinks, keyed state, fan-out, lag."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tickloom.operators.candles import merge_candles
from tickloom.operators.quality import latest
from tickloom.streaming.store import Store


def quote_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files of quotes as a stream; event time as TIMESTAMP, as watermarks need it."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withColumn("provider_timestamp", F.col("provider_timestamp").cast("timestamp"))


def closed_candles(quotes: DataFrame, lateness: str = "2 hours", seconds: int = 60) -> DataFrame:
    """Minute candles that no row within the lateness can still change (append mode)."""
    at = F.struct("provider_timestamp", "event_id")
    w = F.window("provider_timestamp", f"{seconds} seconds")
    return quotes.withWatermark("provider_timestamp", lateness).groupBy("symbol", w.alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("n")
    ).select("symbol", F.col("w.start").alias("open_time"), "open", "high", "low", "close", "n")


def first_deliveries(quotes: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """The first delivery of each event within the watermark."""
    return quotes.withWatermark("provider_timestamp", lateness).dropDuplicatesWithinWatermark(["event_id"])


def fanout(quotes: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Stream-static join with the current subscriptions."""
    return quotes.join(subscriptions, "symbol")


def _query(batch: DataFrame) -> str:
    """The streaming query that runs a foreachBatch function: its checkpoint's id."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"


def archive_store(spark: SparkSession, target: str, **sizes: int) -> Store:
    """Partial minute candles; merging them is associative and commutative, so late rows of any age count."""
    return Store(spark, target, ["event_id"], merge_candles, **sizes)


def archive_batch(target: str, **sizes: int):
    """A foreachBatch function that adds partial candles. Each event counts once, whichever batch or query delivers it again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        store, query = archive_store(batch.sparkSession, target, **sizes), _query(batch)
        if store.done(batch_id, query):
            return
        at = F.struct("provider_timestamp", "event_id")
        rows = batch.select("symbol", "provider_timestamp", "event_id", "price").persist()
        fresh = store.fresh(rows, ["provider_timestamp"]).persist()
        part = fresh.groupBy("symbol", F.date_trunc("minute", "provider_timestamp").alias("open_time")).agg(
            F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("n"),
            F.min("provider_timestamp").alias("first_ts"), F.max("provider_timestamp").alias("last_ts"), F.min_by("event_id", at).alias("first_id"), F.max_by("event_id", at).alias("last_id"),
        )
        store.commit(part, batch_id, query, fresh)
        fresh.unpersist()
        rows.unpersist()

    return write


def read_archive(spark: SparkSession, target: str) -> DataFrame | None:
    """The merged minute candles of an archive written by archive_batch; None where there is none."""
    return archive_store(spark, target).read()


def append_new(target: str, keys: list[str], order: list[str] | None = None, **sizes: int):
    """A foreachBatch function that stores each key's first row (of a batch by `order`) and skips keys already stored, by
    whichever batch or query."""

    def write(batch: DataFrame, batch_id: int) -> None:
        store, query = Store(batch.sparkSession, target, keys, **sizes), _query(batch)
        if store.done(batch_id, query):
            return
        rows = batch.persist()
        fresh = store.fresh(rows, order).persist()
        store.commit(fresh, batch_id, query)
        fresh.unpersist()
        rows.unpersist()

    return write


def read_new(spark: SparkSession, target: str, keys: list[str]) -> DataFrame | None:
    """The rows that append_new stored."""
    return Store(spark, target, keys).read()


def latest_store(spark: SparkSession, target: str, key: str, order: list[str], values: list[str], **sizes: int) -> Store:
    names = [*order, *[v for v in values if v not in order]]
    return Store(spark, target, None, lambda rows: latest(rows, key, order, names), **sizes)


def keep_latest(target: str, key: str, order: list[str], values: list[str], **sizes: int):
    """A foreachBatch function that keeps the last row of each key: a batch adds its own last rows, and merges leave one a key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        store = latest_store(batch.sparkSession, target, key, order, values, **sizes)
        store.commit(store.merge(batch), batch_id, _query(batch))

    return write


def latest_table(spark: SparkSession, target: str, key: str, order: list[str], values: list[str]) -> DataFrame | None:
    """A row a key: the last of all that keep_latest was given; None where nothing was."""
    return latest_store(spark, target, key, order, values).read()


class LagListener(StreamingQueryListener):
    """Keeps the newest progress of each query: batches, rows, speeds and what its sources still hold."""

    def __init__(self, most: int = 1000):
        self.progress: deque[tuple] = deque(maxlen=most)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        left = [int(v) for s in p.sources for k, v in s.metrics.items() if k in ("numFilesOutstanding", "maxOffsetsBehindLatest")]
        self.progress.append((p.name or str(p.id), p.batchId, p.timestamp, p.numInputRows, float(p.inputRowsPerSecond), float(p.processedRowsPerSecond), sum(left) if left else None))

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.progress), "query string, batch long, at string, rows long, arriving double, processed double, backlog long")


def run_available(rows: DataFrame, checkpoint: str, sink) -> StreamingQuery:
    """Run a stream over all that is there, in batches, and stop; its own checkpoint makes it an independent consumer."""
    query = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
