"""Market-event views over the driver's tables: each as a DataFrame and as a DuckDB common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quote events: one provider for each user, five symbols, planted sequence gaps and late arrivals."""
    e = events(spark, sf_dir).withColumn("price", F.col("value").cast("decimal(18,2)")).withColumn("symbol", F.upper("event_type"))
    rn = F.row_number().over(Window.partitionBy("user_id", "symbol").orderBy("event_id")).cast("long")
    tick = F.lit("0.01").cast("decimal(18,2)")
    return e.withColumn("rn", rn).select(
        "event_id", "symbol", "price", (F.col("price") - tick).cast("decimal(18,2)").alias("bid"), (F.col("price") + tick).cast("decimal(18,2)").alias("ask"),
        F.col("ts").alias("provider_timestamp"), (F.col("ts") + F.make_dt_interval(secs=F.col("k") / F.lit(1000).cast("decimal(18,6)"))).alias("received_at"),
        (F.col("rn") + F.when(F.col("k") % 17 == 0, 3).when(F.col("k") % 23 == 0, -2).otherwise(0)).cast("long").alias("sequence"),
        F.concat(F.lit("P"), F.col("user_id")).alias("provider"), (F.col("event_id") * 10 + F.when(F.col("k") % 13 == 0, 25).otherwise(0)).cast("long").alias("arrival"),
        "user_id", "k",
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes and re-deliveries of every row with k % 11 = 0."""
    q = quotes(spark, sf_dir)
    return q.unionByName(q.filter("k % 11 = 0").withColumn("arrival", F.col("arrival") + 31))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client points: generation, last size and cumulative volume, each missing on a third of the rows."""
    q = quotes(spark, sf_dir)
    run = Window.partitionBy("user_id", "symbol").orderBy("arrival", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return q.withColumn("generation", (1 + F.floor(F.dayofmonth("provider_timestamp") / 10)).cast("long")).withColumn(
        "last_size", F.when(F.col("k") % 3 == 0, (F.col("k") / 10).cast("decimal(18,1)"))
    ).withColumn("cumulative", F.when(F.col("k") % 3 == 1, F.sum("k").over(run)).cast("decimal(18,1)"))


def tier_of():
    u = F.col("user_id") % 20
    return F.when(u < 14, "basic").when(u < 19, "pro").otherwise("premium")


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("user_id").alias("client_id"), F.upper("event_type").alias("symbol"), tier_of().alias("tier")).distinct()


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscription intervals: connection, symbol, from and expiry by minutes."""
    return events(spark, sf_dir).select(F.col("user_id").alias("connection"), F.upper("event_type").alias("symbol"), F.col("ts").alias("start"), (F.col("ts") + F.make_dt_interval(mins=(F.col("k") + 1).cast("int"))).alias("expires"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade prints: a message for each order, its lines in a fixed order."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("product")), "l_partkey")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"))
    return l.select(
        F.col("l_orderkey").alias("message"), pos.cast("long").alias("pos"), "product", (F.expr("(2 * cast(round(l_extendedprice * 100) AS bigint) + cast(l_quantity AS bigint)) DIV (2 * cast(l_quantity AS bigint))").cast("decimal(16,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)").alias("price"),
        F.col("l_quantity").cast("decimal(18,2)").alias("size"), F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("side"), F.col("l_shipdate").alias("time"), F.col("l_orderkey").alias("arrival"),
    )


def tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    bid = F.col("o_totalprice").cast("decimal(18,2)")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("arrival"), F.concat(F.lit("Brand#"), F.col("o_custkey") % 25 + 1).alias("product"), bid.alias("bid"),
        (bid + F.lit("0.10").cast("decimal(18,2)")).cast("decimal(18,2)").alias("ask"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("bid_qty"), F.col("o_orderdate").alias("time"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    key = F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd HH"))
    return e.select(key.alias("idempotency_key"), F.col("user_id").alias("client_id"), "event_type", F.col("k").alias("quantity"), F.col("ts").alias("created_at"), "event_id")


CTES = """WITH ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
quotes AS (SELECT event_id, upper(event_type) AS symbol, CAST(value AS DECIMAL(18,2)) AS price, CAST(CAST(value AS DECIMAL(18,2)) - 0.01 AS DECIMAL(18,2)) AS bid, CAST(CAST(value AS DECIMAL(18,2)) + 0.01 AS DECIMAL(18,2)) AS ask,
  ts AS provider_timestamp, ts + to_milliseconds(k) AS received_at,
  CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) + CASE WHEN k % 17 = 0 THEN 3 WHEN k % 23 = 0 THEN -2 ELSE 0 END AS BIGINT) AS sequence,
  'P' || user_id AS provider, CAST(event_id * 10 + CASE WHEN k % 13 = 0 THEN 25 ELSE 0 END AS BIGINT) AS arrival, user_id, k FROM ev),
deliveries AS (SELECT * FROM quotes UNION ALL SELECT * REPLACE (arrival + 31 AS arrival) FROM quotes WHERE k % 11 = 0),
points AS (SELECT *, CAST(1 + floor(day(provider_timestamp) / 10) AS BIGINT) AS generation, CASE WHEN k % 3 = 0 THEN CAST(k / 10 AS DECIMAL(18,1)) END AS last_size,
  CASE WHEN k % 3 = 1 THEN CAST(sum(k) OVER (PARTITION BY user_id, symbol ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,1)) END AS cumulative FROM quotes),
subscriptions AS (SELECT DISTINCT user_id AS client_id, upper(event_type) AS symbol, CASE WHEN user_id % 20 < 14 THEN 'basic' WHEN user_id % 20 < 19 THEN 'pro' ELSE 'premium' END AS tier FROM events),
intervals AS (SELECT user_id AS connection, upper(event_type) AS symbol, ts AS start, ts + to_minutes(k + 1) AS expires FROM ev),
trades AS (SELECT l_orderkey AS message, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS pos, p_brand AS product,
  CAST(CAST((2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT)) // (2 * CAST(l_quantity AS BIGINT)) AS DECIMAL(16,0)) * 0.01 AS DECIMAL(18,2)) AS price, CAST(l_quantity AS DECIMAL(18,2)) AS size, CASE WHEN l_linestatus = 'O' THEN 'BUY' ELSE 'SELL' END AS side, l_shipdate AS time, l_orderkey AS arrival
  FROM lineitem JOIN part ON p_partkey = l_partkey),
tickers AS (SELECT o_orderkey AS arrival, 'Brand#' || (o_custkey % 25 + 1) AS product, CAST(o_totalprice AS DECIMAL(18,2)) AS bid, CAST(CAST(o_totalprice AS DECIMAL(18,2)) + 0.10 AS DECIMAL(18,2)) AS ask, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS bid_qty, o_orderdate AS time FROM orders),
usage AS (SELECT user_id || '|' || event_type || '|' || strftime(ts, '%Y-%m-%d %H') AS idempotency_key, user_id AS client_id, event_type, k AS quantity, ts AS created_at, event_id FROM ev),
c1 AS (SELECT symbol, time_bucket(INTERVAL 1 MINUTE, provider_timestamp) AS open_time, arg_min(price, (provider_timestamp, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (provider_timestamp, event_id)) AS close, count(*) AS n,
  min(provider_timestamp) AS first_ts, max(provider_timestamp) AS last_ts, arg_min(event_id, (provider_timestamp, event_id)) AS first_id, arg_max(event_id, (provider_timestamp, event_id)) AS last_id FROM quotes GROUP BY ALL)
"""
