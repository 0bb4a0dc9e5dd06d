"""The reference's expected values on tiny tables, and properties it states."""

import datetime as dt
import json
import threading
import uuid
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tickloom.functions import scalar as fn
from tickloom.operators import candles as cd
from tickloom.operators import fanout as fo
from tickloom.operators import ledger as lg
from tickloom.operators import metrics as mt
from tickloom.operators import quality as ql
from tickloom.plans import fixtures as fx
from tickloom.operators.machines import TemporalGuard
from tickloom.queries.market import QUERIES
from tickloom.streaming import jobs
from tickloom.streaming.stateful import machine_stream

T0 = dt.datetime(2026, 8, 4, 10, 0)


def quotes(spark, rows):
    return spark.createDataFrame([("AAPL", T0 + dt.timedelta(seconds=s), i, D(p)) for s, i, p in rows], "symbol string, provider_timestamp timestamp_ntz, event_id long, price decimal(18,2)")


def test_candle_open_close_by_event_time(spark):
    r = cd.candles_1m(quotes(spark, [(30, 1, "101"), (10, 2, "99"), (50, 3, "105")])).first()
    assert (r.open, r.high, r.low, r.close, r.n) == (99, 105, 99, 105, 3)


def test_candle_ties_by_id(spark):
    r = cd.candles_1m(quotes(spark, [(5, 2, "102"), (5, 1, "101")])).first()
    assert (r.open, r.close) == (101, 102)


def test_rollup_and_closed_buckets(spark):
    m = cd.candles_1m(quotes(spark, [(0, 1, "100"), (10, 2, "102"), (120, 3, "98"), (130, 4, "98")]))
    r = cd.rollup_candles(m, "5m").collect()
    assert [(x.open, x.high, x.low, x.close, x.n) for x in r] == [(100, 102, 98, 98, 4)]
    assert cd.rollup_candles(m, "5m", end=F.lit("2026-08-04 10:02:30").cast("timestamp_ntz")).count() == 0


def test_candles_do_not_depend_on_order_or_redelivery(spark, sf_dir):
    q = fx.quotes(spark, sf_dir)
    whole = sorted(map(tuple, cd.candles_1m(q).collect()))
    twice = ql.first_seen(fx.deliveries(spark, sf_dir).orderBy(F.desc("arrival")), "event_id", ["arrival"])
    assert sorted(map(tuple, cd.candles_1m(twice).collect())) == whole
    direct = cd.candles_1m(q, 3600).select("symbol", "open_time", "open", "close", "n")
    rolled = cd.rollup_candles(cd.candles_1m(q), "1h").select("symbol", "open_time", "open", "close", "n")
    assert direct.exceptAll(rolled).count() == 0


def test_recorder_sequences(spark):
    rows = spark.createDataFrame([(1, 10, 1), (2, 10, 1), (3, 13, 1)], "arrival long, sequence long, session long")
    got = [(r.duplicate, r.gap_size) for r in ql.recorder_filter(rows, ["session"], ["arrival"]).orderBy("arrival").collect()]
    assert got == [(False, 0), (True, 0), (False, 2)]
    rows = spark.createDataFrame([(1, 1, 1), (2, 3, 1), (3, 2, 1)], "arrival long, sequence long, session long")
    got = [(r.gap, r.out_of_order) for r in ql.sequence_anomalies(rows, ["session"], ["arrival"]).orderBy("arrival").collect()]
    assert got == [(1, False), (0, True)]


def points(spark, rows):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    return spark.createDataFrame([("k", i, g, at(t), s, e) for i, (g, t, s, e) in enumerate(rows)], "key string, arrival long, generation long, provider_timestamp timestamp_ntz, sequence long, event_id long")


def judged(spark, rows):
    return [(r.outcome, r.reason, r.missing) for r in ql.temporal_integrity(points(spark, rows), ["key"], ["arrival"]).orderBy("arrival").collect()]


def test_temporal_integrity(spark):
    assert judged(spark, [(1, 1, 1, 1), (1, 4, 4, 4), (1, 4, 4, 4)]) == [("accepted", "initial", 0), ("accepted", "sequence_gap", 2), ("duplicate", "duplicate_event", 0)]
    assert judged(spark, [(1, 5, 5, 5), (1, 4, 6, 6), (1, 7, 4, 7)])[1:] == [("quarantined", "timestamp_rollback", 0), ("quarantined", "sequence_regression", 0)]
    assert judged(spark, [(1, 10, 10, 10), (1, 10, 15, 15)])[1] == ("accepted", "sequence_gap", 4)
    # A snapshot of a new generation at an earlier time is quarantined and does not move the state.
    assert judged(spark, [(1, 10, 10, 10), (2, 2, 2, 2), (1, 11, 11, 11), (2, 12, 1, 12), (1, 13, 13, 13)])[1:] == [
        ("quarantined", "timestamp_rollback", 0), ("accepted", "advanced", 0), ("accepted", "generation_advanced", 0), ("quarantined", "stale_generation", 0),
    ]
    # A null sequence leaves the last one, also when the generation advances.
    assert judged(spark, [(1, 1, 5, 1), (2, 2, None, 2), (2, 3, 5, 3), (2, 3, 6, 4)])[2:] == [("quarantined", "sequence_regression", 0), ("accepted", "advanced", 0)]


def test_temporal_integrity_over_the_table(spark, sf_dir):
    """The fold against a plain loop over all points."""
    got = {(r.provider, r.symbol, r.arrival, r.event_id): (r.outcome, r.reason, r.missing) for r in ql.temporal_integrity(fx.points(spark, sf_dir), ["provider", "symbol"], ["arrival", "event_id"]).collect()}
    last, want = {}, {}
    for r in sorted(fx.points(spark, sf_dir).collect(), key=lambda r: (r.arrival, r.event_id)):
        k = (r.provider, r.symbol)
        w = last.get(k)
        if w is None:
            out = ("accepted", "initial", 0)
        elif r.generation < w["g"]:
            out = ("quarantined", "stale_generation", 0)
        elif r.event_id in w["ids"]:
            out = ("duplicate", "duplicate_event", 0)
        elif r.provider_timestamp < w["t"]:
            out = ("quarantined", "timestamp_rollback", 0)
        elif r.generation > w["g"]:
            out = ("accepted", "generation_advanced", 0)
        elif None not in (r.sequence, w["s"]) and r.sequence <= w["s"]:
            out = ("quarantined", "sequence_regression", 0)
        else:
            gap = r.sequence - w["s"] - 1 if None not in (r.sequence, w["s"]) else 0
            out = ("accepted", "sequence_gap" if gap else "same_timestamp" if r.provider_timestamp == w["t"] else "advanced", gap)
        want[*k, r.arrival, r.event_id] = out
        if out[0] == "accepted":
            w = last.setdefault(k, {"ids": set(), "s": None})
            w.update(g=r.generation, t=r.provider_timestamp, s=w["s"] if r.sequence is None else r.sequence)
            w["ids"].add(r.event_id)
    assert got == want and len({o[1] for o in want.values()}) > 2


def test_slow_consumer_warns_by_growth_since_the_last_warning(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate([60, 60, 30, 60, 10, 100, 0])] + [(2, 0, 150), (2, 1, 60)], "user_id long, arrival long, coalesced long")
    got = sorted((r.user_id, r.arrival, r.total) for r in fo.slow_consumer_warnings(rows, "user_id", ["arrival"], 100).collect())
    assert got == [(1, 1, 120), (1, 4, 220), (1, 5, 320), (2, 0, 150)]


def test_outages_end_at_the_next_success(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = spark.createDataFrame([("p", at(i), i, x) for i, x in enumerate("oofffoofof")] + [("q", at(0), 0, "o")], "provider string, at timestamp_ntz, event_id long, state string")
    got = sorted(((r.since - T0).seconds, r.until and (r.until - T0).seconds, r.reconnects) for r in mt.outages(rows, ["provider"], ["at", "event_id"], F.col("state") == "f").collect())
    assert got == [(2, 5, 3), (7, 8, 1), (9, None, 1)]


def test_alert_rules(spark):
    rows = spark.createDataFrame([(1, T0 + dt.timedelta(seconds=10 * i), 0 if 2 <= i <= 6 else 1, 0.9) for i in range(20)], "gateway long, at timestamp_ntz, provider_connected int, archive_backlog_ratio double")
    got = {(r.alert, r.severity): r.samples for r in mt.alerts(rows, ["gateway"], "at").collect()}
    assert got == {("provider_disconnected", "critical"): 5, ("archive_trim_imminent", "critical"): 20}
    with pytest.raises(ValueError):
        mt.alerts(rows.select("gateway", "at"), ["gateway"], "at")


def test_nulls_break_the_rules_that_need_a_value(spark):
    base = {"symbol": "A", "price": D(1), "bid": None, "ask": None, "provider_timestamp": T0, "received_at": T0, "sequence": 1, "provider": None}
    rows = spark.createDataFrame([base], "symbol string, price decimal(9,2), bid decimal(9,2), ask decimal(9,2), provider_timestamp timestamp_ntz, received_at timestamp_ntz, sequence long, provider string")
    assert ql.validate(rows, ql.quote_rules()).first().errors == "V7"
    schema = "schema_version string, capabilities array<string>, volume decimal(9,2), volume_kind string, window_ms long, volume_unit string, volume_currency string, buy_volume decimal(9,2), sell_volume decimal(9,2), trade_count long, bid_depth decimal(9,2), ask_depth decimal(9,2), depth_unit string, depth_currency string, depth_levels int"
    row = lambda v, caps, buy: (v, caps, None, None, None, None, None, buy, buy, None, None, None, None, None, None)
    rows = spark.createDataFrame([row(None, None, None), row("1.0", ["level1_quote", "aggressor_flow"], D(1)), row("1.0", ["level1_quote"], None)], schema)
    assert [r.errors for r in ql.validate(rows, ql.evidence_rules()).collect()] == ["V1,V9", "V18,V19", ""]
    lines = spark.createDataFrame([('{"a":1,"zz":2}',), ('{"a":1}',)], "value string")
    assert [r.unknown for r in ql.unknown_fields(lines, ["a", "b"]).collect()] == ["zz", ""]


def test_fold_equals_window(spark, sf_dir):
    q = fx.quotes(spark, sf_dir).withColumn("generation", F.lit(1)).withColumn("sequence", F.lit(None).cast("long"))
    fold = ql.temporal_integrity(q, ["provider", "symbol"], ["arrival", "event_id"]).filter("reason = 'timestamp_rollback'")
    assert {r.event_id for r in fold.collect()} == {r.event_id for r in ql.rollbacks(q, ["provider", "symbol"], ["arrival", "event_id"]).collect()}


def test_token_bucket_and_windows(spark):
    df = spark.createDataFrame([("c", T0, i) for i in range(12)], "client string, ts timestamp_ntz, event_id long")
    allowed = [r.allowed for r in fo.token_bucket(df, "client", "ts", 60).orderBy("event_id").collect()]
    assert allowed == [True] * 10 + [False] * 2
    assert [r.allowed for r in fo.anchored_window_limit(df.limit(3), "client", "ts", 2).orderBy("event_id").collect()] == [True, True, False]


def test_ttl_is_not_extended(spark):
    df = spark.createDataFrame([("e", T0 + dt.timedelta(seconds=s), s) for s in (0, 3000, 3600, 4000)], "event_id string, at timestamp_ntz, arrival long")
    assert [r.accepted for r in ql.dedupe_ttl(df, "event_id", "at", 3600).orderBy("arrival").collect()] == [True, False, True, False]


def test_activation_survives_gaps_within_grace(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    df = spark.createDataFrame([(1, "A", at(0), at(10)), (2, "A", at(12), at(20)), (1, "A", at(60), at(70))], "connection long, symbol string, start timestamp_ntz, expires timestamp_ntz")
    assert [r.subscriptions for r in fo.activations(df).orderBy("activate_at").collect()] == [2, 1]


def test_symbol_stays_active_while_any_connection_holds_it(spark, sf_dir):
    import duckdb

    from tickloom.queries import QUERIES, SQL

    at = lambda s: T0 + dt.timedelta(seconds=s)
    df = spark.createDataFrame([(1, "A", at(0), at(10)), (2, "A", at(5), at(30)), (1, "A", at(33), at(40)), (1, "A", at(60), at(70)), (2, "B", at(0), at(1))], "connection long, symbol string, start timestamp_ntz, expires timestamp_ntz")
    got = sorted((r.symbol, r.activate_at, r.release_at, r.subscriptions) for w in (5, 86_400) for r in fo.activations(df, width=w).collect())
    assert got == sorted([("A", at(0), at(43), 3), ("A", at(60), at(73), 1), ("B", at(0), at(4), 1)] * 2)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    for t in ("lineitem", "part", "orders"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rows = QUERIES["W8_symbol_activation"](spark, sf_dir).select("symbol", "activate_at", "release_at", "subscriptions").collect()
    assert sorted(map(tuple, rows)) == sorted(db.execute(SQL["W8_symbol_activation"]).fetchall())


def test_buffer_counts(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(1, x, at(i), i) for i, x in enumerate("AABC")] + [(2, x, at(i), i) for i, x in enumerate("ABACB")]
    df = spark.createDataFrame(rows, "user_id long, symbol string, received_at timestamp_ntz, arrival long")
    got = {r.user_id: (r.coalesced, r.dropped, r.depth) for r in fo.buffer_counts(df, "user_id", 2).collect()}
    assert got == {1: (1, 1, 2), 2: (1, 2, 2)}


def test_deliveries_are_counted_without_making_them(spark, tmp_path):
    """Equal to the rows of the fan-out, with nulls and repeated rows; 4 * 10^10 deliveries of the query end in time."""
    q = spark.createDataFrame([(s, i) for i, s in enumerate(["A", "A", "A", "B", None, "C"])], "symbol string, event_id long")
    subs = spark.createDataFrame([(1, "A"), (1, "A"), (2, "A"), (None, "A"), (2, "B"), (1, None), (3, "D")], "client_id long, symbol string")
    rows = fo.fanout(q, subs).groupBy("client_id", "symbol").agg(F.count("*").alias("deliveries"))
    counted = fo.delivery_counts(q, subs, "client_id")
    assert counted.columns == rows.columns and sorted(map(str, counted.collect())) == sorted(map(str, rows.collect())) and counted.count() == 4
    events = spark.range(200_000).selectExpr("id AS event_id", "timestamp_ntz'2026-08-04 10:00:00' AS ts", "id AS user_id", "'view' AS event_type", "1.0D AS value", "'{\"k\": 1}' AS props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    spark.sparkContext.addJobTag("fan-out")
    late = threading.Timer(90, spark.sparkContext.cancelJobsWithTag, ["fan-out"])
    late.start()
    try:
        got = QUERIES["J1_fanout_join"](spark, str(tmp_path)).agg(F.count("*"), F.min("deliveries"), F.max("deliveries")).first()
    finally:
        late.cancel()
        spark.sparkContext.removeJobTag("fan-out")
    assert tuple(got) == (200_000, 200_000, 200_000)


def test_volume_sources(spark):
    df = spark.createDataFrame([("s", 1, D("100"), None), ("s", 2, D("105"), None), ("s", 3, D("107"), D("2"))], "k string, arrival long, cumulative decimal(18,1), last_size decimal(18,1)")
    assert [float(r.volume) for r in cd.volume_delta(df, ["k"], ["arrival"]).orderBy("arrival").collect()] == [0, 5, 2]


def test_uuid5_equals_python(spark):
    names = ["feed:BTC-USD:1", "é:日本", ""]
    got = [r.u for r in spark.createDataFrame([(n,) for n in names], "n string").select(fn.uuid5(F.col("n")).alias("u")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_validation_rules(spark, sf_dir):
    from tickloom.queries.market import rich

    rows = ql.validate(rich(spark, sf_dir), ql.evidence_rules())
    assert rows.filter("k % 19 = 0").filter(~F.col("errors").contains("V20")).count() == 0
    assert rows.filter("k = 1").filter("errors <> ''").count() == 0


def tampered(spark, change):
    """The violation of the second of three lines, whose record `change` alters."""
    rows = spark.createDataFrame([("l", i, "1.50") for i in range(3)], "ledger string, arrival long, price string")
    lines = [json.loads(r.value) for r in lg.build_ledger(rows, "ledger", ["arrival"], ["price"]).orderBy("ledger_index").collect()]
    text = change(lines[1])
    values = [json.dumps(lines[0]), text if isinstance(text, str) else json.dumps(lines[1] | text), json.dumps(lines[2])]
    df = spark.createDataFrame([("l", i, v) for i, v in enumerate(values)], "ledger string, line long, value string")
    first = lg.first_violation(lg.verify_ledger(df, "ledger", "line"), "ledger", "line").first()
    return first and (first.line, first.violation)


def test_ledger_chain_and_tampering(spark):
    # Key order and white space do not matter; nested fields of the same name are kept.
    assert tampered(spark, lambda r: json.dumps(dict(reversed(r.items())), indent=1).replace("\n", " ")) is None
    assert tampered(spark, lambda r: {"price": "9.50"}) == (1, "record_hash mismatch")
    assert tampered(spark, lambda r: {"price": {"record_hash": "0" * 64}}) == (1, "record_hash mismatch")
    assert tampered(spark, lambda r: "[1]") == (1, "not a record") and tampered(spark, lambda r: "{") == (1, "not a record")
    assert tampered(spark, lambda r: {"ledger_version": "2.0"}) == (1, "version") and tampered(spark, lambda r: {"ledger_algorithm": "md5"}) == (1, "algorithm")
    assert tampered(spark, lambda r: {"ledger_index": 7}) == (1, "index") and tampered(spark, lambda r: {"ledger_index": "1"}) == (1, "index")
    assert tampered(spark, lambda r: {"provenance_component": "x"}) == (1, "provenance_component")
    assert tampered(spark, lambda r: {"recorder_session_id": " "}) == (1, "recorder_session_id")
    assert tampered(spark, lambda r: {"previous_record_hash": "A" * 64}) == (1, "previous_record_hash form") and tampered(spark, lambda r: {"previous_record_hash": "a" * 64}) == (1, "previous_record_hash mismatch")
    assert tampered(spark, lambda r: {"record_hash": "x"}) == (1, "record_hash form")
    rows = spark.createDataFrame([("l", 1, "x")], "ledger string, arrival long, ledger_index string")
    for payload, session in ((["ledger_index"], "s"), (["arrival"], " ")):
        with pytest.raises(ValueError):
            lg.build_ledger(rows, "ledger", ["arrival"], payload, session)


def test_ledger_goes_on_after_a_sound_chain_alone(spark):
    rows = spark.createDataFrame([("l", i, "1.50") for i in range(5)], "ledger string, arrival long, price string")
    as_lines = lambda built: built.select("ledger", F.col("ledger_index").alias("line"), "value")
    one = as_lines(lg.build_ledger(rows.filter("arrival < 3"), "ledger", ["arrival"], ["price"]))
    two = as_lines(lg.continue_ledger(one, rows.filter("arrival >= 3"), "ledger", "line", ["arrival"], ["price"], "later"))
    got = lg.summary(lg.verify_ledger(one.unionByName(two), "ledger", "line"), "ledger", "line").first()
    assert (got.records, got.sessions, got.verified) == (5, ["later", "session-1"], True)
    bad = one.withColumn("value", F.replace("value", F.lit("1.50"), F.lit("9.50")))
    with pytest.raises(Exception, match="broken ledger"):
        lg.continue_ledger(bad, rows, "ledger", "line", ["arrival"], ["price"], "later").collect()


def test_prices_of_zero_are_not_tampered_with(spark, tmp_path):
    """Of a provider's records 97, 194, 291, ... those with a price above zero break its ledger, as the SQL has it."""
    prices = {97: 0.0, 194: 5.0, 195: 5.0, 291: 7.0, 388: None, 485: 1.0}
    rows = [(i, T0 + dt.timedelta(seconds=i), user, "view", price, '{"k": 1}') for user in (1, 2) for i, price in prices.items() if user == 1 or i not in (194, 291)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in QUERIES["L3_first_violation"](spark, str(tmp_path)).collect()] == [("P1", 1, "record_hash mismatch")]
    assert sorted((r.provider, r.line) for r in QUERIES["L2_verify_ledger"](spark, str(tmp_path)).filter("violation IS NOT NULL").collect()) == [("P1", 1), ("P1", 3)]


def test_backlog_without_group(spark):
    log = spark.createDataFrame([(1,), (2,), (3,)], "entry_id long")
    acks = spark.createDataFrame([("a", 1, None)], "`group` string, entry_id long, acked_at timestamp_ntz")
    groups = spark.createDataFrame([("a",), ("none",)], "`group` string")
    got = {r.group: (r.pending, r.undelivered, r.backlog, r.headroom) for r in mt.consumer_backlog(log, acks, groups, 10).collect()}
    assert got == {"a": (1, 2, 3, 7), "none": (0, 3, 3, 7)}


def test_provenance_refuses_reserved(spark):
    from tickloom.sources.readers import add_provenance

    with pytest.raises(ValueError):
        add_provenance(spark.createDataFrame([("x",)], "provenance_system string"))


def test_streams_equal_batch(spark, sf_dir, tmp_path):
    q = fx.quotes(spark, sf_dir).select("symbol", "provider_timestamp", "event_id", "price")
    q.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = jobs.quote_stream(spark, str(tmp_path / "in"), q.schema)
    jobs.run_available(stream, str(tmp_path / "cp"), jobs.archive_batch(str(tmp_path / "out")))
    got = jobs.read_archive(spark, str(tmp_path / "out")).select("symbol", F.col("open_time").cast("timestamp_ntz"), "open", "close", "n")
    want = cd.candles_1m(q).select("symbol", "open_time", "open", "close", "n")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_stateful_stream_equals_fold_and_lag_is_kept(spark, sf_dir, tmp_path):
    p = fx.points(spark, sf_dir).select("provider", "symbol", "arrival", "event_id", "generation", "sequence", "provider_timestamp")
    cut = p.agg(F.percentile_approx("arrival", 0.5)).first()[0]
    listener = jobs.LagListener()
    spark.streams.addListener(listener)
    try:
        for part in (p.filter(F.col("arrival") <= cut), p.filter(F.col("arrival") > cut)):  # two runs over one checkpoint: state survives a restart
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = machine_stream(spark.readStream.schema(p.schema).parquet(str(tmp_path / "in")), ["provider", "symbol"], "provider_timestamp", ["arrival", "event_id"], TemporalGuard(), arrival=True)
            run = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
            run.awaitTermination()
    finally:
        spark.streams.removeListener(listener)
    got = spark.read.parquet(str(tmp_path / "out")).select("arrival", "event_id", "outcome", "reason", "missing")
    want = ql.temporal_integrity(p, ["provider", "symbol"], ["arrival", "event_id"]).select(*got.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    assert listener.table(spark).agg(F.sum("rows")).first()[0] == p.count()


def test_ledger_files_round_trip(spark, tmp_path):
    from tickloom.sources.readers import read_ledger, write_ledger

    rows = spark.createDataFrame([(k, i, "1.50") for k in ("a", "b") for i in range(20)], "ledger string, arrival long, price string")
    built = lg.build_ledger(rows, "ledger", ["arrival"], ["price"])
    write_ledger(built, str(tmp_path / "l"), "ledger", "ledger_index")
    verified = lg.verify_ledger(read_ledger(spark, str(tmp_path / "l")), "ledger", "line")
    assert [(r.records, r.verified) for r in lg.summary(verified, "ledger", "line").collect()] == [(20, True), (20, True)]
    # The file's own order is judged: lines that changed places are found.
    file = next((tmp_path / "l" / "ledger=a").glob("part-*"))
    lines = file.read_text().splitlines()
    (tmp_path / "swapped").mkdir()
    (tmp_path / "swapped" / "x.jsonl").write_text("\n".join([*lines[:5], lines[6], lines[5], *lines[7:]]) + "\n")
    bad = lg.first_violation(lg.verify_ledger(read_ledger(spark, str(tmp_path / "swapped")), "ledger", "line"), "ledger", "line").first()
    assert (bad.line, bad.violation) == (5, "index")


def test_closed_candles_and_first_deliveries(spark, tmp_path):
    q = quotes(spark, [(0, 1, "1"), (10, 2, "2"), (10, 2, "2"), (7 * 3600, 3, "3")])
    q.write.parquet(str(tmp_path / "in"))
    stream = jobs.quote_stream(spark, str(tmp_path / "in"), q.schema)
    for name, rows in (("closed", jobs.closed_candles(stream)), ("firsts", jobs.first_deliveries(stream))):
        run = rows.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        run.awaitTermination()
    assert [(r.open, r.close, r.n) for r in spark.table("closed").collect()] == [(1, 2, 3)]
    assert sorted(r.event_id for r in spark.table("firsts").collect()) == [1, 2, 3]


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and set(e.oracle_sql()) <= set(e.queries())
