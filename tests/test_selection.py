"""Row selection, messages and limits on tiny tables, and folds against plain loops over whole tables."""

import datetime as dt
import math
from decimal import Decimal as D

from pyspark.sql import functions as F

from tickloom.functions import scalar as fn
from tickloom.operators import candles as cd
from tickloom.operators import fanout as fo
from tickloom.operators import metrics as mt
from tickloom.operators import normalise as nm
from tickloom.operators import quality as ql
from tickloom.operators import selection as se
from tickloom.operators import wire as wi
from tickloom.plans import fixtures as fx

T0 = dt.datetime(2026, 8, 4, 10, 0)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_conflation_over_the_table(spark, sf_dir):
    """Each key's sends by a plain loop: at once after the interval, else when it is due, unless a newer quote comes first."""
    q = fx.quotes(spark, sf_dir).withColumn("interval_seconds", F.lit(3600.0))
    got = {r.event_id: (r.sent_at, r.replaced) for r in fo.conflate_latest(q, ["user_id", "symbol"], "received_at").collect()}
    groups = {}
    for r in sorted(q.collect(), key=lambda r: (r.received_at, r.arrival)):
        groups.setdefault((r.user_id, r.symbol), []).append(r)
    hour, want = dt.timedelta(hours=1), {}
    for rows in groups.values():
        last = None
        for r, later in zip(rows, [*rows[1:], None], strict=True):
            due = r.received_at if last is None else max(r.received_at, last + hour)
            if later is not None and r.received_at < due and later.received_at < due:
                want[r.event_id] = (None, True)
            else:
                want[r.event_id], last = (due, False), due
    assert got == want


def test_limits_over_the_table(spark, sf_dir):
    events = fx.events(spark, sf_dir).select("user_id", "ts", "event_id")
    rows = sorted(events.collect(), key=lambda r: (r.ts, r.event_id))
    bucket, window = {}, {}
    want_bucket, want_window = {}, {}
    for r in rows:
        level, last = bucket.get(r.user_id, (5.0, r.ts))
        level = min(5.0, level + (r.ts - last).total_seconds() * 0.5)
        want_bucket[r.event_id] = level >= 1
        bucket[r.user_id] = (level - (level >= 1), r.ts)
        start, n = window.get(r.user_id, (r.ts, 0))
        if (r.ts - start).total_seconds() >= 86_400:
            start, n = r.ts, 0
        window[r.user_id] = (start, n + 1)
        want_window[r.event_id] = n + 1 <= 2
    assert {r.event_id: r.allowed for r in fo.token_bucket(events, "user_id", "ts", 30).collect()} == want_bucket
    assert {r.event_id: r.allowed for r in fo.anchored_window_limit(events, "user_id", "ts", 2, 86_400).collect()} == want_window


def test_connection_limit_over_the_table(spark, sf_dir):
    sessions = fx.intervals(spark, sf_dir).select("connection", "start", "expires")
    live, want = {}, []
    for r in sorted(sessions.collect(), key=lambda r: (r.start, r.expires)):
        mine = [e for e in live.get(r.connection, []) if e > r.start]
        ok = len(mine) < 2
        live[r.connection] = [*mine, r.expires] if ok else mine
        want.append((r.connection, r.start, r.expires, ok))
    assert sorted(map(tuple, fo.connection_limit(sessions, "connection", 2).collect())) == sorted(want)


def test_newest_first_and_capped(spark):
    rows = spark.createDataFrame([(k, i) for k in "ab" for i in range(5)], "k string, i long")
    assert sorted(map(tuple, se.newest(rows, ["k"], ["i"], 2).collect())) == [("a", 3), ("a", 4), ("b", 3), ("b", 4)]
    assert se.first_records(rows, ["k"], ["i"], 0).count() == 10 and se.first_records(rows, ["k"], ["i"], 1).count() == 2
    assert [r.i for r in se.cap_log(rows, ["i", "k"], 3).collect()] == [4, 4, 3]
    assert sorted((r.i, r["first"].k) for r in se.distinct_in_order(rows, "i", ["k"]).collect()) == [(i, "a") for i in range(5)]
    assert se.unseen(rows, spark.createDataFrame([(4,), (4,)], "i long"), ["i"]).count() == 8


def test_history_window(spark):
    start, end = se.history_window(F.lit("2026-08-04 10:17:00").cast("timestamp_ntz"), "5m", 3)
    assert tuple(spark.range(1).select(start.alias("a"), end.alias("b")).first()) == (T0, at(17 * 60))


def test_changes_and_rights(spark):
    old, new = (spark.createDataFrame([(x,) for x in s], "symbol string") for s in ("AAB", "BC"))
    assert sorted(map(tuple, se.changes(old, new).collect())) == [("added", "C"), ("kept", "B"), ("removed", "A")]
    rights = spark.createDataFrame([(1, None, None), (2, ["A"], ["live"]), (3, [], None)], "client long, allowed_symbols array<string>, allowed_channels array<string>")
    asked = spark.createDataFrame([(c, s, ch) for c in (1, 2, 3, 4) for s in "AB" for ch in ("live", "depth")], "client long, symbol string, channel string")
    ok = {(r.client, r.symbol, r.channel) for r in se.entitled(asked, rights, "client", "channel").filter("allowed").collect()}
    assert ok == {(1, "A", "live"), (1, "A", "depth"), (1, "B", "live"), (1, "B", "depth"), (2, "A", "live")}
    assert sorted(map(tuple, se.denied(asked, rights, "client").collect())) == [(2, "B"), (3, "A"), (3, "B"), (4, "A"), (4, "B")]


def test_refresh_needs_the_same_generation_or_a_later_one(spark):
    latest = spark.createDataFrame([("A", 1, 5), ("B", 2, 5)], "symbol string, event_id long, generation long")
    repeats = spark.createDataFrame([("A", 1, 4, 10), ("A", 1, 5, 11), ("A", 1, 6, 12), ("A", 9, 9, 13), ("B", 2, 4, 14)], "symbol string, event_id long, generation long, arrival long")
    assert sorted((r.symbol, r.refreshed_at) for r in se.refreshed(latest, repeats, ["symbol", "event_id"], "arrival", "generation").collect()) == [("A", 12), ("B", None)]


def test_redaction_at_every_depth(spark):
    texts = ['{"a":1,"Auth_Token":{"x":2},"l":[{"my_password":"p","ok":"é"}]}', "[1]", "no json", None]
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(wi.redact_json("t").alias("t")).collect()]
    assert got == ['{"a":1,"Auth_Token":"[redacted]","l":[{"my_password":"[redacted]","ok":"é"}]}', "[1]", "[redacted]", None]


def test_commands_and_captures(spark):
    rows = spark.createDataFrame([("subscribe", [" a", "B", "A", " "]), ("subscribe", [" "]), ("ping", []), ("subscribe", [f"s{i}" for i in range(501)]), ("unsubscribe", None)], "action string, symbols array<string>")
    out = rows.withColumn("s", wi.command_symbols(F.col("symbols"))).withColumn("e", wi.command_errors(F.col("action"), F.col("s"))).collect()
    assert out[0].s == ["A", "B"] and [r.e for r in out] == ["", "symbols_required", "", "too_many_symbols", "symbols_required"]
    controls = spark.createDataFrame([("subscribe", "A"), ("stop", "A"), (None, "?!"), ("subscribe", None)], "action string, symbol string")
    assert [r.errors for r in wi.judge_controls(controls).collect()] == ["", "action", "action,symbol", "symbol"]
    rows = spark.createDataFrame([("a", at(i)) for i in range(3)] + [("b", at(0)), ("b", at(60))] + [("c", at(0))], "session string, at timestamp_ntz")
    got = {r.session: (r.records, r.seconds, r.reason, r.complete) for r in wi.capture_summary(rows, "session", "at", 3, 60).collect()}
    assert got == {"a": (3, 2, "max_records", False), "b": (2, 60, "max_seconds", True), "c": (1, 0, "stream_ended", False)}


def test_prices(spark):
    rows = spark.createDataFrame([("A", D("1.2500")), ("A", D("-1.23456")), ("B", D("3.0")), ("C", D("0.123456789"))], "symbol string, price decimal(20,9)")
    ticks = spark.createDataFrame([("B", D("0.0005"))], "symbol string, tick_size decimal(9,4)")
    got = {r.symbol: (r.places, round(r.min_move, 9)) for r in cd.price_precision(rows, ticks).collect()}
    assert got == {"A": (2, 0.01), "B": (4, 0.0005), "C": (8, 1e-08)}
    shown = rows.select(fn.format_price(F.col("price"), 2).alias("x")).union(rows.limit(1).select(fn.format_price(F.lit(None).cast("decimal(9,2)"), 2))).union(rows.limit(1).select(fn.format_price(F.lit(-0.001), 2)))
    assert [r.x for r in shown.collect()] == ["1.25", "-1.23", "3.00", "0.12", "—", "0.00"]


def test_envelopes(spark):
    rows = spark.createDataFrame([("A", at(60 * i), D(1 + i), D(1 + i), D(1 + i), D(1 + i)) for i in range(3)], "symbol string, open_time timestamp_ntz, open decimal(9,2), high decimal(9,2), low decimal(9,2), close decimal(9,2)")
    series = cd.series_envelope(rows, 2)
    r = series.first()
    assert (r.requested_limit, r.returned_count, r.warnings) == (2, 2, []) and [c.close for c in r.candles] == [2, 3]
    assert cd.series_envelope(rows, 9).first().warnings == ["fewer_candles_than_requested"]
    turned = series.withColumn("candles", F.reverse("candles"))
    errors = [cd.validate_envelope(x).first().errors for x in (series, turned, series.withColumn("returned_count", F.lit(7)), series.withColumn("period_end", F.col("period_start")))]
    assert errors == ["", "order", "count", "period"]


def test_symbols_wanted_and_limits(spark):
    subs = spark.createDataFrame([(1, "basic", "A"), (2, "pro", "A"), (2, "pro", "B"), *[(3, "basic", f"S{i}") for i in range(21)]], "client_id long, tier string, symbol string")
    one = lambda *s: spark.createDataFrame([(x,) for x in s], "symbol string")
    got = {r.symbol: (r.consumers, r.clients, r.live) for r in fo.desired_symbols(subs.filter("client_id < 3"), "client_id", one("A", "B"), one("A")).collect()}
    assert got == {"A": (2, [1, 2], True), "B": (1, [2], False)}
    assert {r.client_id: r.violation for r in fo.symbol_limits(subs, "client_id").collect()} == {1: False, 2: False, 3: True}
    failures = spark.createDataFrame([(1, i, i == 1) for i in range(4)], "entry long, at long, transient boolean")
    assert [r.at for r in ql.exhausted(failures, ["entry"], ["at"], 3).collect()] == [2] and [r.at for r in ql.exhausted(failures, ["entry"], ["at"], 3, F.col("transient")).collect()] == [3]
    assert math.isclose(spark.range(1).select(fo.savings(F.lit(200), F.lit(50)).alias("s")).first().s, 75.0)


def test_asof_and_numbers_do_not_depend_on_slices(spark, sf_dir):
    trades, tickers = fx.trades(spark, sf_dir), fx.tickers(spark, sf_dir)
    rows = lambda width: sorted((r.message, r.pos, r.ticker and r.ticker.bid) for r in nm.asof_tickers(trades, tickers, width=width).collect())
    assert rows(50) == rows(10**9) and any(r[2] for r in rows(50)) and not all(r[2] for r in rows(50))
    few = trades.filter("pos = 1")
    numbers = lambda width: sorted((r.product, r.message, r.i) for r in nm.numbered(few, "product", "message", "i", width).collect())
    assert numbers(50) == numbers(10**9) and numbers(50)[0][2] == 1


def test_rates_and_diagnostics(spark):
    rows = [("s", at(0), 1, "a", True, None, None), ("s", at(5), 2, "b", False, "bad_json", None), ("s", at(6), 3, "a", True, None, "a"), ("s", at(20), 4, "a", False, "bad_json", "a"), ("t", at(0), 5, "a", False, None, None)]
    df = spark.createDataFrame(rows, "session string, at timestamp_ntz, event_id long, channel string, ok boolean, error string, ack string")
    got = {r.session: r for r in mt.session_diagnostics(df, "session", "channel", "at", F.col("ok"), "error", "ack").collect()}
    s, t = got["s"], got["t"]
    assert (s.messages, s.channels, s.max_gap_micros, s.projected, s.max_projected_gap_micros) == (4, 2, 14_000_000, 2, 6_000_000)
    assert (s.by_channel, s.rejects, s.acks) == ({"a": 3, "b": 1}, {"bad_json": 2}, {"a": 2}) and (t.projected, t.max_projected_gap_micros, t.rejects) == (0, None, None)
    rates = {r.session: (r.messages, r["bytes"], r.messages_per_second, r.bytes_per_second) for r in mt.run_rates(df, "session", "at", F.lit(100)).collect()}
    assert rates == {"s": (4, 400, 0.2, 20.0), "t": (1, 100, None, None)}
    one = mt.throughput(df, "at", ["session"], 60, 60, F.lit(100)).filter("session = 's'").first()
    assert (one.n, one["bytes"], round(one.bytes_per_second, 6)) == (4, 400, round(400 / 60, 6))


def test_backlog_with_age_and_missing_group(spark):
    log = spark.createDataFrame([(i, at(10 * i)) for i in range(3)], "entry_id long, entered_at timestamp_ntz")
    acks = spark.createDataFrame([("a", 0, at(1)), ("a", 1, None)], "`group` string, entry_id long, acked_at timestamp_ntz")
    groups = spark.createDataFrame([("a",), ("none",)], "`group` string")
    got = {r.group: (r.backlog, r.group_present, r.oldest_age_seconds) for r in mt.consumer_backlog(log, acks, groups, 10, F.lit("2026-08-04 10:01:00").cast("timestamp_ntz")).collect()}
    assert got == {"a": (2, True, 50), "none": (3, False, 60)}
