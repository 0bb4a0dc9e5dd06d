"""The quote contract: one rejection a rule, at every level of the record."""

import json

import pytest

from tickloom.operators.contract import check_quotes

BASE = {"event_id": "0b9c7f6e-6a63-4a55-9d0a-1f6c1c9f0f5e", "symbol": " aapl ", "price": "101.5", "bid": "101", "ask": 102, "provider_timestamp": "2024-08-04T10:00:00Z", "sequence": 7, "provider": "p"}
CAPS = ["level1_quote", "volume", "aggressor_flow", "trade_count", "top_of_book_depth"]
VOLUME = {"kind": "interval", "unit": "base_asset", "aggregation_window_ms": 1000, "origin": "native"}
RICH = BASE | {"schema_version": "1.1", "capabilities": CAPS, "volume": "10", "buy_volume": "6", "sell_volume": "4", "trade_count": 3, "bid_depth": "1", "ask_depth": "0", "volume_semantics": VOLUME, "depth_semantics": {"unit": "base_asset", "levels": 1, "origin": "native"}}


def volume(**changes):
    return RICH | {"volume_semantics": VOLUME | changes}


def depth(**changes):
    return RICH | {"depth_semantics": RICH["depth_semantics"] | changes}


def without(*names):
    return {k: v for k, v in RICH.items() if k not in names}


FINE = [BASE, RICH, RICH | {"volume": 0, "buy_volume": 0, "sell_volume": 0}, without("buy_volume", "sell_volume"), BASE | {"bid": None}, volume(kind="cumulative", aggregation_window_ms=None), volume(unit="quote_notional", currency=" usd ")]
BROKEN = [
    (BASE | {"extra": 1, "another": 2}, "another: unknown,extra: unknown"), (volume(extra=1), "volume_semantics.extra: unknown"), (depth(extra=1), "depth_semantics.extra: unknown"),
    (BASE | {"price": "0"}, "price: range"), (BASE | {"price": "x"}, "price: type"), (BASE | {"price": None}, "price: missing"), (BASE | {"bid": -1}, "bid: range"), (BASE | {"sequence": -1}, "sequence: range"), (BASE | {"sequence": 1.5}, "sequence: type"),
    (BASE | {"symbol": "A B"}, "symbol: pattern"), (BASE | {"symbol": "A" * 33}, "symbol: length"), (BASE | {"provider": ""}, "provider: length"), (BASE | {"event_id": "7"}, "event_id: pattern"),
    (BASE | {"provider_timestamp": "2024-08-04T10:00:00"}, "provider_timestamp: type"), (BASE | {"schema_version": "2.0"}, "schema_version: pattern"), (BASE | {"capabilities": ["level1_quote", "weird"]}, "capabilities: enum"), (BASE | {"capabilities": "level1_quote"}, "capabilities: type"),
    (volume(kind="weekly"), "volume_semantics.kind: enum"), (volume(unit="pounds"), "volume_semantics.unit: enum"), (volume(origin=None), "volume_semantics.origin: missing"), (volume(aggregation_window_ms=0), "volume_semantics.aggregation_window_ms: range"),
    (volume(unit="quote_notional", currency="us-d"), "volume_semantics.currency: pattern"), (depth(levels=21), "depth_semantics.levels: range"), (RICH | {"depth_semantics": 5}, "depth_semantics: type"), (RICH | {"volume": "-1"}, "volume: range"), (RICH | {"bid_depth": -1}, "bid_depth: range"),
]
BETWEEN = [
    (BASE | {"bid": "103"}, "V8"), (RICH | {"capabilities": CAPS[1:]}, "V9"), (volume(aggregation_window_ms=None), "V10"), (volume(kind="cumulative"), "V11"), (volume(unit="quote_notional"), "V12"), (volume(currency="USD"), "V13"),
    (depth(unit="quote_notional"), "V15"), (depth(currency="USD"), "V16"), (without("schema_version"), "V18"), (without("volume_semantics"), "V19"), (RICH | {"capabilities": [c for c in CAPS if c != "volume"]}, "V20"),
    (without("sell_volume"), "V21"), (RICH | {"buy_volume": "80"}, "V21"), (without("ask_depth"), "V22"), (depth(levels=2), "V22"), (RICH | {"capabilities": CAPS[:-1]}, "V22"),
]


@pytest.fixture(scope="module")
def judged(spark):
    records = FINE + [r for r, _ in BROKEN] + [r for r, _ in BETWEEN]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(1000, "not json"), (1001, None), (1002, "[1]")]
    return {r.i: (r.broken, r.errors) for r in check_quotes(spark.createDataFrame(rows, "i int, value string")).collect()}


def test_contract(judged):
    assert [judged[i] for i in range(len(FINE))] == [("", "")] * len(FINE)
    for i, (record, rule) in enumerate(BROKEN, len(FINE)):
        assert judged[i] == (rule, ""), record
    for i, (record, rule) in enumerate(BETWEEN, len(FINE) + len(BROKEN)):
        assert judged[i] == ("", rule), record
    assert judged[1000][0].startswith("$: type") and judged[1001][0].startswith("$: type") and "$: type" in judged[1002][0]
