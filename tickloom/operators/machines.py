"""Keyed state machines in event order, with deadlines: the same machine runs over a table here and over a stream in `streaming`.

A machine sees a key's rows in order, each with its time in microseconds, and may hold a deadline: when no row has come by then,
it acts by itself. It keeps one tuple of typed values, one row that waits, and named maps; over a table these live in memory for
one key at a time, over a stream in value and map state of the state store, where deadlines are timers.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.fold import ARROW, schema_with

#: The column that gives a row's time in microseconds to machines.
AT = "_us"
Row = dict


class Memory:
    """A machine's state over a table: one key's."""

    def __init__(self):
        self.values: tuple | None = None
        self.held: Row | None = None
        self._maps: dict[str, dict] = {}

    def map(self, name: str) -> dict:
        """A map of this name: get, set and delete by key, items() in any order."""
        return self._maps.setdefault(name, {})


class Machine:
    """What a machine defines; `values` and `maps` (name to the types of key and value) are types of its state in DDL."""

    #: Columns that it adds, and those of them that are times, as microseconds.
    added: dict[str, str] = {}
    times: tuple[str, ...] = ()
    values = "value long"
    maps: dict[str, tuple[str, str]] = {}
    holds = False

    def row(self, state: Memory, now: int, row: Row) -> Iterable[Row]:
        """Takes a row and gives finished ones, with the added columns."""
        raise NotImplementedError

    def due(self, state: Memory) -> int | None:
        """When it acts if no row comes before; a row at that very time comes after."""
        return None

    def fire(self, state: Memory, now: int) -> Iterable[Row]:
        """What it does then; must move or drop the deadline."""
        raise NotImplementedError


def catch_up(machine: Machine, state: Memory, until: float) -> Iterator[Row]:
    """Deadlines up to a time, in order."""
    while (at := machine.due(state)) is not None and at <= until:
        yield from machine.fire(state, at)


def timed(rows: DataFrame, at: str) -> DataFrame:
    return rows.withColumn(AT, F.unix_micros(F.col(at).cast("timestamp")))


def finished(rows: DataFrame, machine: Machine, at: str, kind: str) -> DataFrame:
    """Added times as timestamps of the kind of the rows' own."""
    moment: dict[str, Column] = {c: F.timestamp_micros(F.col(c)).cast(kind) for c in machine.times}
    return rows.withColumns(moment).drop(AT) if moment else rows.drop(AT)


def run_machine(rows: DataFrame, keys: list[str], at: str, order: list[str], machine: Machine, arrival: bool = False) -> DataFrame:
    """Finished rows of all keys; deadlines that no row comes to meet are met at a key's end. Memory is a batch and a state.

    Rows are taken by time and then `order`; with `arrival` by `order` alone, and without deadlines.
    """
    given = timed(rows, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, schema = None, Memory(), None
        for batch in batches:
            schema, out = pa.schema([*batch.schema, *[pa.field(n, ARROW[t]) for n, t in machine.added.items()]]), []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != last:
                    out += catch_up(machine, state, math.inf)
                    last, state = key, Memory()
                if not arrival:
                    out += catch_up(machine, state, row[AT])
                out += machine.row(state, row[AT], row)
            yield pa.RecordBatch.from_pylist(out, schema)
        if schema is not None:
            yield pa.RecordBatch.from_pylist(list(catch_up(machine, state, math.inf)), schema)

    out = given.repartition(*keys).sortWithinPartitions(*keys, *([] if arrival else [AT]), *order).mapInArrow(run, schema_with(given, machine.added))
    return finished(out, machine, at, dict(rows.dtypes)[at])


class Throttle(Machine):
    """A row of a key goes at once if its interval (seconds) has passed since the last one that went; else it waits until then,
    and a newer one takes its place. Adds sent_at (null if replaced) and replaced; the last waiting row goes by its deadline."""

    added = {"sent_at": "long", "replaced": "boolean"}
    times = ("sent_at",)
    values = "last long"
    holds = True

    def __init__(self, interval: str = "interval_seconds"):
        self.interval = interval

    def _gap(self, row: Row) -> int:
        return round(float(row[self.interval]) * 1_000_000)

    def row(self, state, now, row):
        if state.held is not None:
            yield state.held | {"sent_at": None, "replaced": True}
            state.held = None
        if state.values is None or now - state.values[0] >= self._gap(row):
            state.values = (now,)
            yield row | {"sent_at": now, "replaced": False}
        else:
            state.held = row

    def due(self, state):
        return None if state.held is None else state.values[0] + self._gap(state.held)

    def fire(self, state, now):
        row, state.held, state.values = state.held, None, (now,)
        yield row | {"sent_at": now, "replaced": False}


class WindowLimit(Machine):
    """A key's first row opens a window, in which as many rows as `limit` (a number or a column) are allowed."""

    added = {"allowed": "boolean"}
    values = "opened long, n long"

    def __init__(self, limit: int | str, seconds: float):
        self.limit, self.width = limit, round(seconds * 1_000_000)

    def row(self, state, now, row):
        opened, n = state.values or (now, 0)
        state.values = (opened, n + 1)
        yield row | {"allowed": n < (row[self.limit] if isinstance(self.limit, str) else self.limit)}

    def due(self, state):
        return None if state.values is None else state.values[0] + self.width

    def fire(self, state, now):
        state.values = None
        return ()


class TokenBucket(Machine):
    """Adds allowed and remaining. A bucket of `burst` tokens, max(5, ceil(rpm / 6)) where that is null, fills by rpm / 60 a
    second; a row takes `cost` (1 where null) if there are so many. Without a rate nothing is allowed. A bucket that has been
    left for twice the time it takes to fill, a minute at least, is forgotten: it is full."""

    added = {"allowed": "boolean", "remaining": "double"}
    values = "tokens double, at long, capacity double, refill double"

    def __init__(self, rpm: str = "rpm", cost: str | None = None, burst: str | None = None):
        self.rpm, self.cost, self.burst = rpm, cost, burst

    def row(self, state, now, row):
        rpm = row[self.rpm] or 0
        if rpm <= 0:
            yield row | {"allowed": False, "remaining": 0.0}
            return
        cost = 1 if self.cost is None or row[self.cost] is None else row[self.cost]
        capacity, refill = float((self.burst and row[self.burst]) or max(5, math.ceil(rpm / 6))), rpm / 60
        tokens, at = state.values[:2] if state.values else (capacity, now)
        tokens = min(capacity, tokens + max(0, now - at) / 1_000_000 * refill)
        allowed = tokens >= cost
        tokens -= cost if allowed else 0
        state.values = (tokens, now, capacity, refill)
        yield row | {"allowed": allowed, "remaining": tokens}

    def due(self, state):
        if state.values is None:
            return None
        _, at, capacity, refill = state.values
        return at + max(60, math.ceil(capacity / refill * 2)) * 1_000_000

    def fire(self, state, now):
        state.values = None
        return ()


class Connections(Machine):
    """Concurrent connections of a client, with leases. Rows are events: acquire, heartbeat or release of a connection.

    An acquired connection lives for `seconds` and is renewed by a heartbeat or by acquiring it again; beyond `most` (a number or
    a column) living ones it is refused, and a refused one holds no place. Heartbeats and releases of connections that do not
    live change nothing. Adds allowed (whether the event took effect) and connections, those that live after it.
    """

    added = {"allowed": "boolean", "connections": "long"}
    maps = {"leases": ("connection string", "until long")}

    def __init__(self, most: int | str, seconds: float, event: str = "event", connection: str = "connection_id"):
        self.most, self.lease, self.event, self.connection = most, round(seconds * 1_000_000), event, connection

    def row(self, state, now, row):
        leases, name, event = state.map("leases"), str(row[self.connection]), row[self.event]
        known = name in leases
        took = known
        if event == "acquire":
            most = row[self.most] if isinstance(self.most, str) else self.most
            took = len(leases) + (not known) <= most
        if event == "release" or (event == "acquire" and not took):
            if known:
                del leases[name]
        elif took:
            leases[name] = now + self.lease
        yield row | {"allowed": took, "connections": len(leases)}

    def due(self, state):
        return min((until for _, until in state.map("leases").items()), default=None)

    def fire(self, state, now):
        leases = state.map("leases")
        for name in [k for k, until in leases.items() if until <= now]:
            del leases[name]
        return ()


class FirstWithin(Machine):
    """Accepts a key's first row and every row that comes `seconds` or more after the last accepted one."""

    added = {"accepted": "boolean"}
    values = "at long"

    def __init__(self, seconds: float):
        self.ttl = round(seconds * 1_000_000)

    def row(self, state, now, row):
        fresh = state.values is None
        if fresh:
            state.values = (now,)
        yield row | {"accepted": fresh}

    def due(self, state):
        return None if state.values is None else state.values[0] + self.ttl

    def fire(self, state, now):
        state.values = None
        return ()


class FailureCount(Machine):
    """Counts a key's failures; adds retries, and exhausted at the `limit`-th. A count is forgotten `seconds` after its last
    failure."""

    added = {"retries": "long", "exhausted": "boolean"}
    values = "n long, at long"

    def __init__(self, limit: int = 3, seconds: float = 3600):
        self.limit, self.ttl = limit, round(seconds * 1_000_000)

    def row(self, state, now, row):
        n = state.values[0] + 1 if state.values else 1
        state.values = (n, now)
        yield row | {"retries": n, "exhausted": n == self.limit}

    def due(self, state):
        return None if state.values is None else state.values[1] + self.ttl

    def fire(self, state, now):
        state.values = None
        return ()


class TemporalGuard(Machine):
    """Adds outcome, reason and missing: accepted, duplicate or quarantined, by a key's generation, time and sequence.

    Checked in order: generation, repeated event, time (whatever the generation), sequence (unless the generation has advanced
    and `resets` allows a new start). Only accepted rows move the state; a null sequence leaves the last one. The `retention`
    newest ids of a key are remembered, each in an entry of its own. Rows come by arrival.
    """

    added = {"outcome": "string", "reason": "string", "missing": "long"}
    values = "generation long, at long, sequence long, n long"
    maps = {"seen": ("id string", "n long"), "order": ("n long", "id string")}

    def __init__(self, retention: int = 10_000, resets: bool = True):
        self.retention, self.resets = retention, resets

    def _remember(self, state, name: str, n: int) -> None:
        seen, order = state.map("seen"), state.map("order")
        seen[name], order[n] = n, name
        if n >= self.retention:
            del seen[order[n - self.retention]]
            del order[n - self.retention]

    def row(self, state, now, row):
        generation, sequence, name = row["generation"], row["sequence"], str(row["event_id"])
        missing = 0
        if state.values is None:
            outcome, reason, after = "accepted", "initial", (generation, now, sequence, 1)
        else:
            g, at, s, n = state.values
            both, advanced = sequence is not None and s is not None, generation > g
            after = None
            if generation < g:
                outcome, reason = "quarantined", "stale_generation"
            elif name in state.map("seen"):
                outcome, reason = "duplicate", "duplicate_event"
            elif now < at:
                outcome, reason = "quarantined", "timestamp_rollback"
            elif both and sequence <= s and not (advanced and self.resets):
                outcome, reason = "quarantined", "sequence_regression"
            else:
                missing = sequence - s - 1 if both and not advanced else 0
                reason = "generation_advanced" if advanced else "sequence_gap" if missing > 0 else "same_timestamp" if now == at else "advanced"
                outcome, missing, after = "accepted", max(0, missing), (generation, now, sequence if sequence is not None else s, n + 1)
        if after:
            self._remember(state, name, after[3] - 1)
            state.values = after
        yield row | {"outcome": outcome, "reason": reason, "missing": missing}
