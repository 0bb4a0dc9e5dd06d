"""State machines over streams: typed value, list and map state, event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tickloom.operators.fold import schema_with
from tickloom.operators.machines import AT, Machine, catch_up, finished, timed

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Map:
    """Map state with a dictionary's manners; keys and values are single columns."""

    def __init__(self, handle):
        self._handle = handle

    def __contains__(self, key) -> bool:
        return self._handle.containsKey((key,))

    def __getitem__(self, key):
        return self._handle.getValue((key,))[0]

    def __setitem__(self, key, value) -> None:
        self._handle.updateValue((key,), (value,))

    def __delitem__(self, key) -> None:
        self._handle.removeKey((key,))

    def __len__(self) -> int:
        return sum(1 for _ in self._handle.keys())

    def items(self) -> Iterator[tuple]:
        return ((k[0], v[0]) for k, v in list(self._handle.iterator()))


class _Stored:
    """A machine's state in the state store: read at the start of a key's turn, written at its end where it has changed."""

    def __init__(self, processor: MachineProcessor):
        self._of = processor
        self.values = processor.kept.get() if processor.kept.exists() else None
        self.held = dict(zip(processor.names, processor.held.get(), strict=True)) if processor.held.exists() else None
        self._was = self.values, self.held

    def map(self, name: str) -> _Map:
        return self._of.maps[name]

    def write(self) -> None:
        for handle, was, now in ((self._of.kept, self._was[0], self.values), (self._of.held, self._was[1], self.held)):
            if now is None and was is not None:
                handle.clear()
            elif now is not None and now != was:
                handle.update(tuple(now.values()) if isinstance(now, dict) else tuple(now))


class MachineProcessor(StatefulProcessor):
    """Rows wait in list state until the watermark has passed them, so a key sees them in order however they arrive; a machine's
    deadline is a timer, which fires without any further row of its key."""

    def __init__(self, machine: Machine, schema: str, names: list[str], order: list[str], arrival: bool):
        self.machine, self.schema, self.names, self.order, self.arrival = machine, schema, names, order, arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.kept = handle.getValueState("values", self.machine.values)
        self.held = handle.getValueState("held", self.schema)
        self.maps = {name: _Map(handle.getMapState(name, *types)) for name, types in self.machine.maps.items()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        if self.arrival:
            return self._arrived(rows)
        new = [tuple(r[c] for c in self.names) for r in rows]
        self.waiting.appendList(new)
        at = self.names.index(AT)
        for ms in {-(-r[at] // 1000) for r in new}:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        until = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        rows = [dict(zip(self.names, r, strict=True)) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in rows if r[AT] <= until), key=lambda r: tuple(r[c] for c in [AT, *self.order]))
        if ready:
            later = [tuple(r.values()) for r in rows if r[AT] > until]
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        state, out = _Stored(self), []
        for row in ready:
            out += catch_up(self.machine, state, row[AT])
            out += self.machine.row(state, row[AT], row)
        out += catch_up(self.machine, state, until)
        if (due := self.machine.due(state)) is not None:
            self.handle.registerTimer(-(-due // 1000))
        state.write()
        return (Row(**r) for r in out)

    def _arrived(self, rows: Iterator[Row]) -> Iterator[Row]:
        state, out = _Stored(self), []
        for row in sorted((r.asDict() for r in rows), key=lambda r: tuple(r[c] for c in self.order)):
            out += self.machine.row(state, row[AT], row)
        state.write()
        return (Row(**r) for r in out)

    def close(self) -> None:
        pass


def machine_stream(rows: DataFrame, keys: list[str], at: str, order: list[str], machine: Machine, lateness: str = "10 seconds", arrival: bool = False) -> DataFrame:
    """run_machine over a stream: rows are finished when the watermark, `lateness` behind the newest, has passed them and what
    they wait for. Rows later than that are dropped, as by every watermark; all others give what the table gives. `at` is a
    TIMESTAMP. Times of deadlines are exact to the microsecond; timers look every millisecond. With `arrival` a batch's rows are
    taken in `order` as they come, without watermark and deadlines. Needs the RocksDB state store, which it names in the
    session's settings."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    given = timed(rows, at) if arrival else timed(rows, at).withWatermark(at, lateness)
    state = schema_with(given, {})
    out = StructType.fromDDL(schema_with(given, machine.added))
    done = given.groupBy(*keys).transformWithState(MachineProcessor(machine, state, given.columns, order, arrival), out, "Append", "None" if arrival else "EventTime")
    return finished(done, machine, at, dict(rows.dtypes)[at])
