"""Contracts of nested JSON records, compiled to columns: every broken rule with the path of its field.

A record is parsed once, into a variant; each rule is one expression on it, so checking stays inside the engine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalar import parse_timestamp
from tickloom.operators.quality import evidence_rules, reasons


@dataclass(frozen=True)
class Is:
    """What a field must be. kind: string, decimal, integer, time (with an offset), names (an array of strings) or object."""

    kind: str = "string"
    required: bool = False
    pattern: str | None = None
    one_of: tuple[str, ...] = ()
    least: float | None = None
    above: float | None = None
    most: float | None = None
    length: tuple[int, int] | None = None
    upper: bool = False
    fields: dict[str, Is] = field(default_factory=dict)


_DECIMAL = "decimal(38,18)"
_ZERO_UP, _POSITIVE = Is("decimal", least=0), Is("decimal", above=0)

# Fixed values of the contract: names, enums, patterns and bounds.
CURRENCY = Is(pattern=r"^[A-Z0-9]+$", length=(2, 12), upper=True)
UNITS = ("base_asset", "quote_notional", "contracts")
ORIGINS = ("native", "provider_aggregated", "gateway_derived")
VOLUME = Is("object", fields={
    "kind": Is(required=True, one_of=("interval", "cumulative")), "unit": Is(required=True, one_of=UNITS), "aggregation_window_ms": Is("integer", above=0), "currency": CURRENCY,
    "origin": Is(required=True, one_of=ORIGINS),
})
DEPTH = Is("object", fields={"unit": Is(required=True, one_of=UNITS), "levels": Is("integer", least=1, most=20), "currency": CURRENCY, "origin": Is(required=True, one_of=ORIGINS)})
QUOTE = Is("object", required=True, fields={
    "schema_version": Is(pattern=r"^1\.[0-9]+$"), "event_id": Is(pattern=r"^[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$"), "symbol": Is(required=True, pattern=r"^[A-Z0-9._:-]+$", length=(1, 32), upper=True),
    "price": Is("decimal", required=True, above=0), "bid": _POSITIVE, "ask": _POSITIVE, "provider_timestamp": Is("time", required=True), "received_at": Is("time"), "sequence": Is("integer", least=0),
    "provider": Is(required=True, length=(1, 64)), "capabilities": Is("names", one_of=("level1_quote", "volume", "aggressor_flow", "trade_count", "top_of_book_depth")),
    "volume": _ZERO_UP, "buy_volume": _ZERO_UP, "sell_volume": _ZERO_UP, "trade_count": Is("integer", least=0), "bid_depth": _ZERO_UP, "ask_depth": _ZERO_UP, "volume_semantics": VOLUME, "depth_semantics": DEPTH,
})


def _broken(path: str, rule: str, bad: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{path}: {rule}"))


def _text(variant: Column, path: str, spec: Is) -> Column:
    text = F.try_variant_get(variant, path, "string")
    return F.upper(F.trim(text)) if spec.upper else text


def walk(spec: Is, variant: Column, raw: Column, path: str = "$") -> Iterator[Column]:
    """A column for each rule, null where it is kept: "path: rule"; rules are type, missing, unknown, enum, pattern, range, length."""
    name = path.removeprefix("$.")
    there = F.try_variant_get(variant, path, "variant")
    present = there.isNotNull() & ~F.coalesce(F.is_variant_null(there), F.lit(False))
    if spec.required:
        yield _broken(name, "missing", ~present)
    if spec.kind == "object":
        own = raw if path == "$" else F.get_json_object(raw, path)
        names = F.json_object_keys(own)
        yield _broken(name, "type", present & names.isNull())
        unknown = F.array_sort(F.array_except(names, F.array(*map(F.lit, spec.fields))))
        prefix = "" if path == "$" else f"{name}."
        yield F.when(F.size(unknown) > 0, F.array_join(F.transform(unknown, lambda n: F.concat(F.lit(prefix), n, F.lit(": unknown"))), ","))
        for child, rules in spec.fields.items():
            inner = [*walk(rules, variant, raw, f"{path}.{child}")]
            yield from inner if path == "$" else [F.when(names.isNotNull(), rule) for rule in inner]
        return
    if spec.kind == "names":
        values = F.try_variant_get(variant, path, "array<string>")
        yield _broken(name, "type", present & values.isNull())
        yield _broken(name, "enum", F.exists(values, lambda v: v.isNull() | ~v.isin(*spec.one_of)))
        return
    text = _text(variant, path, spec)
    if spec.kind in ("decimal", "integer"):
        number = text.try_cast(_DECIMAL)
        whole = number == F.floor(number) if spec.kind == "integer" else F.lit(True)
        yield _broken(name, "type", present & (number.isNull() | ~whole))
        bounds = [bad for limit, bad in ((spec.least, number < F.lit(spec.least)), (spec.above, number <= F.lit(spec.above)), (spec.most, number > F.lit(spec.most))) if limit is not None]
        if bounds:
            bad = bounds[0]
            for more in bounds[1:]:
                bad = bad | more
            yield _broken(name, "range", bad)
        return
    if spec.kind == "time":
        yield _broken(name, "type", present & parse_timestamp(text).isNull())
        return
    yield _broken(name, "type", present & text.isNull())
    if spec.one_of:
        yield _broken(name, "enum", ~text.isin(*spec.one_of))
    if spec.length:
        yield _broken(name, "length", ~F.length(text).between(*spec.length))
    if spec.pattern:
        yield _broken(name, "pattern", ~text.rlike(spec.pattern))


def check(rows: DataFrame, spec: Is, value: str = "value") -> DataFrame:
    """Adds broken: the rules that a JSON record breaks, comma-joined in the contract's order; empty where it keeps all."""
    rows = rows.withColumn("_record", F.try_parse_json(F.col(value)))
    rules = [F.when(F.col("_record").isNull(), F.lit("$: type")), *[F.when(F.col("_record").isNotNull(), r) for r in walk(spec, F.col("_record"), F.col(value))]]
    return rows.withColumn("broken", F.array_join(F.array_compact(F.array(*rules)), ",")).drop("_record")


def check_quotes(rows: DataFrame, value: str = "value") -> DataFrame:
    """Adds broken and errors: the fields' rules first; where a record keeps them all, the rules between its fields (V8 to V23).

    A record without version is 1.0, one without capabilities has level1_quote alone, and depth without levels has one.
    """
    rows = check(rows, QUOTE, value).withColumn("_record", F.try_parse_json(F.col(value)))
    get = lambda path, kind: F.try_variant_get("_record", f"$.{path}", kind)
    number = lambda path: get(path, "string").try_cast(_DECIMAL)
    upper = lambda path: F.upper(F.trim(get(path, "string")))
    depth = F.try_variant_get("_record", "$.depth_semantics", "variant").isNotNull()
    flat = {
        "schema_version": F.coalesce(get("schema_version", "string"), F.lit("1.0")), "capabilities": F.coalesce(get("capabilities", "array<string>"), F.array(F.lit("level1_quote"))),
        **{c: number(c) for c in ("bid", "ask", "volume", "buy_volume", "sell_volume", "bid_depth", "ask_depth")}, "trade_count": number("trade_count").cast("long"),
        "volume_kind": get("volume_semantics.kind", "string"), "volume_unit": get("volume_semantics.unit", "string"), "volume_currency": upper("volume_semantics.currency"),
        "window_ms": number("volume_semantics.aggregation_window_ms").cast("long"), "depth_unit": get("depth_semantics.unit", "string"), "depth_currency": upper("depth_semantics.currency"),
        "depth_levels": F.when(depth, F.coalesce(number("depth_semantics.levels"), F.lit(1)).cast("long")),
    }
    rows = rows.withColumn("_flat", F.struct(*[v.alias(c) for c, v in flat.items()]))
    rules = {"V8": F.col("_flat.bid") > F.col("_flat.ask")} | evidence_rules(lambda c: F.col(f"_flat.{c}"))
    return rows.withColumn("errors", F.when(F.col("broken") == "", reasons(rules)).otherwise("")).drop("_flat", "_record")
