"""Running values over the ordered rows of a key, cut into slices so that one busy key is many tasks.

Any associative summary does: each slice is summed up on its own (partial sums, no rows move), the summaries of the slices before
are carried over (a row a slice), and a window inside the slice goes on from there. What is carried enters a slice as its first
row, so rows move once, by key and slice, and null keys are keys like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of arrival, and seconds, in a slice.
NUMBERS, SECONDS = 1_000_000, 86_400


@dataclass(frozen=True)
class Running:
    """A running value: kind is max, min, sum, count or last (the last that is not null); `inclusive` counts the row itself."""

    kind: str
    value: Column | None = None
    inclusive: bool = False


def running_max(value: Column | str, inclusive: bool = False) -> Running:
    return Running("max", F.col(value) if isinstance(value, str) else value, inclusive)


def running_sum(value: Column | str, inclusive: bool = False) -> Running:
    return Running("sum", F.col(value) if isinstance(value, str) else value, inclusive)


def running_count(inclusive: bool = False) -> Running:
    """0 at the first row, or 1 if inclusive."""
    return Running("count", None, inclusive)


def last_before(value: Column | str, inclusive: bool = False) -> Running:
    return Running("last", F.col(value) if isinstance(value, str) else value, inclusive)


_SUM = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.sum}


def slice_of(rows: DataFrame, at: str, width: int | None = None) -> Column:
    """Slices of a column of times (seconds) or numbers, in its order; null is a slice of its own, before all others."""
    kind = dict(rows.dtypes)[at]
    if kind.startswith("timestamp") or kind == "date":
        return F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / (width or SECONDS))
    return F.floor(F.col(at) / (width or NUMBERS))


def scan(rows: DataFrame, keys: list[str], order: list[str], added: dict[str, Running], width: int | None = None) -> DataFrame:
    """Adds running values by `order` (ascending, nulls first); its first column, of times or numbers, is cut into slices."""
    slices = [f"_key{i}" for i in range(len(keys))] + ["_slice"]
    names = [f"_value{i}" for i in range(len(added))]
    kinds = list(added.values())
    places = [f"_order{i}" for i in range(len(order))]
    own = rows.select(
        *[F.col(k).alias(s) for k, s in zip(keys, slices, strict=False)], slice_of(rows, order[0], width).alias("_slice"), F.lit(1).alias("_side"), *[F.col(o).alias(p) for o, p in zip(order, places, strict=True)],
        *[(F.lit(1).cast("long") if k.kind == "count" else k.value).alias(n) for k, n in zip(kinds, names, strict=True)], F.struct(*rows.columns).alias("_row"),
    )
    whole = lambda k, n: F.max_by(n, F.when(F.col(n).isNotNull(), F.struct(*places))) if k.kind == "last" else _SUM[k.kind](n)
    ends = own.groupBy(*slices).agg(*[whole(k, n).alias(n) for k, n in zip(kinds, names, strict=True)])
    earlier = Window.partitionBy(*slices[:-1]).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = lambda k, n, w: F.last(n, ignorenulls=True).over(w) if k.kind == "last" else _SUM[k.kind](n).over(w)
    kind_of = {f.name: f.dataType for f in own.schema}
    starts = ends.select(*slices, F.lit(0).alias("_side"), *[F.lit(None).cast(kind_of[p]).alias(p) for p in places], *[carry(k, n, earlier).alias(n) for k, n in zip(kinds, names, strict=True)], F.lit(None).cast(kind_of["_row"]).alias("_row"))
    inside = Window.partitionBy(*slices).orderBy("_side", *places)
    out = own.unionByName(starts)
    found = []
    for (name, k), n in zip(added.items(), names, strict=True):
        value = carry(k, n, inside.rowsBetween(Window.unboundedPreceding, 0 if k.inclusive else -1))
        found.append((F.coalesce(value, F.lit(0)).cast("long") if k.kind == "count" else value).alias(name))
    return out.select("_side", "_row", *found).filter("_side = 1").select("_row.*", *added)


def islands(rows: DataFrame, keys: list[str], order: list[str], condition: Column, name: str, width: int | None = None) -> DataFrame:
    """Adds the number of the run of equal conditions that a row is in (null counts as false), as `name`, and the condition as
    `name`_on: runs that meet it have odd numbers."""
    rows = rows.withColumn(f"{name}_on", F.coalesce(condition, F.lit(False)))
    turned = scan(rows, keys, order, {"_before": last_before(F.col(f"{name}_on"))}, width).withColumn("_turn", (F.col(f"{name}_on") != F.coalesce("_before", F.lit(False))).cast("long"))
    return scan(turned, keys, order, {name: running_sum("_turn", inclusive=True)}, width).drop("_before", "_turn")
