"""A store for stream sinks on plain Parquet folders: what a batch commits counts once, whichever query or run delivers it.

A commit writes new folders (rows, and where the store has keys, the keys and their Bloom filters) and then one line to the
manifest, which alone makes them part of the store. The manifest knows the last batch of every query (checkpoint) that wrote, so
a batch that runs again is skipped, and a new checkpoint goes on where the old one left the target. Keys lie in hashed buckets:
a batch reads the filters of its own buckets and only those keys whose filter cannot rule them out. Commits are merged by
levels, `fan` of one level into one of the next, so a row is rewritten once a level; folders that are no longer part of the
store go one merge later, when their readers have had time to end. One query writes at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a Bloom filter for each key, and the bits that a key sets.
BITS, PROBES = 12, 6
_FILTER = "_bucket long, size long, bits binary"


def _places(h1: np.ndarray, h2: np.ndarray, size: int) -> np.ndarray:
    """The bits that each key sets in a filter of `size` bits, a row a probe."""
    step = h2.view("uint64") | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(h1.view("uint64") + np.uint64(i) * step) % np.uint64(size) for i in range(PROBES)]).astype("int64")


def _filter_of(keys: pd.DataFrame) -> pd.DataFrame:
    size = max(64, BITS * len(keys))
    bits = np.zeros(-(-size // 8) * 8, "uint8")
    bits[_places(keys["_h1"].to_numpy(), keys["_h2"].to_numpy(), size)] = 1
    return pd.DataFrame({"_bucket": keys["_bucket"].iloc[:1], "size": size, "bits": [np.packbits(bits).tobytes()]})


def _perhaps(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """Adds _known: whether some filter of the bucket holds all bits of a row's key."""
    known = np.zeros(len(rows), bool)
    for size, raw in zip(filters["size"], filters["bits"], strict=True):
        bits = np.unpackbits(np.frombuffer(raw, "uint8")).astype(bool)
        known |= bits[_places(rows["_h1"].to_numpy(), rows["_h2"].to_numpy(), size)].all(axis=0)
    return rows.assign(_known=known)[["_h1", "_h2", "_bucket", "_known"]]


class Store:
    """Rows of committed batches under a target folder; `keys` name what may be stored once only.

    `merge` makes one table of the rows of several commits; it must be associative. `buckets` is fixed by the first commit.
    """

    def __init__(self, spark: SparkSession, target: str, keys: list[str] | None = None, merge: Callable[[DataFrame], DataFrame] | None = None, buckets: int = 256, fan: int = 8):
        self.spark, self.target, self.keys, self.merge, self.fan = spark, target.rstrip("/"), keys, merge or (lambda rows: rows), fan
        self.buckets = next((e["buckets"] for e in self._entries()), buckets)

    def _entries(self) -> list[dict]:
        """Every line of the manifest, oldest first."""
        try:
            lines = self.spark.read.option("recursiveFileLookup", True).text(f"{self.target}/manifest").collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted((json.loads(r["value"]) for r in lines), key=lambda e: e["number"])

    @staticmethod
    def _live(entries: list[dict]) -> list[dict]:
        gone = {c for e in entries for c in e["replaces"]}
        return [e for e in entries if e["commit"] not in gone]

    def last_batches(self) -> dict[str, int]:
        """The last committed batch of each query."""
        out: dict[str, int] = {}
        for e in self._entries():
            for query, batch in e["batches"].items():
                out[query] = max(batch, out.get(query, -1))
        return out

    def read(self) -> DataFrame | None:
        """The rows of all commits, merged; None where nothing has been committed."""
        live = self._live(self._entries())
        return self.merge(self._rows(live)) if live else None

    def _rows(self, commits: list[dict]) -> DataFrame:
        return self.spark.read.schema(commits[0]["schema"]).parquet(*[f"{self.target}/rows/{e['commit']}" for e in commits])

    def done(self, batch: int, query: str) -> bool:
        return batch <= self.last_batches().get(query, -1)

    def commit(self, rows: DataFrame, batch: int, query: str, keys: DataFrame | None = None) -> bool:
        """Adds a batch's rows, and what of its keys is new (the rows' own, or those of `keys`); False, and nothing else, if this
        batch of this query has been committed before."""
        if self.done(batch, query):
            return False
        self._put(rows, {query: batch}, [], 0, self._named(rows if keys is None else keys) if self.keys else None)
        self._merge_levels()
        return True

    def _put(self, rows: DataFrame, batches: dict[str, int], replaced: list[dict], level: int, named: DataFrame | None) -> None:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.target}/rows/{name}")
        key_schema = None
        if named is not None:
            own = named.select(*self.keys, "_h1", "_h2", "_bucket")
            key_schema = _ddl(own)
            own.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.target}/keys/{name}")
            stored = self.spark.read.schema(key_schema).parquet(f"{self.target}/keys/{name}")
            stored.select("_h1", "_h2", "_bucket").groupBy("_bucket").applyInPandas(_filter_of, _FILTER).write.parquet(f"{self.target}/filters/{name}")
        number = max((e["number"] for e in self._entries()), default=0) + 1
        entry = {"number": number, "commit": name, "level": level, "batches": batches, "replaces": [e["commit"] for e in replaced], "buckets": self.buckets, "schema": _ddl(rows), "keys": key_schema}
        self.spark.createDataFrame([(json.dumps(entry),)], "value string").coalesce(1).write.text(f"{self.target}/manifest/{number:09d}-{name}")

    # --- keys

    def _named(self, rows: DataFrame) -> DataFrame:
        """Keys with two hashes and the bucket of the first."""
        h1 = F.xxhash64(*self.keys)
        return rows.withColumn("_h1", h1).withColumn("_h2", F.xxhash64(F.lit("second"), *self.keys)).withColumn("_bucket", F.pmod("_h1", F.lit(self.buckets)))

    def _kept(self, what: str, commits: list[dict], schema: str, buckets: list[int]) -> DataFrame:
        """Filters or keys of these buckets; folders of other buckets are not read."""
        parts = [self.spark.read.schema(schema).parquet(f"{self.target}/{what}/{e['commit']}").filter(F.col("_bucket").isin(buckets)) for e in commits]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def fresh(self, batch: DataFrame, order: list[str] | None = None) -> DataFrame:
        """The batch's rows whose keys the store does not have, one for each key: the first in `order`."""
        if order:
            first = F.min_by(F.struct(*batch.columns), F.struct(*order))
            rows = batch.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)]).agg(first.alias("_first")).select("_first.*")
        else:
            rows = batch.dropDuplicates(self.keys)
        live = self._live(self._entries())
        if not live:
            return rows
        named = self._named(rows)
        touched = [r[0] for r in named.select("_bucket").distinct().collect()]  # at most as many as there are buckets
        filters = self._kept("filters", live, _FILTER, touched)
        hashes = named.select("_h1", "_h2", "_bucket")
        tested = hashes.groupBy("_bucket").cogroup(filters.groupBy("_bucket")).applyInPandas(_perhaps, "_h1 long, _h2 long, _bucket long, _known boolean")
        suspects = tested.filter("_known").select("_h1", "_h2", "_bucket").distinct()
        asked = [r[0] for r in suspects.select("_bucket").distinct().collect()]
        if not asked:
            return rows
        known = self._kept("keys", live, live[0]["keys"], asked).join(suspects, ["_h1", "_h2", "_bucket"], "left_semi")
        found = known.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)])
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)]
        return rows.join(found, same, "left_anti")

    # --- merging

    def _merge_levels(self) -> None:
        level = 0
        while True:
            entries = self._entries()
            same = [e for e in self._live(entries) if e["level"] == level]
            if len(same) < self.fan:
                return
            self._remove_replaced(entries)
            batches: dict[str, int] = {}
            for e in same:
                for query, batch in e["batches"].items():
                    batches[query] = max(batch, batches.get(query, -1))
            keys = self._kept("keys", same, same[0]["keys"], list(range(self.buckets))) if self.keys else None
            self._put(self.merge(self._rows(same)), batches, same, level + 1, keys)
            level += 1

    def _remove_replaced(self, entries: list[dict]) -> None:
        """Folders of commits that an earlier merge has replaced, and their lines, whose batches that merge has taken over."""
        live = {e["commit"] for e in self._live(entries)}
        for e in entries:
            if e["commit"] not in live:
                for at in (f"manifest/{e['number']:09d}-{e['commit']}", f"rows/{e['commit']}", f"keys/{e['commit']}", f"filters/{e['commit']}"):
                    _remove(f"{self.target}/{at}")

    def vacuum(self) -> None:
        """Removes what is no part of the store: replaced commits, and folders whose run ended before its line was written."""
        self._remove_replaced(self._entries())
        kept = {e["commit"] for e in self._entries()}
        for what in ("rows", "keys", "filters"):
            for at in _folders(f"{self.target}/{what}"):
                if at.rsplit("/", 1)[-1] not in kept:
                    _remove(at)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _folders(path: str) -> Iterator[str]:
    files, at = _at(path)
    if files.get_file_info(at).type == fs.FileType.Directory:
        scheme = path[: path.index(at)] if at in path else ""
        yield from (scheme + f.path for f in files.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.Directory)


def _remove(path: str) -> None:
    files, at = _at(path)
    if files.get_file_info(at).type == fs.FileType.Directory:
        files.delete_dir(at)
