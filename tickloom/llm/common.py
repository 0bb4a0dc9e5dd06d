"""Shared helpers of the training-data operators: scratch tables, word hashing, sizes."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side (rows of one or two numbers) that is sent to every executor; larger sides are shuffled instead.
BROADCAST_ROWS = 500_000
#: Spark's own setting that removes shuffle files when the query that wrote them has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FOLDERS: dict[str, str] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_TABLES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where it is unset: a temporary folder in local mode, which has one machine, else a folder of the warehouse, which is shared.
    """
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    context = spark.sparkContext
    if context.applicationId not in _FOLDERS:
        one_machine = context.master == "local" or context.master.startswith("local[")
        _FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="tickloom-") if one_machine else f"{spark.conf.get('spark.sql.warehouse.dir')}/tickloom-scratch"
    return _FOLDERS[context.applicationId]


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


@contextmanager
def one_a_batch(spark: SparkSession) -> Iterator[None]:
    """Python functions take rows one by one: for rows of megabytes, several of which a worker need not hold."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _file_system(spark: SparkSession, path: str):
    """The path and its file system; PySpark has no public call for either."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, and survives lost executors.

    Shuffle files behind it go at once; the files themselves with discard(), or else when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.parquet(path)
    at, files = _file_system(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the session's file system closes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at, files = _file_system(spark, path)
    files.deleteOnExit(at)
    return path


def stored_by(df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """stored() as a table in so many buckets of a key: joins and groupings by the key then move none of its rows again."""
    spark = df.sparkSession
    table_name = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table_name}"
    with _cleaning(spark):
        df.repartition(parts, key).write.bucketBy(parts, key).option("path", path).saveAsTable(table_name)
    at, files = _file_system(spark, path)
    files.deleteOnExit(at)
    out = spark.table(table_name)
    _PATHS[out], _TABLES[out] = path, table_name
    return out


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more: what was made from them has to be stored itself by now."""
    for df in tables:
        if name := _TABLES.pop(df, None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        at, files = _file_system(df.sparkSession, _PATHS.pop(df))
        files.delete(at, True)


def whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows that come sorted by `key`, in pieces that hold whole groups, with the edges of the groups in each."""
    rest = None
    for batch in batches:
        rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        keys = rest[key].to_numpy()
        end = len(keys) if not len(keys) else int(np.searchsorted(keys, keys[-1]))
        if end:
            yield rest.iloc[:end], _edges(keys[:end])
            rest = rest.iloc[end:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest, _edges(rest[key].to_numpy())


def _edges(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its counted rows stay within the bound, else as it is (a shuffle join follows)."""
    return F.broadcast(df) if rows <= most else df


#: A group of copies with more than this share of all rows is hot; there are fewer than its inverse of them.
HOT_SHARE = 0.001


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows with the one row of their group, which counts them in `copies`; total: all rows, those without a group included.

    Hot groups, of which there are fewer than 1 / HOT_SHARE, go to the rows; the others, each small, meet them by a shuffle.
    """
    hot = F.col("copies") > max(1, int(total * HOT_SHARE))
    few = F.broadcast(groups.filter(hot))
    rest = rows.join(few.select(*keys), keys, "left_anti").join(groups.filter(~hot), keys, how)
    return rows.join(few, keys).unionByName(rest)


#: Stands for a null id inside Python functions, where nulls would turn ids into floating point numbers.
NO_ID = -(1 << 63)


def safe_id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name), F.lit(NO_ID)).cast("long").alias(name)


def real_id(name: str = "doc_id") -> Column:
    return F.nullif(F.col(name), F.lit(NO_ID)).alias(name)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone; every other character stays as it is. Null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- word hashes straight from UTF-8 bytes ------------------------------------------------------------------------

_U = np.uint64
_CHUNK = 1 << 19
_LONG = 1 << 12
_P = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of _P, powers of its inverse modulo 2**64, and a random value for each byte."""
    if "powers" not in _CACHE:
        n = _CHUNK + 1
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([[_U(1)], np.full(n, _U(_P))]), dtype=_U)
            down = np.cumprod(np.concatenate([[_U(1)], np.full(n, _U(pow(_P, -1, 1 << 64)))]), dtype=_U)
        byte = mix64(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
        _CACHE["powers"] = up, down, byte
    return _CACHE["powers"]


_CACHE: dict = {}


def _hash_chunk(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word in raw; at most _CHUNK bytes, or one word of any length."""
    gap = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, _U), start, end
    size = end - start
    long = np.flatnonzero(size > _LONG)
    if len(raw) > _CHUNK:  # one long word
        value = np.zeros(len(start), _U)
    else:
        up, down, byte = _powers()
        with np.errstate(over="ignore"):
            total = np.concatenate([[_U(0)], np.cumsum(byte[_LOWER[raw]] * up[: len(raw)], dtype=_U)])
            value = mix64((total[end] - total[start]) * down[start] + size.astype(_U) * _U(0xA24BAED4963EE407))
    for i in long:
        value[i] = xxhash.xxh3_64_intdigest(_LOWER[raw[start[i] : end[i]]].tobytes())
    return value, start, end


def hash_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, first bytes and end bytes of the words [^ \\t-\\r]+ of UTF-8 bytes with A-Z in lower case.

    Inputs are taken in pieces cut at white space. A word's hash depends on its bytes alone: words of more than _LONG bytes go
    to another hash, wherever they stand.
    """
    if len(raw) <= _CHUNK:
        return _hash_chunk(raw)
    parts, at = [], 0
    while at < len(raw):
        stop = min(len(raw), at + _CHUNK)
        if stop < len(raw):
            gaps = np.flatnonzero(_SPACE[raw[at:stop]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:  # one word fills the piece
                after = np.flatnonzero(_SPACE[raw[stop:]])
                stop = stop + int(after[0]) if len(after) else len(raw)
        h, s, e = _hash_chunk(raw[at:stop])
        parts.append((h, s + at, e + at))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


@dataclass
class Words:
    """The words of several texts in a row: hash, first and end byte of each in `raw`, and each text's first word and byte."""

    raw: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    at: np.ndarray

    def places(self, run: int) -> np.ndarray:
        """Words from which `run` words of one text stand."""
        n = max(0, len(self.hash) - run + 1)
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        return np.flatnonzero(text[:n] == text[run - 1 :]) if n else np.zeros(0, np.int64)


def words_of(texts: list[str | None]) -> Words:
    raws = [utf8(t) for t in texts]
    gap = np.array([32], np.uint8)
    raw = np.concatenate([x for r in raws for x in (r, gap)]) if raws else gap[:0]
    at = np.cumsum([0, *(len(r) + 1 for r in raws)])
    value, start, end = hash_words(raw)
    return Words(raw, value, start, end, np.searchsorted(start, at), at)


def pieces_of(batches: Iterator[pd.DataFrame], size: int, column: str = "text") -> Iterator[pd.DataFrame]:
    """The rows again, in pieces of about `size` characters of text or one longer text."""
    for batch in batches:
        n = batch[column].map(lambda t: len(t) if t else 0).to_numpy("int64")
        piece = (np.cumsum(n) - n) // size
        for a, b in pairwise(_edges(piece)) if len(piece) else ():
            yield batch.iloc[a:b]


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of each run of k word hashes; with fewer words one hash of the whole sequence, without words none."""
    if not len(words):
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        if len(words) < k:
            value = np.zeros(1, _U)
            for w in words:
                value = value * _U(0x9FB21C651E98DF25) + w
            return mix64(value + _U(len(words)))
        n = len(words) - k + 1
        value = np.zeros(n, _U)
        for i in range(k):
            value = value * _U(0x9FB21C651E98DF25) + words[i : i + n]
        return mix64(value + _U(k))


def utf8(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


