"""Whitening of embeddings by the covariance of their distinct integer vectors.

Vectors become whole numbers x = floor(64 c) + 1000000. Rows are grouped by equal x, with partial counts, so a vector that a
third of all rows hold is one row from then on. Each distinct vector has a weight in the fit, its count of copies or one. Means
are exact; every task multiplies its centred vectors (a weighted Gram matrix), and the sums of these are the covariance, of
whose size alone the driver holds anything. Distinct vectors are whitened once and go back to their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import discard, join_groups, stored

SCALE, SHIFT = 64, 1_000_000
#: Scaled entries beyond this are held there, so that x stays within 64 bits.
_HELD = 9e18
#: Variance, as a share of the greatest, up to which a component counts as having none.
_NONE = 1e-13


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, k1, k2, x) of the rows whose vector is whole: x as longs, and 128 bits that name it."""
    c = F.col(vector_col)
    whole = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    held = lambda v: F.greatest(F.least(v.cast("double") * SCALE, F.lit(_HELD)), F.lit(-_HELD))
    x = F.transform(c, lambda v: F.floor(held(v)) + SHIFT)
    rows = vectors.filter(c.isNotNull() & whole & (F.size(c) > 0)).select(F.col(id_col).alias("id"), x.alias("x"))
    return rows.select("id", F.xxhash64("x").alias("k1"), F.xxhash64(F.lit("second"), "x").alias("k2"), "x")


def _matrix(batch: pd.DataFrame) -> np.ndarray:
    return np.stack(batch["x"].to_list()).astype("int64")


def _sums(distinct: DataFrame) -> tuple[int, list[int]]:
    """Total weight and the exact weighted sum of each dimension."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for batch in batches:
            if len(batch):
                x, w = _matrix(batch), batch["weight"].to_numpy("int64")
                small = int(w.sum()) * max(abs(int(x.max())), abs(int(x.min()))) < 2**62
                own = (w @ x if small else w.astype(object) @ x.astype(object)).astype(object)
                total, n = (own if total is None else total + own), n + int(w.sum())
        if total is not None:
            yield pd.DataFrame({"dim": np.arange(-1, len(total)), "s": [Decimal(n), *map(Decimal, total)]})

    sums = distinct.select("x", "weight").mapInPandas(add, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").cast("string").alias("s"))
    found = {r["dim"]: int(r["s"]) for r in sums.collect()}
    return found.pop(-1), [found[i] for i in range(len(found))]


def _gram(distinct: DataFrame, project: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The weighted sum of y y' over the distinct vectors, y = project(x): by task, then by rows of the matrix."""

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                y, w = project(_matrix(batch)), batch["weight"].to_numpy("float64")
                part = y.T @ (y * w[:, None])
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total)})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch["i"], batch["row"], strict=True):
                total[i] = total[i] + row if i in total else row
        if total:
            yield pd.DataFrame({"i": list(total), "row": list(total.values())})

    schema = "i int, row array<double>"
    out = np.zeros((width, width))
    for r in distinct.select("x", "weight").mapInPandas(own, schema).repartition("i").mapInPandas(add, schema).collect():
        out[r["i"]] = r["row"]
    return out


class _Fit:
    """The fitted transformation; small enough for every task: means, and `components` directions of the dimension's length."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], "int64")
        self.rest = np.array([float(Fraction(s, n) - s // n) for s in sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        if np.abs(x.astype("float64")).max() + np.abs(self.whole.astype("float64")).max() < 2**62:
            return (x - self.whole).astype("float64") - self.rest
        return (x.astype(object) - self.whole.astype(object)).astype("float64") - self.rest

    def directions(self, covariance: np.ndarray, components: int) -> None:
        value, vector = np.linalg.eigh(covariance)
        value, vector = value[::-1][:components], vector[:, ::-1][:, :components]
        vector = vector * np.where(vector[np.abs(vector).argmax(axis=0), np.arange(vector.shape[1])] < 0, -1.0, 1.0)
        self.varies = value > max(value[0], 0.0) * _NONE
        self.project = vector[:, self.varies] / np.sqrt(value[self.varies])
        trace = float(np.trace(covariance))
        self.explained = [float(v) / trace if trace > 0 else None for v in value]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.project

    def deviations(self, x: np.ndarray) -> list[Decimal]:
        """The sum over dimensions of (n x - S)**2, exactly."""
        most = self.n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, self.sums))
        kind = "int64" if most < 2**62 else object
        y = x.astype(kind) * self.n - np.array(self.sums, kind)
        if kind == object or int(np.abs(y).max()) ** 2 * y.shape[1] >= 2**63:
            y = y.astype(object)
        found = map(int, (y * y).sum(axis=1))
        return [Decimal(v) if v < 10**38 else None for v in found]


def whiten(vectors: DataFrame, components: int = 16, weights: str = "one", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each whole vector and component: id_col, component, n, deviation, whitened, explained, identity_error, copies.

    `weights`: "one" fits on each distinct x once, "copies" counts it as often as rows hold it; n is the total weight. deviation
    is decimal(38,0), null beyond it. Vectors that are null, empty or hold null or non-finite entries are left out; of different
    lengths the one that most rows have is fitted (the longer of two) and the others are left out, as they have no covariance.
    Scaled entries beyond 9e18 are held there. Components without variance (all vectors equal, fewer vectors than dimensions)
    have no direction: whitened is null there, and identity_error is over the others. Repeated rows and null ids are rows like
    any other; an empty table gives no rows. Other columns are not read.
    """
    if weights not in ("one", "copies"):
        raise ValueError(f"weights: one or copies, not {weights!r}")
    spark = vectors.sparkSession
    rows = _rows(vectors, id_col, vector_col)
    groups = stored(rows.groupBy("k1", "k2", "x").agg(F.count("*").alias("copies")), "distinct-vectors")
    lengths = groups.groupBy(F.size("x").alias("n")).agg(F.sum("copies").alias("rows"))
    usual = lengths.orderBy(F.desc("rows"), F.desc("n")).first()
    kind = f"{id_col} {dict(vectors.dtypes)[id_col]}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double, copies long"
    if usual is None:
        return spark.createDataFrame([], kind)
    width, total = usual["n"], usual["rows"]
    distinct = groups.filter(F.size("x") == width).withColumn("weight", F.lit(1).cast("long") if weights == "one" else F.col("copies"))
    fit = _Fit(*_sums(distinct))
    fit.directions(_gram(distinct, fit.centred, width) / fit.n, min(components, width))
    some = int(fit.varies.sum())
    moments = _gram(distinct, lambda x: np.column_stack([fit.whitened(x), np.ones(len(x))]), some + 1) / fit.n
    mean = moments[-1, :-1]
    error = float(np.abs(moments[:-1, :-1] - np.outer(mean, mean) - np.eye(some)).max()) if some else None

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch)
                out = batch[["k1", "k2", "copies"]].copy()
                out["deviation"] = fit.deviations(x)
                z = np.full((len(x), len(fit.varies)), None, object)
                z[:, fit.varies] = fit.whitened(x)
                out["z"] = list(z)
                yield out

    done = distinct.select("k1", "k2", "copies", "x").mapInPandas(once, "k1 long, k2 long, copies long, deviation decimal(38,0), z array<double>")
    done = stored(done, "whitened-vectors")
    named = rows.filter(F.size("x") == width).select("id", "k1", "k2")
    back = join_groups(named, done, ["k1", "k2"], total)
    discard(groups)
    explained = F.array(*[F.lit(v).cast("double") for v in fit.explained])
    out = back.select("id", "copies", "deviation", F.posexplode("z").alias("at", "whitened"))
    return out.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"), "copies",
    )


def digest(whitened: DataFrame) -> DataFrame:
    """The rows with deviation as a long, null where 64 bits do not hold it."""
    return whitened.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
