"""Embedding near-duplicates by hashing to E8 lattice cells in several tables.

Equal vectors are one class with a multiplicity. Each class is projected to eight dimensions per table, decoded to its nearest
E8 point (its home cell) and listed under the neighbouring cells nearest to it as well (probes). Cells are counted first, by
ids alone; vectors travel only to cells where a home meets another class. Cells with many classes are cut into blocks and
every pair of blocks is a group of bounded size. A pair found in several cells counts in the first of them only, which both
sides can tell from their own codes; so links are counted exactly once and never written out as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import mix64, stored
from tickloom.llm.components import components

#: Classes of one cell that are compared as one group; larger cells are cut into blocks.
BLOCK = 512
#: Pairs that are looked at together.
_PAIRS = 1 << 18


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: pairs of +-1, and eight +-1/2 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1.0, 1.0):
                for b in (-1.0, 1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        if bin(bits).count("1") % 2 == 0:
            out.append(np.array([-0.5 if bits >> k & 1 else 0.5 for k in range(8)]))
    return np.array(out)


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the better of D8 and D8 + 1/2; D8 by rounding, the worst coordinate turned if the sum is odd."""

    def d8(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        odd = np.flatnonzero(r.sum(axis=1) % 2)
        err = y[odd] - r[odd]
        worst = np.abs(err).argmax(axis=1)
        r[odd, worst] += np.where(err[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
        return r

    a, b = d8(x), d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


class Codes:
    """Home cell and probed cells of vectors in every table: int64 array (rows, tables, 1 + probes).

    Vectors and planes are rounded to whole multiples of small powers of two, so that every sum is exact and a vector has the
    same cells in whatever batch it is coded.
    """

    FINE, PLANE = 2.0**22, 2.0**20

    def __init__(self, dims: int, tables: int, probes: int, scale: float, seed: int):
        rng = np.random.default_rng([seed, dims])
        self.planes = np.rint(rng.standard_normal((tables, dims, 8)) * scale * self.PLANE)
        self.shifts = np.rint(rng.uniform(0, 1, (tables, 8)) * self.PLANE) / self.PLANE
        self.near, self.probes = minimal_vectors(), probes

    @staticmethod
    def _hash(points: np.ndarray, table: int, labels: np.ndarray) -> np.ndarray:
        value = mix64(labels.astype("int64").view("uint64") + np.uint64(table * 0x9E3779B9 + 1))
        twice = np.rint(2 * points).astype("int64").view("uint64")
        for k in range(8):
            value = mix64(value ^ (twice[..., k] + np.uint64(0x9E3779B97F4A7C15)))
        return value.view("int64")

    def __call__(self, unit: np.ndarray, labels: np.ndarray) -> np.ndarray:
        out = np.empty((len(unit), len(self.planes), 1 + self.probes), "int64")
        whole = np.rint(unit * self.FINE)
        for t, plane in enumerate(self.planes):
            x = whole @ plane / (self.FINE * self.PLANE) + self.shifts[t]
            home = nearest_point(x)
            out[:, t, 0] = self._hash(home, t, labels)
            if self.probes:
                best = np.argpartition(-((x - home) @ self.near.T), self.probes - 1, axis=1)[:, : self.probes]
                for p in range(self.probes):
                    out[:, t, 1 + p] = self._hash(home + self.near[best[:, p]], t, labels)
        return out


def _unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and the vectors scaled by powers of two (which rounds nothing) so that no square overflows or vanishes."""
    v = np.stack(vectors).astype("float64")
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
    norm = np.sqrt((v * v).sum(axis=1))
    return v / norm[:, None], v


def _first_shared(ci: np.ndarray, cj: np.ndarray) -> np.ndarray:
    """The first cell, by table, that is home to one of each pair and listed by the other; the lower id's home goes first."""
    out, open_ = np.zeros(len(ci), "int64"), np.ones(len(ci), bool)
    for t in range(ci.shape[1]):
        for a, b in ((ci, cj), (cj, ci)):
            hit = open_ & (b[:, t] == a[:, t, :1]).any(axis=1)
            out[hit] = a[hit, t, 0]
            open_ &= ~hit
    return out


def _compare(group: pd.DataFrame, codes: np.ndarray, v: np.ndarray, least: float) -> Iterator[tuple[int, int | None, int]]:
    """(id, null, linked copies) and (id, other, 0) as edges, of one group: the pairs of two blocks of a cell."""
    cell, lo, hi = (int(group[c].iat[0]) for c in ("cell", "i", "j"))
    ids, block, home, copies = (group[c].to_numpy() for c in ("id", "block", "home", "copies"))
    norm = np.sqrt((v * v).sum(axis=1))
    links = np.zeros(len(ids), "int64")
    root = np.arange(len(ids))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    step = max(1, _PAIRS // max(1, len(ids)))
    for at in range(0, len(ids), step):
        mine = slice(at, at + step)
        near = (v[mine] @ v.T) / (norm[mine, None] * norm) >= least
        near &= (ids[mine, None] < ids) & (home[mine, None] | home)
        if lo != hi:
            near &= block[mine, None] != block
        a, b = np.nonzero(near)
        a += at
        own = _first_shared(codes[a], codes[b]) == cell
        for x, y in ((a, b), (b, a)):
            np.add.at(links, x[own], copies[y[own]])
        for x, y in zip(a[own].tolist(), b[own].tolist(), strict=True):
            if (p := find(x)) != (q := find(y)):
                root[q] = p
                yield int(ids[x]), int(ids[y]), 0
    for x in np.flatnonzero(links):
        yield int(ids[x]), None, int(links[x])


def near_duplicates(vectors: DataFrame, least: float = 0.98, tables: int = 8, probes: int = 8, scale: float = 1.0, seed: int = 8) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept.

    Only vectors of the same label meet; a label may be of any type. Vectors that are null, empty, zero or hold null or non-finite components, and those
    without label, link with nothing: no links, their own component, kept. Rows repeated under one vec_id are vectors of their
    own: they link with each other and count in n_links. An empty table gives no rows; other columns are not read. Recall against
    brute force is measured in the tests (above 0.99 at these parameters).
    """
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & whole & F.exists("embedding", lambda x: x != 0)
    alike = [F.xxhash64("label", "embedding"), F.xxhash64(F.lit(1), "embedding", "label")]
    rows = vectors.filter(usable).select("vec_id", F.xxhash64("label").alias("label"), F.col("embedding").cast("array<double>").alias("v"), alike[0].alias("h"), alike[1].alias("g"))
    classes = stored(rows.groupBy("h", "g").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")), "classes")
    kept: dict[int, Codes] = {}

    def codes_of(v: list, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unit, plain = _unit(v)
        dims = unit.shape[1]
        if dims not in kept:
            kept[dims] = Codes(dims, tables, probes, scale, seed)
        return kept[dims](unit, labels + 1_000_003 * dims), plain

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["v"].map(len)
            for n in lengths.unique():
                own = batch[lengths == n]
                for at in range(0, len(own), 2048):
                    part = own.iloc[at : at + 2048]
                    code, _ = codes_of(part["v"].to_list(), part["label"].to_numpy("int64"))
                    m = code.shape[1] * code.shape[2]
                    home = np.tile(np.arange(code.shape[2]) == 0, (len(part), code.shape[1], 1)).ravel()
                    yield pd.DataFrame({"cell": code.reshape(-1), "id": np.repeat(part["id"].to_numpy("int64"), m), "home": home})

    listed = classes.select("id", "label", "v").mapInPandas(cells, "cell long, id long, home boolean").groupBy("cell", "id").agg(F.max("home").alias("home"))
    listed = stored(listed, "cells")
    # Ids alone are counted; a cell's share of salted partial counts never holds its rows together.
    shared = listed.groupBy("cell").agg(F.count("*").alias("n"), F.max("home").alias("any_home")).filter("n > 1 AND any_home").select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = listed.join(shared, "cell").withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("cell", "id", "home", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).join(classes.select("id", "label", "copies", "v"), "id")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = rest.iloc[-1]
            ended = ~((rest["cell"] == last["cell"]) & (rest["i"] == last["i"]) & (rest["j"] == last["j"]))
            if ended.any():
                yield from groups(rest[ended])
                rest = rest[~ended].reset_index(drop=True)
        if rest is not None and len(rest):
            yield from groups(rest)

    def groups(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        lengths = rows["v"].map(len)
        for n in lengths.unique():
            own = rows[lengths == n].reset_index(drop=True)
            code, v = codes_of(own["v"].to_list(), own["label"].to_numpy("int64"))
            at = np.flatnonzero((own[["cell", "i", "j"]] != own[["cell", "i", "j"]].shift()).any(axis=1).to_numpy())
            out = []
            for a, b in zip(at, [*at[1:], len(own)], strict=True):
                if b - a > 1:
                    out += _compare(own.iloc[a:b], code[a:b], v[a:b], least)
            if out:
                yield pd.DataFrame({"a": [x[0] for x in out], "b": pd.array([x[1] for x in out], "Int64"), "n": [x[2] for x in out]})

    spread = placed.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "id")
    found = stored(spread.mapInPandas(compare, "a long, b long, n long"), "links")
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    parts = components(found.filter("b IS NOT NULL").select("a", "b"))
    known = classes.select("h", "g", "id", "copies").join(links, "id", "left").join(parts, "id", "left")
    known = known.select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    keyed = vectors.select("vec_id", F.when(usable, alike[0]).alias("h"), F.when(usable, alike[1]).alias("g"))
    own = F.coalesce("component_id", "vec_id")
    return keyed.join(known, ["h", "g"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(True)).alias("kept"))
