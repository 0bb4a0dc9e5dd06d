"""Whitening against plain matrix work on all rows at once."""

import math

import numpy as np
import pytest

from tickloom.llm import whitening
from tickloom.llm.common import table

SCHEMA = "vec_id long, embedding array<double>, n int, component string"


def plain(rows, components, copies=False):
    """{(vec_id, component): (n, deviation, whitened, explained)} by numpy on one table."""
    x = {i: tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for i, v in rows}
    fit = list(x.values()) if copies else sorted(set(x.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    a = np.array(fit, "float64") - np.array([s / n for s in sums])
    value, vector = np.linalg.eigh(a.T @ a / n)
    out = {}
    for i, v in x.items():
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        for k in range(min(components, len(sums))):
            e, u = value[-1 - k], vector[:, -1 - k]
            out[i, k + 1] = n, deviation, float((np.array(v) - np.array([s / n for s in sums])) @ u) / math.sqrt(e), e / value.sum()
    return out


@pytest.mark.parametrize("weights", ["one", "copies"])
def test_whiten(spark, sf_dir, weights):
    """With hot groups of copies; each vector's row equals the plain result, and signs are the same for all rows."""
    have = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    rows = have + [(10_000 + i, have[0][1]) for i in range(400)] + [(20_000 + i, have[1][1]) for i in range(30)]
    df = spark.createDataFrame([(i, [float(c) for c in v], 0, "x") for i, v in rows], SCHEMA)
    want = plain(rows, 16, weights == "copies")
    got = whitening.digest(whitening.whiten(df, weights=weights)).collect()
    assert len(got) == len(want) == len(rows) * 16
    signs = {}
    for r in got:
        n, deviation, whitened, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation) and r.identity_error < 1e-6
        assert abs(abs(r.whitened) - abs(whitened)) < 1e-6 and abs(r.explained / explained - 1) < 1e-9
        if abs(whitened) > 1e-3:
            signs.setdefault(r.component, set()).add(r.whitened * whitened > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_whiten_edges(spark):
    """Nulls, non-finite entries, other lengths, repeated rows, clashing names, fewer vectors than dimensions, huge entries."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 0.001]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, [])]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)
    got = whitening.digest(whitening.whiten(df)).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted([("1", 1), ("1", 1), ("2", 1), ("None", 1), ("1", 2), ("1", 2), ("2", 2), ("None", 2)])
    assert {r.n for r in got} == {2}, "0.001 * 64 is floored to the same x"
    assert {r.deviation for r in got} == {64**2 * 2} and {r.copies for r in got if r.vec_id == 1} == {3}
    assert {round(abs(r.whitened), 9) for r in got if r.component == 1} == {1.0} and {r.whitened for r in got if r.component == 2} == {None}
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.filter("vec_id = 4")).count() == 0
    same = whitening.whiten(df.filter("vec_id = 1")).collect()
    assert len(same) == 4 and {(r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in same} == {(None, None, None, 0)}
    huge = spark.createDataFrame([(1, [1e300, 0.0], 0, ""), (2, [-1e300, 0.5], 0, "")], SCHEMA)
    held = whitening.whiten(huge).collect()
    assert len(held) == 4 and {r.deviation for r in whitening.digest(whitening.whiten(huge)).collect()} == {None}
    big = spark.createDataFrame([(i, [1e9 * i, 1.0], 0, "") for i in range(50)], SCHEMA)
    n, xs = 50, [64 * 10**9 * i + 10**6 for i in range(50)]
    for r in whitening.whiten(big).collect():
        assert int(r.deviation) == (n * xs[r.vec_id] - sum(xs)) ** 2


def test_more_partitions_than_dimensions(spark):
    """Tasks without any row leave nothing."""
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("false", "20"), strict=True):
        spark.conf.set(n, v)
    try:
        df = spark.createDataFrame([(i, [float(i % 3), float(i % 2)], 0, "") for i in range(12)], SCHEMA)
        got = whitening.whiten(df).collect()
        assert len(got) == 24 and {r.n for r in got} == {6} and max(r.identity_error for r in got) < 1e-9
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
