"""Exact search and lattice near-duplicates against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tickloom.llm import lattice_dedup, topk_search
from tickloom.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_search(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    v = {r.vec_id: np.floor(1024 * np.array(r.embedding, "float64")).astype(int) for r in rows.collect()}
    got = {}
    for r in topk_search.search(rows, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in (i for i in v if i % 100 == 0):
        best = sorted(((-int(v[q] @ x), i) for i, x in v.items() if i != q))[:10]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [1.0, 1.0], 1), (3, [1.0, -1.0], 1), (4, None, 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (100, [1.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1))
    got = sorted(map(tuple, topk_search.search(df, F.col("vec_id") % 100 == 0).collect()))
    assert got == [(0, 1, 2, 1024 * 1024), (0, 2, 3, 1024 * 1024), (0, 3, 1, -1024 * 1024)]
    assert topk_search.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_search_scores_few_exactly(spark):
    """Phase 3 sees less than a tenth of all pairs of 2 000 vectors; the share falls as tables grow and cutoffs rise."""
    rows = table(spark, "/root/testdata/sf0.1", "embeddings").collect()
    v = np.floor(1024 * np.array([r.embedding for r in rows], "float64"))
    q = v[[r.vec_id % 100 == 0 for r in rows]]
    score = np.sort(q @ v.T, axis=1)
    reach = topk_search.reached(q, v, score[:, -11], 2)
    assert (reach.sum(axis=1) >= 11).all() and reach.mean() < 0.1


def test_search_repeated_and_huge(spark):
    rows = [(0, [1.0], 1), (1, [3e38], 1), (2, [-3e38], 1), (3, [0.5], 1), (3, [0.25], 1), (3, [0.5], 1)]
    got = sorted(map(tuple, topk_search.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0).collect()))
    assert [r[2] for r in got] == [1, 3, 2] and [r[3] for r in got] == [2**63 - 1, 1024 * 256, -(2**63)]


def planted(n=300, copies=12, seed=3):
    """Random unit vectors, each with noisy copies around cosine 0.98, some exact."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    out = [base]
    for c in range(copies):
        noise = rng.standard_normal(base.shape)
        noise /= np.linalg.norm(noise, axis=1)[:, None]
        out.append(base + noise * (0.0 if c == 0 else 0.12 + 0.006 * c))
    v = np.concatenate(out).astype("float32")
    return v, (np.arange(len(v)) % n) % 3


def test_lattice_of_any_magnitude_and_label(spark):
    """Squares that overflow or vanish link as others do; labels may be text, and only equal ones meet."""
    pairs = [([1e200, 0.0], [1e200, 1e190]), ([1e-200, 0.0], [3e-200, 1e-210]), ([1.0, 2.0], [2e150, 4e150])]
    rows = [(2 * i + k, v, f"label {i}") for i, pair in enumerate(pairs) for k, v in enumerate(pair)] + [(10, [1e200, 0.0], "other"), (11, [1e200, 1e200], "label 0"), (12, [1.0, 2.0], None)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    for i in range(3):
        assert got[2 * i] == (1, 2 * i, True) and got[2 * i + 1] == (1, 2 * i, False)
    assert all(got[i] == (0, i, True) for i in (10, 11, 12))


def test_lattice_recall_and_precision(spark):
    v, label = planted()
    df = spark.createDataFrame([(i, x.tolist(), int(y)) for i, (x, y) in enumerate(zip(v, label, strict=True))], SCHEMA)
    w = v.astype("float64")
    norm = np.sqrt((w * w).sum(1))
    near = ((w @ w.T) / (norm[:, None] * norm) >= 0.98) & (label[:, None] == label)
    true = near.sum(1) - 1
    rows = lattice_dedup.near_duplicates(df).orderBy("vec_id").collect()
    got = np.array([r.n_links for r in rows])
    assert (got <= true).all() and got.sum() >= 0.99 * true.sum()
    root = list(range(len(v)))
    for i in range(len(v)):  # the smallest id reachable, by relabelling
        for j in np.flatnonzero(near[i]):
            a, b = root[i], root[j]
            if a != b:
                root = [min(a, b) if r in (a, b) else r for r in root]
    same = sum(r.component_id == root[r.vec_id] for r in rows)
    assert same >= 0.99 * len(rows) and all(r.kept == (r.component_id == r.vec_id) for r in rows)


def test_codes_do_not_depend_on_the_batch():
    v, label = planted(200, 3)
    unit, _ = lattice_dedup._unit(list(v))
    codes = lattice_dedup.Codes(64, 8, 8, 1.0, 8)
    whole = codes(unit, label)
    for n in (1, 3, 50):
        assert all((codes(unit[i : i + n], label[i : i + n]) == whole[i : i + n]).all() for i in range(0, 200, 37))


def test_lattice_edges(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, [0.0, 0.0], 1), (6, None, 1), (7, [float("nan"), 1.0], 1), (8, [None, 1.0], 1), (9, [], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice_dedup.near_duplicates(df).collect()}
    assert got[0] == (2, 0, True) and got[1] == (2, 0, False) and got[2] == (2, 0, False)
    assert all(got[i] == (0, i, True) for i in range(3, 10))
    assert lattice_dedup.near_duplicates(df.limit(0)).count() == 0
    twice = lattice_dedup.near_duplicates(df.filter("vec_id = 0").union(df.filter("vec_id = 0"))).collect()
    assert [(r.vec_id, r.n_links, r.component_id) for r in twice] == [(0, 1, 0)] * 2


def test_nearest_point_is_a_lattice_point():
    x = np.random.default_rng(0).standard_normal((500, 8)) * 3
    p = lattice_dedup.nearest_point(x)
    twice = np.rint(2 * p)
    assert np.allclose(2 * p, twice) and ((twice % 2 == 0).all(1) | (twice % 2 != 0).all(1)).all() and (p.sum(1) % 2 == 0).all()
    assert (((x - p) ** 2).sum(1) <= 1 + 1e-9).all()  # the covering radius of E8 is 1
    assert len(lattice_dedup.minimal_vectors()) == 240
