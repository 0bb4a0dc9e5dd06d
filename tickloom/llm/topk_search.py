"""Exact top-k inner products by a three-phase uniform threshold.

The vector's dimensions are cut into `lists` segments; a segment's partial inner products are one score list. Phase 1 gathers
the k heads of every list; their exact scores alone give each query a safe cutoff, the k-th best of them. Phase 2 passes the
cutoff to all blocks and collects every entry whose partial score reaches cutoff / lists in some list: no other row can reach
the cutoff. Phase 3 resolves what was collected, and only that, exactly. Queries and rows meet as blocks (a stated query set
against all rows).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import stored

SCALE = 1024
#: Rows in a block of the table and of the queries.
ROWS, QUERIES = 4096, 512
_BLOCK = "ids binary, vectors binary, cutoffs binary, rows long"


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there and has finite components alone; the vector as integers floor(1024 x).

    Of vectors under one vec_id the first in array order stays.
    """
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole & (F.size("embedding") > 0))
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _blocks(rows: DataFrame, most: int, cutoffs: bool = False) -> DataFrame:
    """Rows as blocks of at most `most` vectors of one length."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["v"].map(len)
            for n in lengths.unique():
                own = batch[lengths == n]
                for at in range(0, len(own), most):
                    part = own.iloc[at : at + most]
                    cut = part["cutoff"].to_numpy("float64").tobytes() if cutoffs else b""
                    yield pd.DataFrame({"ids": [part["vec_id"].to_numpy("int64").tobytes()], "vectors": [np.stack(part["v"].to_list()).astype("int64").tobytes()], "cutoffs": [cut], "rows": [len(part)]})

    return rows.mapInPandas(join, _BLOCK)


def _small(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether all sums of products are whole numbers that floating point holds."""
    return float(np.abs(a.astype("float64")).max(initial=0)) * float(np.abs(b.astype("float64")).max(initial=0)) * max(1, a.shape[-1]) < 2**52


def _large(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of each row of a with each of b by whole numbers of any size, held within 64 bits."""
    return np.clip(a.astype(object) @ b.astype(object).T, -(2**63), 2**63 - 1).astype("int64")


def _pairs(rows: DataFrame, queries: DataFrame, schema: str, work: Callable) -> DataFrame:
    """Every block of queries with every block of rows, through `work(query ids, queries, cutoffs, row ids, rows)`."""

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in batch.itertuples(index=False):
                q_ids, ids = np.frombuffer(x.q_ids, "int64"), np.frombuffer(x.ids, "int64")
                q, v = np.frombuffer(x.q_vectors, "int64").reshape(len(q_ids), -1), np.frombuffer(x.vectors, "int64").reshape(len(ids), -1)
                if q.shape[1] == v.shape[1]:
                    yield work(q_ids, q, np.frombuffer(x.q_cutoffs, "float64"), ids, v)

    named = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    return rows.crossJoin(named).mapInPandas(meet, schema)


def _heads(ids: np.ndarray, scores: np.ndarray, k: int, among: np.ndarray) -> np.ndarray:
    """Places of the k best scores among the marked ones, ties to the smaller id."""
    at = np.flatnonzero(among)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def reached(q: np.ndarray, v: np.ndarray, cutoffs: np.ndarray, lists: int) -> np.ndarray:
    """Which rows (columns) reach a query's cutoff / lists in some list; floating point matrices of whole numbers."""
    out = np.zeros((len(q), len(v)), bool)
    for cols in np.array_split(np.arange(v.shape[1]), lists):
        out |= (q[:, cols] @ v[:, cols].T) * float(lists) >= cutoffs[:, None]
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 10, lists: int = 2) -> DataFrame:
    """Each query's k best rows but itself: query_id, rank, vec_id, score.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do null ids; vectors of different
    lengths do not meet. Ties go to the smaller vec_id. Rows repeated under one vec_id are one row, with the vector that is first
    in array order. Scores beyond 64 bits are held at their ends. With fewer than k others all are returned; an empty table or
    no query gives no rows. Other columns are not read.
    """
    usable = stored(_usable(vectors), "vectors")
    rows = stored(_blocks(usable, ROWS), "row-blocks")
    asked = usable.filter(is_query)
    parts = max(1, -(-asked.count() // QUERIES))
    spread = asked.repartition(parts, F.xxhash64("vec_id"))

    def first(q_ids, q, _, ids, v):
        out, small = [], _small(q, v)
        q, v = (q.astype("float64"), v.astype("float64")) if small else (q, v)
        for n, cols in enumerate(np.array_split(np.arange(v.shape[1]), lists)):
            partial = (q[:, cols] @ v[:, cols].T).astype("int64") if small else _large(q[:, cols], v[:, cols])
            for i, query in enumerate(q_ids):
                at = _heads(ids, partial[i], k, ids != query)
                out.append(pd.DataFrame({"query_id": query, "list": n, "vec_id": ids[at], "partial": partial[i, at]}))
        return pd.concat(out)

    local = _pairs(rows, _blocks(spread, QUERIES), "query_id long, list int, vec_id long, partial long", first)
    head = Window.partitionBy("query_id", "list").orderBy(F.desc("partial"), "vec_id")
    heads = local.withColumn("_r", F.row_number().over(head)).filter(F.col("_r") <= k).select("query_id", "vec_id").distinct()

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            q, v = (batch[c].map(lambda x: np.asarray(x, "int64")) for c in ("q", "v"))
            yield pd.DataFrame({"query_id": batch["query_id"], "score": [int(_large(a[None], b[None])[0, 0]) for a, b in zip(q, v, strict=True)]})

    both = heads.join(usable, "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    exact = both.select("query_id", "q", "v").mapInPandas(resolve, "query_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    cutoffs = exact.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("cutoff"))
    known = stored(spread.join(cutoffs, "vec_id", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(float("-inf")))), "cutoffs")

    def second(q_ids, q, cut, ids, v):
        out, small = [], _small(q, v)
        a, b = (q.astype("float64"), v.astype("float64")) if small else (q, v)
        reach = reached(a, b, cut, lists) if small else np.ones((len(q), len(v)), bool)
        for i, query in enumerate(q_ids):
            at = np.flatnonzero(reach[i] & (ids != query))
            score = (b[at] @ a[i]).astype("int64") if small else _large(a[i : i + 1], b[at])[0]
            best = _heads(ids[at], score, k, score.astype("float64") >= cut[i])
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[at[best]], "score": score[best]}))
        return pd.concat(out)

    found = _pairs(rows, _blocks(known.repartition(parts, F.xxhash64("vec_id")), QUERIES, True), "query_id long, vec_id long, score long", second)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sql(k: int = 10) -> str:
    """The same result by brute force in DuckDB."""
    return f"""
WITH v AS (SELECT vec_id, min(list_transform(embedding, lambda x: floor(1024 * x::DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, r.vec_id, list_dot_product(q.e, r.e)::BIGINT AS score FROM v q JOIN v r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id AND len(q.e) = len(r.e))
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}
"""
