"""Ranked lexical search by dense blocked matrix products.

Items come in blocks of bounded size. A block's terms are numbered item by item; documents are counted against these numbers
once and stored as postings. Tiles of items keep the terms of their own items alone (a compact vocabulary), tiles of documents
are dense impacts over those terms, and their product in float64 is the score. A vocabulary tile is so narrow that no partial
sum reaches 2**53, so every product is a whole number without rounding; tiles are added as 64-bit integers. A tile leaves what
reaches an item's k-th best score so far, ties included, and ties go to the smaller doc_id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import NO_ID, discard, pieces_of, real_id, safe_id, stored

#: Bytes of the distinct terms of a block's items; one item with more is a block of its own.
BLOCK_BYTES = 4_000_000
#: Items, documents and terms of a tile. A weight stays below 45 000 and an impact below 1 000 000 at any size of table, so a
#: partial sum stays below TERMS * 4.5e10, which is less than 2**53.
ITEMS, DOCS, TERMS = 256, 1024, 4096
#: Groups of tasks whose lists are cut to k before an item's lists meet.
GROUPS = 32
#: Bytes that are split into terms at once.
_PIECE = 1 << 20
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_CAPITALS = bytes(range(0x41, 0x5B))
_PLAIN = bytes.maketrans(_SEPARATORS + _CAPITALS, b" " * len(_SEPARATORS) + _CAPITALS.lower())


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text as UTF-8, in lists of bounded size: what stands between ASCII characters that are no letters or digits."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN)
    at = 0
    while at < len(raw):
        stop = raw.find(b" ", at + _PIECE)
        stop = len(raw) if stop < 0 else stop
        yield raw[at:stop].split()
        at = stop


def _blocks(items: DataFrame) -> DataFrame:
    """(bucket, block, item_id, terms): an item's distinct terms, and the block that it is in."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            terms = [sorted({t for part in terms_of(text) for t in part}) for text in batch["text"]]
            yield pd.DataFrame({"item_id": batch["item_id"], "terms": terms, "bytes": [sum(map(len, t)) for t in terms]})

    rows = items.select(safe_id("item_id"), "text").mapInPandas(split, "item_id long, terms array<binary>, bytes long").filter("bytes > 0")
    cut = stored(rows.withColumn("row", F.monotonically_increasing_id()), "items")
    total = cut.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bucket = F.pmod("row", F.lit(max(1, total // (64 * BLOCK_BYTES))))
    order = Window.partitionBy("bucket").orderBy("row")
    numbered = cut.withColumn("bucket", bucket).withColumn("block", F.floor((F.sum("bytes").over(order) - F.col("bytes")) / BLOCK_BYTES))
    return stored(numbered.select("bucket", "block", "item_id", "terms"), "item-blocks")


def _postings(documents: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of each document with a term: how many it has, which of the numbered ones and how often."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces_of(batches, 8 * _PIECE):
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                n, found = 0, Counter()
                for part in terms_of(text):
                    n += len(part)
                    found.update(map(numbers.get, part))
                if n:
                    found.pop(None, None)
                    out.append((doc_id, n, np.fromiter(found.keys(), "int32", len(found)).tobytes(), np.fromiter(found.values(), "int32", len(found)).tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "n", "terms", "counts"])

    return documents.select(safe_id(), "text").mapInPandas(count, "doc_id long, n long, terms binary, counts binary")


def _holders(postings: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each of `size` terms."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, "int64")
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch["terms"]), "int32"), minlength=size)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"term": held.astype("int32"), "df": total[held]})

    sums = postings.select("terms").mapInPandas(add, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(size, "int64")
    out[sums["term"]] = sums["df"]
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id, null ids last."""
    return np.lexsort((ids, ids == NO_ID, -scores))[:k]


def _scored(postings: DataFrame, items: list[np.ndarray], weights: np.ndarray, documents: int, terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): of each task's documents the k best ones for each item, which is a list of term numbers."""

    def impacts(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document (by place), term and impact of each posting."""
        at = np.repeat(np.arange(len(batch)), batch["terms"].map(len) // 4)
        m = np.array([50 + (50 * n * documents) // terms for n in batch["n"].tolist()], "int64")
        tf = np.frombuffer(b"".join(batch["counts"]), "int32").astype("int64")
        return at, np.frombuffer(b"".join(batch["terms"]), "int32"), (1_000_000_000 * tf) // (1000 * tf + 20 * m[at])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [(np.zeros(0, "int64"), np.zeros(0, "int64"))] * len(items)
        place = np.full(len(weights), -1)
        for batch in batches:
            if batch.empty:
                continue
            doc, term, impact = impacts(batch)
            ids = batch["doc_id"].to_numpy("int64")
            for first in range(0, len(items), ITEMS):
                own = items[first : first + ITEMS]
                words = np.unique(np.concatenate(own))
                place[words] = np.arange(len(words))
                left = np.zeros((len(own), len(words)))
                for i, t in enumerate(own):
                    left[i, place[t]] = weights[t]
                column = place[term]
                place[words] = -1
                hit = np.flatnonzero(column >= 0)
                for lo in range(0, len(ids), DOCS):
                    part = hit[slice(*np.searchsorted(doc[hit], [lo, lo + DOCS]))]
                    right = np.zeros((len(words), min(DOCS, len(ids) - lo)))
                    right[column[part], doc[part] - lo] = impact[part]
                    total = np.zeros((len(own), right.shape[1]), "int64")
                    for a, b in pairwise([*range(0, len(words), TERMS), len(words)]):
                        total += (left[:, a:b] @ right[a:b]).astype("int64")
                    for i, row in enumerate(total, first):
                        known, scores = best[i]
                        new = np.flatnonzero(row >= (scores[-1] if len(scores) == k else 1))
                        if len(new):
                            known, scores = np.concatenate([known, ids[lo + new]]), np.concatenate([scores, row[new]])
                            top = _best(known, scores, k)
                            best[i] = known[top], scores[top]
        for i, (known, scores) in enumerate(best):
            if len(known):
                yield pd.DataFrame({"item": i, "doc_id": known, "score": scores})

    return postings.mapInPandas(score, "item int, doc_id long, score long")


def search(documents: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """Each item's k best documents (all that score, if fewer): item_id, rank, doc_id, score.

    Null and empty texts and texts without a term match nothing and count in no statistic; texts of any length count whole. Equal
    scores go by ascending doc_id, null ids last. Repeated rows are documents, or items, of their own: each row of `items` has
    its own ranks from 1. An empty table on either side gives no rows. Only doc_id, item_id and text are read.
    """
    spark = documents.sparkSession
    cut = _blocks(items)
    found = []
    for at in cut.select("bucket", "block").distinct().orderBy("bucket", "block").collect():
        block = cut.filter((F.col("bucket") == at["bucket"]) & (F.col("block") == at["block"])).select("item_id", "terms").collect()
        numbers: dict[bytes, int] = {}
        own = [np.array([numbers.setdefault(bytes(t), len(numbers)) for t in row["terms"]], "int32") for row in block]
        postings = stored(_postings(documents, numbers), "postings")
        n, total = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for df in _holders(postings, len(numbers)).tolist()], "float64")
        local = _scored(postings, own, weights, n, total, k).withColumn("group", F.spark_partition_id() % GROUPS)
        best = local
        for keys in (["item", "group"], ["item"]):
            order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id") == NO_ID, "doc_id")
            best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, row["item_id"]) for i, row in enumerate(block)], "item int, item_id long")
        found.append(stored(best.join(F.broadcast(names), "item").select(real_id("item_id"), "rank", real_id(), "score"), "ranks"))
        discard(postings)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def sql(k: int = 50) -> str:
    """The same result by joins in DuckDB."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS t FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, list_distinct({words}) AS t FROM benchmark),
s AS (SELECT count(*)::BIGINT AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term), s),
x AS (SELECT r, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(d.t) * n) // l)) AS impact FROM p JOIN d USING (r), s),
y AS (SELECT q, r, sum(w * impact)::BIGINT AS score FROM (SELECT q, unnest(t) AS term FROM i) JOIN w USING (term) JOIN x USING (term) GROUP BY q, r),
z AS (SELECT i.item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, d.doc_id NULLS LAST) AS rank, d.doc_id, score FROM y JOIN d USING (r) JOIN i USING (q) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM z WHERE rank <= {k}
"""
