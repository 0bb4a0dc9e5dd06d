"""Lexical search against a plain loop over all documents."""

import math
import re
from collections import Counter

import pytest

from tickloom.llm import lexical_search
from tickloom.llm.common import table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, k):
    """(item_id, rank, doc_id, score) by the formula, one document at a time."""
    counted = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c in counted:
            m = 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(TERM.findall((text or "").translate(LOWER))) if c[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[2] or 0))


@pytest.mark.parametrize("tiles", [(256, 1024, 4096, 4_000_000), (7, 16, 5, 2000)])
def test_search(spark, sf_dir, monkeypatch, tiles):
    """Any size of tiles and blocks gives the same result."""
    for name, value in zip(("ITEMS", "DOCS", "TERMS", "BLOCK_BYTES"), tiles, strict=True):
        monkeypatch.setattr(lexical_search, name, value)
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 50)
    got = [tuple(r) for r in lexical_search.search(docs.repartition(3), items).collect()]
    assert ordered(got) == ordered(want) and len(want) > 100


def test_search_edges(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names."""
    long = "alpha " + "beta gamma\n" * 300_000 + "x" * 3_000_000
    docs = [(5, "Alpha beta"), (3, "alpha BETA"), (3, "alpha beta"), (None, "alpha beta"), (7, None), (8, ""), (9, " .,;"), (10, long), (11, "ÄRGER ärger Ärger_1"), (12, "delta")]
    items = [(1, "alpha, alpha!"), (1, "beta"), (None, "gamma"), (2, None), (4, " - "), (6, "Ärger"), (7, "x" * 3_000_000), (8, "delta")]
    d = spark.createDataFrame([(*r, 0, 0) for r in docs], "doc_id long, text string, n int, rank int")
    i = spark.createDataFrame([(*r, 0, 0) for r in items], "item_id long, text string, score int, doc_id int")
    got = [tuple(r) for r in lexical_search.search(d, i, k=3).collect()]
    assert ordered(got) == ordered(plain(docs, items, 3))
    assert {r[2] for r in got if r[0] == 6} == {11} and [r[2] for r in ordered(got) if r[0] == 8] == [12]
    for a, b in ((d.limit(0), i), (d, i.limit(0)), (d.filter("doc_id = 7"), i)):
        assert lexical_search.search(a, b).count() == 0


def test_sums_are_exact():
    """The largest partial sum of a tile that any table can give stays a whole number in floating point."""
    assert 1000 * math.log(2 * 2**63 + 2) < 45_000 and 10**9 // 1000 == 10**6
    assert lexical_search.TERMS * 45_000 * 10**6 < 2**53
