import contextlib
import io
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tickloom.llm import packing
from tickloom.llm.common import table


def whole(rows, ids):
    """Every id in exactly one piece, sequences gapless and within the capacity."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[doc])
            assert zlib.crc32(ids[doc][r.start : r.start + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids[doc])
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return 1 - sum(r.length for r in rows) / 1024 / len(by_seq)


def ids_of(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for d, x in texts}


def test_round_trip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ids = ids_of([(r.doc_id, r.text) for r in docs.collect()])
    rows = packing.pack(docs).collect()
    assert {r.doc_id for r in rows} == set(ids)
    assert whole(rows, ids) < 0.01


def test_edges(spark):
    texts = [(1, None), (2, ""), (3, "word " * 30_000), (4, "a <|endoftext|> é 日本"), (5, "<|endoftext|><|endoftext|>  x  <|endoftext|"), (None, "b")]
    docs = spark.createDataFrame([(d, t, 5) for d, t in texts], "doc_id long, text string, length int")
    whole(packing.pack(docs).collect(), ids_of(texts))
    assert packing.pack(docs.limit(0)).count() == 0
    again = packing.pack(docs.filter("doc_id = 1").union(docs.filter("doc_id = 1"))).collect()
    assert [(r.start, r.length) for r in again] == [(0, 1), (0, 1)] and {r.offset for r in again} == {0, 1}


def test_plan_starts_no_python(spark):
    """A table of places made from a list is an RDD of Python's, whose workers stay on the executors."""
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    with contextlib.redirect_stdout(io.StringIO()) as said:
        packing.pack(docs).explain("simple")
    assert "LocalTableScan" in said.getvalue() and "ExistingRDD" not in said.getvalue()


def test_plan_uses_each_piece_once():
    rng = np.random.default_rng(1)
    histogram = {int(k): int(n) for k, n in zip(range(1, 1025, 7), rng.integers(1, 40, 200))}
    used = {}
    for pattern, times in packing.plan(histogram, 1024):
        assert sum(k * n for k, n in pattern.items()) <= 1024
        for k, n in pattern.items():
            used[k] = used.get(k, 0) + n * times
    assert used == histogram
