"""The pipeline's stages against brute force, each on what its predecessor kept, and their edges."""

from collections import Counter

import corpus_pipeline as cp
from pyspark.sql import functions as F

from tests.llm.test_groups import brute, shingles
from tests.llm.test_packing import ids_of, whole
from tests.llm.test_pii import brute_force
from tickloom.llm import mixing, pii, toxicity
from tickloom.llm.common import stored, table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, labels = docs.columns, table(spark, sf_dir, "labels")
    stages = dict(cp.STAGES)
    assert list(stages) == ["toxicity", "ngram_join", "pii", "mixing", "packing"]

    kept = stored(stages["toxicity"](spark, docs, sf_dir), "toxicity")
    score = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    assert kept.columns == columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, s in score.items() if s < 0.5)
    assert 0 < kept.count() < docs.count()

    single = stored(stages["ngram_join"](spark, kept, sf_dir), "ngram_join")
    groups = brute({r.doc_id: shingles(r.text) for r in kept.collect()})
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(d for d, c in groups.items() if d == c)

    clean = stored(stages["pii"](spark, single, sf_dir), "pii")
    before = {r.doc_id: r.text for r in single.collect()}
    for r in clean.collect():
        want, at = "", 0
        for kind, a, b, _ in pii.spans_of(before[r.doc_id]):
            if a >= at:
                want += before[r.doc_id][at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        assert r.text == want + before[r.doc_id][at:] and r.n_chars == len(r.text) and brute_force(r.text)[0] == [0, 0, 0, 0]
    assert clean.columns == columns and clean.count() == len(before)

    mixed = stored(stages["mixing"](spark, clean, sf_dir), "mixing")
    texts = {r.doc_id: r.text for r in clean.collect()}
    rows = mixed.collect()
    assert mixed.columns == columns and all(texts[r.doc_id].startswith(r.text) for r in rows)
    takes = Counter((r.doc_id, r["take"]) for r in mixing.mix(clean).collect())
    assert takes == Counter((r.doc_id, len(mixing_words(r.text))) for r in rows)

    numbered = [(i, r.text) for i, r in enumerate(rows)]
    df = spark.createDataFrame(numbered, "doc_id long, text string")
    assert whole(stages["packing"](spark, df, sf_dir).collect(), ids_of(numbered)) < 0.05
    assert {r.doc_id for r in stages["packing"](spark, mixed, sf_dir).collect()} == {r.doc_id for r in rows}


def test_workers_give_memory_back(spark, sf_dir):
    """What a stage's workers have freed goes back to the system: between stages they hold little more than at their start."""
    dict(cp.STAGES)["pii"](spark, table(spark, sf_dir, "documents"), sf_dir)

    def held(batches):
        import numpy as np
        import pyarrow as pa

        resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6
        for batch in batches:
            before = resident()
            for _ in range(3):  # arrays of 1 to 8 MB, as of texts in pieces, with a small object behind each
                arrays, small = [], []
                for size in range(1, 9):
                    arrays.append(np.ones(size * 125_000))
                    arrays.append(pa.array(arrays[-1].tolist()))
                    small.append(np.ones(1000))
                del arrays
            batch["mb"], batch["pool"] = resident() - before, pa.default_memory_pool().backend_name
            yield batch

    row = spark.range(1, numPartitions=1).mapInPandas(held, "id long, mb double, pool string").first()
    assert row.pool == "system" and row.mb < 12


def mixing_words(text):
    return [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]


def test_edges(spark, sf_dir):
    """Nulls in any column, empty and very long texts, ties, repeated rows, other columns with clashing names, an empty table."""
    rows = [
        (1, None, None, None, None, "x"), (2, "", "en", "src1", 0, None), (3, " \n", "en", "src1", 2, "x"), (None, "clean words here", None, "src2", 16, "x"), (None, None, None, None, None, None),
        (4, "long " * 60_000, "de", "src3", None, "x"), (5, "same text for all of us here", "en", "src1", 28, "x"), (5, "same text for all of us here", "en", "src1", 28, "x"), (6, "same text for all of us here", "en", None, 28, "y"),
        (7, "write to a@b.cd or 10.0.0.1", "fr", "src9", 27, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _gone string")
    for name in ("_features", "_score", "score", "row", "mark", "f", "h", "take", "_take", "length", "spans", "id", "component_id", "a.b"):
        docs = docs.withColumn(name, F.lit(1))
    for table_ in (docs, docs.limit(0)):
        now = table_
        for name, stage in cp.STAGES[:-1]:
            now = stored(stage(spark, now, sf_dir), name)
            assert now.columns == docs.columns and now.dtypes == docs.dtypes
        packed = cp.STAGES[-1][1](spark, now, sf_dir).collect()
        texts = [(r.doc_id, r.text) for r in now.collect()]
        assert sorted({r.doc_id for r in packed}, key=str) == sorted({d for d, _ in texts}, key=str)
        if table_ is docs:
            held = Counter(t for d, t in texts)
            assert {d for d, _ in texts} <= {None, 4, 5, 7} and not any(t is None or not t.strip() for t in held)
            assert all("a@b.cd" not in t and "10.0.0.1" not in t for t in held)
        else:
            assert packed == []
