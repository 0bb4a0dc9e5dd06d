from pyspark.sql import functions as F

from tickloom.llm import mixing
from tickloom.llm.common import table


def budgets(spark, leaves, total, epochs, weights=None):
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    w = {k: F.lit(1).cast("long") for k in mixing.LEVELS} | (weights or {})
    return {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(df, w, F.lit(total), epochs).collect()}


def test_shortage_goes_to_siblings_first(spark):
    leaves = [("a", "en", "s1", 10), ("a", "en", "s2", 100), ("b", "en", "s3", 200)]
    assert budgets(spark, leaves, 100, 1) == {("a", "en", "s1"): 10, ("a", "en", "s2"): 40, ("b", "en", "s3"): 50}
    assert budgets(spark, leaves, 240, 1) == {("a", "en", "s1"): 10, ("a", "en", "s2"): 100, ("b", "en", "s3"): 130}
    assert sum(budgets(spark, leaves, 10_000, 2).values()) == 620
    heavy = mixing.weight_of("domain", {"a": 3}, 1)
    assert budgets(spark, leaves, 101, 1, {"domain": heavy})[("b", "en", "s3")] in (25, 26)


def test_prefixes_and_epochs(spark, sf_dir):
    rows = mixing.mix(table(spark, sf_dir, "documents")).collect()
    assert len({(r.doc_id, r.epoch) for r in rows}) == len(rows)
    cut = [r for r in rows if r["take"] < r.n_tokens]
    assert len(cut) <= len({(r.domain, r.lang, r.source) for r in rows})
    assert all(0 < r["take"] <= r.n_tokens for r in rows)


def test_edges(spark):
    rows = [(1, None, "en", "src1"), (2, "", None, None), (3, "a b  c", None, None), (3, "a b  c", None, None), (4, "w " * 60_000, "de", "x9"), (None, "q r", "en", "src1")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, take int")
    got = mixing.mix(docs).collect()
    assert sum(r["take"] for r in got) == (3 + 3 + 60_000 + 2) * 3 // 4
    out = mixing.mixture(docs, (1, 1), 1)
    assert out.columns == docs.columns and sorted((r.doc_id or 0, r.text[:3]) for r in out.collect()) == [(0, "q r"), (3, "a b"), (3, "a b"), (4, "w w")]
    assert mixing.mix(docs.limit(0)).count() == 0
    assert docs.filter("doc_id = 3").select(mixing.prefix_of(F.col("text"), F.lit(2)).alias("p")).first().p == "a b"


def test_rows_that_share_an_id_are_taken_one_by_one(spark):
    """What comes out holds the tokens that mix() takes, row by row, whatever ids and columns are called."""
    rows = [(1, f"t{i} " * (i + 1), "en", "src1", None, {"k": i}) for i in range(20)] + [(None, "n " * 30, "en", "src1", 5, {}), (None, "m " * 30, "en", "src1", 5, {}), (7, "r r r", "en", "src1", 1, {}), (7, "r r r", "en", "src1", 1, {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `_take.x` int, mark map<string,int>")
    total = sum(len(r[1].split()) for r in rows)
    for share, epochs in (((3, 4), 1), ((1, 1), 1), ((3, 2), 2)):
        out = mixing.mixture(docs, share, epochs)
        got = [r.text.split() for r in out.collect()]
        assert out.columns == docs.columns and sum(map(len, got)) == total * share[0] // share[1]
        assert sum(len(set(g)) != 1 for g in got) == 0
        if share == (1, 1):
            assert sorted(map(len, got)) == sorted(len(r[1].split()) for r in rows)
