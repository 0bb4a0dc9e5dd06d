"""Scores: language model against a plain count, toxicity on held-out labels, and their edges."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tickloom.llm import lm_score, toxicity
from tickloom.llm.common import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
def is_held():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2



def test_lm_base_and_better_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tokens = {r.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", r.text.translate(LOWER)), None] for r in docs.collect()}
    counts = Counter(w for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = lm_score.score(docs, is_held()).collect()
    for r in rows:
        ws = tokens[r.doc_id]
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_arcs_and_rest_sum_to_one():
    """After a history, arcs and backed-off words together have all the probability the vocabulary can get."""
    back = lm_score._backoff(np.array([0.6]), np.array([0.3]))
    total = 0.6 + 10 ** back[0] * (0.5 + 0.1 + 0.1)
    assert math.isclose(total, 1.0)


def plain_scores(texts, held):
    """Log probabilities of texts (lists of words) by a backoff model written plainly."""
    texts = {d: ["<s>", *ws, "</s>"] for d, ws in texts.items()}
    n = [Counter(), Counter(), Counter(), Counter()]
    for d, ws in texts.items():
        if d not in held:
            for k in (1, 2, 3):
                n[k].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    n[2], n[3] = ({g: c for g, c in n[k].items() if c >= 2} for k in (2, 3))
    scale = sum(n[1].values()) - n[1][("<s>",)] + len(n[1]) - 1 + 1
    after = {}
    for k in (2, 3):
        for g in n[k]:
            after.setdefault(g[:-1], []).append(g[-1])
    left = {}

    def p(h, w):
        if not h:
            return (n[1][(w,)] + 1) / scale
        if (*h, w) in n[len(h) + 1]:
            return (n[len(h) + 1][(*h, w)] - 0.5) / n[len(h)][h]
        if h not in after:
            return p(h[1:], w)
        if h not in left:
            left[h] = (1 - sum(p(h, x) for x in after[h])) / (1 - sum(p(h[1:], x) for x in after[h]))
        return p(h[1:], w) * left[h]

    return {d: sum(math.log10(p(tuple(ws[max(0, i - 2) : i]), ws[i])) for i in range(1, len(ws))) for d, ws in texts.items()}


def test_lm_score_over_the_table(spark, sf_dir, monkeypatch):
    """Every document's score against the plain model, with many chunks and shards."""
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 50_000)
    monkeypatch.setattr(lm_score.shards, "SHARD_KEYS", 20_000)
    docs = table(spark, sf_dir, "documents")
    texts = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text.translate(LOWER)) for r in docs.collect()}
    want = plain_scores(texts, {d for d in texts if zlib.crc32(str(d).encode()) % 7 == 2})
    got = {r.doc_id: r.score for r in lm_score.score(docs, is_held()).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[d], want[d], rel_tol=1e-5, abs_tol=1e-4) for d in want)


def test_lm_names_are_exact_and_short():
    """Different pairs of numbers have different names of as many bits as both, spread over all of them."""
    left, right = (x.ravel() for x in np.meshgrid(np.arange(64), np.arange(256), indexing="ij"))
    names = lm_score._named(left, right, (6, 8))
    assert len(np.unique(names)) == 64 * 256 and int(names.max()) < 1 << 14
    assert abs(np.bincount(names[left < 4] >> np.uint64(10), minlength=16) - 64).max() < 32
    far = np.random.default_rng(5).integers(0, 1 << 40, 2000)
    assert len(np.unique(lm_score._named(far, far[::-1], (40, 40)))) == 2000


def test_lm_moves_little(spark, sf_dir, monkeypatch):
    """Bytes of keys that the rounds ask for: at most six a token, also in small chunks."""
    moved, answered = [], lm_score.shards.answered

    def spied(asked, *args, **kwargs):
        moved.append(asked.agg(F.sum(F.octet_length("keys"))).first()[0])
        return answered(asked, *args, **kwargs)

    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 200_000)
    monkeypatch.setattr(lm_score.shards, "answered", spied)
    rows = lm_score.score(table(spark, sf_dir, "documents"), is_held()).collect()
    assert sum(moved) < 6 * sum(r.n_tokens for r in rows)


def test_lm_few_words_in_many_shards(spark, monkeypatch):
    """Names may be shorter than the bits that would name a shard."""
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 500)
    monkeypatch.setattr(lm_score.shards, "SHARD_KEYS", 10)
    words = np.array(["a", "b"])
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, " ".join(words[rng.integers(0, 2, 200)])) for i in range(20)], "doc_id long, text string")
    want = plain_scores({r.doc_id: r.text.split() for r in docs.collect()}, {4})
    got = {r.doc_id: r.score for r in lm_score.score(docs, F.col("doc_id") == 4).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[d], want[d], rel_tol=1e-6) for d in want)


def test_lm_keeps_every_repeated_arc(spark):
    """Pairs and triples that occur twice are arcs, however many tokens there are besides; a plain backoff model agrees."""
    filler = [(100 + i, " ".join(f"f{i}x{j}" for j in range(5000))) for i in range(100)]  # half a million words
    docs = spark.createDataFrame([(1, "red green blue"), (2, "red green blue"), (3, "Red green blue red"), (4, "blue green"), *filler], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_score.score(docs, F.col("doc_id") == 3).collect()}
    score = plain_scores({r.doc_id: r.text.lower().split() for r in docs.collect()}, {3})
    for d in (1, 2, 3, 4, 100):
        assert math.isclose(got[d].score, score[d], rel_tol=1e-6)
    assert got[3].score > got[3].base_score + 5


def test_lm_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "A a b " * 30_000, 3), (3, "x", 3), (None, "a", 4)], "doc_id long, text string, score int")
    rows = lm_score.score(docs, F.lit(False)).collect()
    assert len(rows) == 5 and sorted(r.n_tokens for r in rows) == [1, 1, 2, 2, 90_001]
    assert all(math.isfinite(r.score) for r in rows)
    assert lm_score.score(docs.limit(0), F.lit(False)).count() == 0
    assert {r.n_known for r in lm_score.score(docs, F.lit(True)).collect()} == {0}


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    rows = toxicity.score(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    wins = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert wins > 0.85
    assert abs(np.mean(bad + good) - len(bad) / (len(bad) + len(good))) < 0.1  # calibrated: the mean score is near the share


def test_toxicity_features_against_plain_counts(spark, sf_dir):
    lexicon = {"idiot": 3.0, "scum": 2.0, "stup*": 1.5, "stupid*": 2.5, "lorem": 0.0}
    texts = [r.text for r in table(spark, sf_dir, "documents").limit(40).collect()] + ["", None, "You IDIOT!!! st0pid sc*m you stupidest scumm, iiiidiot?", "éÉ ß 1d1ot", "a " * 2000 + "idiot"]
    weights = toxicity.Weights(lexicon)
    for text in texts:
        low = (text or "").lower()
        words = re.findall(r"[^\W\d_]+", low)

        def weight(w):
            starts = [v for k, v in lexicon.items() if k.endswith("*") and len(w) > len(k) - 1 and w.startswith(k[:-1])]
            return max([lexicon.get(w, 0.0), *starts])

        hits = [i for i, w in enumerate(words) if weight(w) > 0]
        near = sum(any(w in toxicity.SECOND_PERSON for w in words[max(0, i - 5) : i + 6]) for i in hits)
        n = max(1, len(words))
        upper, letters = sum("A" <= c <= "Z" for c in text or ""), max(1, sum(c.isascii() and c.isalpha() for c in text or ""))
        got = dict(zip(toxicity.NAMES, toxicity.features_of(text, weights), strict=True))
        want = {
            "log_words": math.log1p(len(words)), "density": len(hits) / n, "log_hits": math.log1p(len(hits)), "weight": math.log1p(sum(weight(words[i]) for i in hits)), "top_weight": max([weight(words[i]) for i in hits], default=0.0),
            "distinct": math.log1p(len({words[i] for i in hits})), "near_second": near / max(1, len(hits)), "capitals": upper / letters, "shouting": sum(c in "!?" for c in text or "") / n,
            "punctuation": sum(c.isascii() and 32 < ord(c) < 127 and not c.isalnum() for c in text or "") / n - sum(c in "{|}~" for c in text or "") / n,
        }
        assert all(math.isclose(got[k], v, abs_tol=1e-9) for k, v in want.items()), (text, got, want)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "you are a stupid idiot", 1.0), (4, "word " * 50_000, 1.0), (None, "fine", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(rows) == 5 and rows[3].predicted == 1 and rows[4].predicted == 0 and rows[1].score == rows[2].score == 0.0
    clash = docs.withColumns({"_features": F.lit(1), "_raw": F.lit("x"), "row": F.lit(2), "a.b": F.lit(3)})
    assert toxicity.without_toxic(clash, labels).columns == clash.columns and toxicity.without_toxic(clash, labels).count() == 4
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 4
    assert toxicity.score(docs.limit(0), labels).count() == 0
    weights = toxicity.Weights({"lowei*": 2.0, "scum": 1.0})
    assert weights["loweiung"] == 2.0 and weights["scum"] == 1.0 and weights["scump"] == 0.0
