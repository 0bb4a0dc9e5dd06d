"""Shingle groups of documents and repeated paragraphs against brute force."""

import itertools
import random
import re
from collections import Counter

import pytest

from tickloom.llm import common, ngram_join, substring_dedup
from tickloom.llm.common import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def brute(sets):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(k for k in sets if sets[k]), 2):
        x, y = sets[a], sets[b]
        if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
            n = len(x & y)
            if 100 * n >= 80 * (len(x) + len(y) - n):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: find(k) for k in sets}


def test_common_shingles_whatever_the_batches(spark):
    texts = [f"these are the words of every text and {i}" for i in range(20)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = Counter(h for s in ngram_join.shingle_sets(texts) for h in s.tolist())
    want = sorted(h for h, n in want.items() if n >= ngram_join.COMMON)
    assert want and ngram_join.common_shingles(docs).tolist() == want
    with common.one_a_batch(spark):
        assert ngram_join.common_shingles(docs).tolist() == want
        assert not len(ngram_join.common_shingles(docs.filter("text IS NULL"))) and not len(ngram_join.common_shingles(docs.limit(0)))


def test_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    got = ngram_join.groups(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(sets)
    assert all(r.n_shingles == len(sets[r.doc_id]) for r in got)


@pytest.mark.parametrize(("paired", "large"), [(32, 16_384), (2, 16_384), (2, 4)])
def test_groups_by_pairs_blocks_and_rounds(spark, monkeypatch, paired, large):
    """Copies that differ by about the threshold, and texts that share one passage: the same groups whichever way they meet."""
    monkeypatch.setattr(ngram_join, "PAIRED", paired)
    monkeypatch.setattr(ngram_join, "LARGE", large)
    rng = random.Random(7)
    texts = []
    for base in range(3):
        words = [f"b{base}w{i}" for i in range(80)]
        for _ in range(50):
            own = words[: rng.randrange(60, 81)]
            for at in rng.sample(range(len(own)), rng.randrange(0, 6)):
                own[at] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(own))
    passage = [f"p{i}" for i in range(9)]
    texts += [" ".join([*passage, *(f"o{d}w{i}" for i in range(12))]) for d in range(60)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute({i: shingles(t) for i, t in enumerate(texts)})
    assert {r.doc_id: r.component_id for r in ngram_join.groups(docs).collect()} == want
    assert len(set(want.values())) > 61 and max(Counter(want.values()).values()) > 10


def test_a_word_hashes_alike_wherever_it_stands(spark):
    for n in (common._LONG, common._LONG + 1, common._CHUNK, common._CHUNK + 1):
        rows = [(1, "z" * n), (2, "Z" * n + " "), (3, "z" * n + "z")]
        got = {r.doc_id: r.component_id for r in ngram_join.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {1: 1, 2: 1, 3: 3}


def test_keep_one_judges_each_text_of_an_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    docs = spark.createDataFrame([(1, a, "x"), (2, a, "x"), (2, b, "x"), (3, b, "x"), (2, b, "x")], "doc_id long, text string, `f.x` string")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text[0]) for r in kept.collect()) == [(1, "a"), (2, "b"), (2, "b")]


def test_group_edges(spark):
    base = [f"w{i}" for i in range(60)]
    near = [*base[:30], "x", *base[31:]]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (6, " ".join(base)), (7, " ".join(base)), (8, " ".join(near)), (9, "l " * 60_000), (None, "one two"), (6, " ".join(base))]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int")
    got = ngram_join.groups(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.component_id for r in got}
    assert by == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 9, None: None}
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 6, 9]
    assert ngram_join.groups(docs.limit(0)).count() == 0


def test_repeated_paragraphs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sets = {(r.doc_id, i): shingles(line) for r in docs.collect() for i, line in enumerate(r.text.split("\n")) if len(re.findall(r"[^\x20\x09-\x0D]+", line)) >= 20}
    groups = {}
    for k, c in brute(sets).items():
        groups.setdefault(c, []).append(k)
    true = {k: c for c, m in groups.items() if len({d for d, _ in m}) > 1 for k in m}
    rows = substring_dedup.repeated(docs).collect()
    got = {(r.doc_id, r.paragraph): (r.cluster_doc, r.cluster_paragraph) for r in rows}
    assert len(set(true) - set(got)) <= 0.01 * len(true) and all(true.get(k) == c for k, c in got.items())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[r.doc_id][r.start : r.end] == texts[r.doc_id].split("\n")[r.paragraph] for r in rows)


def test_repeated_edges(spark):
    line = " ".join(f"w{i}" for i in range(55))
    rows = [(1, None), (2, ""), (3, f"a b\n{line}\nz"), (4, f"{line}\nq"), (5, line.upper()), (6, "short\nshort"), (None, line)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, start int")
    got = {(r.doc_id, r.paragraph): r.removed for r in substring_dedup.repeated(docs).collect()}
    assert got == {(3, 1): False, (4, 0): True, (5, 0): True}
    clean = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs).collect()}
    assert clean[4] == "q" and clean[3] == rows[2][1] and clean[1] is None
    assert substring_dedup.repeated(docs.limit(0)).count() == 0


def test_passages_across_line_breaks(spark):
    """Every word in a run of 50 that another document has too is found, whatever lines it stands in, and nothing else is."""
    run = [f"r{i}" for i in range(54)]
    own = lambda d, n: [f"d{d}x{i}" for i in range(n)]
    texts = {
        39: " ".join(own(39, 30) + run[:15]) + "\n" + " ".join(run[15:26]) + "\n" + " ".join(run[26:] + own(38, 20)),  # across lines, of 15 and 11 words of it
        900: "é " + " ".join(own(900, 200) + run + own(901, 300)),  # inside one long line
        901: " ".join(x.upper() + "\n" for x in run[:50]),  # lines of a word
        902: " ".join(own(902, 40) + run[:49] + own(903, 40)),  # one word too few
        903: " ".join(own(904, 60) * 2),  # repeats itself alone
        904: None,
    }
    docs = spark.createDataFrame([*texts.items(), (None, texts[900])], "doc_id long, text string")
    rows = substring_dedup.passages(docs).collect()
    got = {r.doc_id: (texts[r.doc_id][r.start : r.end].lower().split(), r.n_words, r.cluster_doc, r.removed) for r in rows}
    assert len(rows) == 3 and got == {39: (run, 54, 39, False), 900: (run, 54, 39, True), 901: (run[:50], 50, 39, True)}
    assert {r.doc_id for r in substring_dedup.found(docs).collect()} == {39, 900, 901}
    clean = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs).collect() if r.doc_id}
    assert clean[39] == texts[39] and clean[901].split() == [] and clean[900].split() == ["é", *own(900, 200), *own(901, 300)]
    assert substring_dedup.passages(docs.limit(0)).count() == 0


def test_passages_against_every_run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = {r.doc_id: [(m.group().translate(LOWER), m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", r.text)] for r in docs.collect()}
    holders = {}
    for d, ws in words.items():
        for i in range(len(ws) - 49):
            holders.setdefault(tuple(w for w, _, _ in ws[i : i + 50]), set()).add(d)
    true = {(d, i + j) for d, ws in words.items() for i in range(len(ws) - 49) if len(holders[tuple(w for w, _, _ in ws[i : i + 50])]) > 1 for j in range(50)}
    got = {(r.doc_id, i) for r in substring_dedup.passages(docs).collect() for i, (_, a, b) in enumerate(words[r.doc_id]) if r.start <= a and b <= r.end}
    assert true and got == true
