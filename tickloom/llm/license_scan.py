"""Licence scans with a positional index of rare words, in DataFrame functions alone.

A template is a run of words with a mandatory key phrase. Of a file's words the licence words of highest IDF (over all documents)
are looked up: every key word must stand in a file that matches, so the rarest of a template's key words is the rarest that any
file can offer it. Each of its places proposes a start for the template; the key phrase must stand there word by word; then the
postings of the template's rare words are intersected at their relative positions, straight from the word list. No rows are
multiplied and no text is shuffled; only document counts of the template words (a fixed list) are gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import lower_ascii

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rare words of a template that are compared by position, and the share of them that must stand there.
RARE, LEAST = 4, 0.5


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[int, int]
    base: bool


def _template(label: str, text: str, key: str = "", base: bool = False) -> Template:
    words, phrase = tuple(text.split()), tuple((key or text).split())
    at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
    return Template(label, words, (at, at + len(phrase)), base)


#: Labels, template words and mandatory phrases. The first three are the contract's base phrases.
TEMPLATES = (
    _template("mit", "mit license", base=True),
    _template("apache", "apache license", base=True),
    _template("gpl", "general public license", base=True),
    _template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    _template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    _template("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    _template("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    _template("lgpl", "gnu lesser general public license", "lesser general public license"),
    _template("agpl", "gnu affero general public license", "affero general public license"),
    _template("mpl", "mozilla public license"),
    _template("epl", "eclipse public license"),
    _template("bsd", "bsd license"),
    _template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    _template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee"),
    _template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    _template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    _template("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    _template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    _template("proprietary", "all rights reserved"),
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(f"({WORD})"), F.lit(1))


def document_counts(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """In how many documents each template word stands; at most as many rows as the templates have words."""
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for t in templates for w in t.words})])
    seen = docs.select(F.explode(F.array_intersect(vocabulary, words_of(F.col("text")))).alias("word"))
    return {r["word"]: r["count"] for r in seen.groupBy("word").count().collect()}


def _anchor(t: Template, counts: dict[str, int]) -> int:
    """The place of the rarest word of the key phrase; the first of equals."""
    return min(range(*t.key), key=lambda i: (counts.get(t.words[i], 0), i))


def _places(t: Template, counts: dict[str, int]) -> Column:
    """array<struct<label, base, at, aligned>> of one template in _words, from the anchor's places in _hits."""
    lo, hi = t.key
    anchor = _anchor(t, counts)
    rare = sorted(range(len(t.words)), key=lambda i: (counts.get(t.words[i], 0), i))[:RARE]
    key = F.array(*[F.lit(w) for w in t.words[lo:hi]])

    def aligned(start: Column) -> Column:
        same = [F.coalesce(F.get("_words", start + i) == F.lit(t.words[i]), F.lit(False)).cast("int") for i in rare]
        return sum(same[1:], same[0]) / F.lit(float(len(rare)))

    starts = F.transform(F.filter("_hits", lambda h: h["word"] == t.words[anchor]), lambda h: h["at"] - anchor)
    starts = F.filter(starts, lambda s: (s + lo >= 0) & (F.slice("_words", s + lo + 1, hi - lo) == key))
    found = F.transform(starts, lambda s: F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), s.alias("at"), aligned(s).alias("aligned")))
    return F.filter(found, lambda x: x["base"] | (x["aligned"] >= LEAST))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null text counts as empty: no words, null places, empty labels, score 0. Repeated rows give repeated results; an empty
    table gives none; columns other than doc_id and text are not read. Texts are scanned whole.
    """
    counts = document_counts(docs, templates)
    anchors = sorted({t.words[_anchor(t, counts)] for t in templates})
    numbered = F.transform("_words", lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    hits = F.when(F.arrays_overlap("_words", F.array(*map(F.lit, anchors))), F.filter(numbered, lambda h: h["word"].isin(anchors)))
    found = F.when(F.col("_hits").isNotNull(), F.concat(*[_places(t, counts) for t in templates]))
    base = F.filter("_found", lambda x: x["base"])
    at = F.transform(base, lambda x: x["at"].cast("long"))
    labels = lambda xs: F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda x: x["label"]))), ","), F.lit(""))
    return (
        docs.select("doc_id", words_of(F.col("text")).alias("_words"))
        .withColumn("_hits", hits)
        .select("doc_id", F.size("_words").cast("long").alias("n_words"), found.alias("_found"))
        .select(
            "doc_id", "n_words",
            F.coalesce(F.size(base), F.lit(0)).cast("long").alias("n_base"),
            F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
            labels(base).alias("base_labels"), labels(F.col("_found")).alias("labels"),
            F.coalesce(F.array_max(F.transform("_found", lambda x: x["aligned"])), F.lit(0.0)).alias("score"),
        )
    )


def sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The same result in DuckDB SQL, by joins of exploded words."""
    rows = ", ".join(f"({k}, '{t.label}', {t.base}, {i}, '{w}', {t.key[0] <= i < t.key[1]})" for k, t in enumerate(templates) for i, w in enumerate(t.words))
    return rf"""
WITH template(t, label, base, pos, word, in_key) AS (VALUES {rows}),
listed AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM listed),
df AS (SELECT word, count(DISTINCT doc_id) AS n FROM word WHERE word IN (SELECT word FROM template) GROUP BY word),
ranked AS (SELECT p.*, row_number() OVER (PARTITION BY t ORDER BY coalesce(n, 0), pos) AS r FROM template p LEFT JOIN df USING (word)),
size AS (SELECT t, any_value(label) AS label, any_value(base) AS base, count(*) FILTER (in_key) AS keys, least({RARE}, count(*)) AS rares FROM template GROUP BY t),
place AS (SELECT doc_id, t, i - pos AS start FROM word JOIN template USING (word) JOIN size USING (t) WHERE in_key GROUP BY doc_id, t, i - pos, keys HAVING count(*) = keys),
scored AS (SELECT p.doc_id, p.t, p.start, count(w.word)::DOUBLE / any_value(s.rares)::DOUBLE AS aligned
           FROM place p JOIN size s USING (t) JOIN ranked k ON k.t = p.t AND k.r <= {RARE}
           LEFT JOIN word w ON w.doc_id = p.doc_id AND w.i = p.start + k.pos AND w.word = k.word GROUP BY ALL),
kept AS (SELECT x.*, label, base FROM scored x JOIN size USING (t) WHERE base OR aligned >= {LEAST}),
total AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
                 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(aligned) AS score
          FROM kept GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM listed LEFT JOIN total USING (doc_id)
"""
