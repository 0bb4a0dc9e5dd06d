"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Labelled training rows are dealt by a hash of their id into three parts: one finds the lexicon (words and word beginnings that
toxic documents use far more often), one grows the trees, one calibrates. So no part judges rows that shaped its inputs.
Fitting may use a bounded sample of labelled rows (`most_rows`); every document is scored over its whole text.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import stored

#: Insults that need no learning, and second-person words of the corpus' languages.
SEEDS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "clown", "pathetic", "worthless", "disgusting")
SECOND_PERSON = ("you", "your", "youre", "u", "du", "dich", "dir", "dein", "ihr", "tu", "te", "toi", "vous", "votre", "usted", "ustedes", "ti", "tus")
PREFIXES = (4, 5, 6)
NEAR = 5
#: Digits and signs that stand for letters in disguised words.
LEET = str.maketrans("013457@$!|", "oieastasil")
NAMES = ("log_words", "density", "log_hits", "weight", "top_weight", "distinct", "near_second", "capitals", "shouting", "punctuation", "obfuscated", "disguised_hits", "stretched")
_WORDS = re.compile(r"[^\W\d_]+").findall
_OBFUSCATED = re.compile(r"(?<![^\s(\"'])[^\W\d_]+[0-9@$!|*]+[^\W\d_][^\W_]*").findall
_STRETCHED = re.compile(r"([^\W\d_])\1{3,}").findall


class Weights(dict):
    """Word to the weight of its longest lexicon entry (the word itself or a beginning of it), kept for words seen."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        found = self.lexicon.get(word, 0.0)
        for n in PREFIXES:
            if len(word) > n:
                found = max(found, self.lexicon.get(word[:n] + "*", 0.0))
        if len(self) > 500_000:
            self.clear()
        self[word] = found
        return found


def features_of(text: str | None, weights: Weights) -> list[float]:
    """The dense features of one whole text; all zero for a null or empty one."""
    if not text:
        return [0.0] * len(NAMES)
    words = _WORDS(text.lower())
    n = max(1, len(words))
    found = np.fromiter(map(weights.__getitem__, words), float, len(words))
    hits = np.flatnonzero(found)
    near = 0
    for i in hits:
        near += any(w in _SECOND for w in words[max(0, i - NEAR) : i + NEAR + 1])
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    letters = max(1, int(raw[65:91].sum() + raw[97:123].sum()))
    marks = raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum()
    signs = int(raw[48:58].sum() + raw[64] + raw[36] + raw[42] + raw[124] + raw[33])
    disguised = _OBFUSCATED(text.lower()) if signs else []
    return [
        math.log1p(len(words)), len(hits) / n, math.log1p(len(hits)), math.log1p(float(found.sum())), float(found.max(initial=0)),
        math.log1p(len({words[i] for i in hits})), near / max(1, len(hits)), float(raw[65:91].sum()) / letters,
        float(raw[33] + raw[63]) / n, float(marks) / n, len(disguised) / n,
        math.log1p(sum(weights[w.translate(LEET).replace("*", "")] > 0 for w in disguised)), len(_STRETCHED(text)) / n,
    ]


_SECOND = frozenset(SECOND_PERSON)


def features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """docs, which have a column text, with the array column _features."""
    kept: dict[str, Weights] = {}

    @F.pandas_udf("array<double>")
    def scan(texts: pd.Series) -> pd.Series:
        weights = kept.setdefault("weights", Weights(lexicon))
        return pd.Series([features_of(t, weights) for t in texts])

    return docs.withColumn("_features", scan("text"))


def remainder(doc_id: Column, by: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def find_lexicon(texts: DataFrame, most: int = 400) -> dict[str, float]:
    """Words and beginnings (marked *) of texts (text, toxic) that toxic texts use at least ten times as often: log ratios.

    At most `most` entries, the strongest first; equal ones by name.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))
    heads = [F.transform(_longer(words, n), _head(n)) for n in PREFIXES]
    seen = texts.select("toxic", F.explode(F.array_distinct(F.concat(words, *heads))).alias("token"))
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    least = max(3, bad // 200)
    counted = seen.groupBy("token").agg(F.sum(F.col("toxic").cast("long")).alias("bad"), F.sum(1 - F.col("toxic").cast("long")).alias("good"))
    ratio = F.log(((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("good") + 0.5) / (good + 1)))
    top = counted.filter(F.col("bad") >= least).withColumn("ratio", ratio).filter(F.col("ratio") >= math.log(10)).orderBy(F.desc(F.col("ratio") * F.sqrt("bad")), "token").limit(most)
    found = {r["token"]: float(r["ratio"]) for r in top.collect()}
    return dict.fromkeys(SEEDS, 3.0) | found


def _longer(words: Column, n: int) -> Column:
    return F.filter(words, lambda w: F.length(w) > n)


def _head(n: int):
    return lambda w: F.concat(F.substring(w, 1, n), F.lit("*"))


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: object | None
    calibration: object | None

    def score(self, docs: DataFrame) -> DataFrame:
        """(row, score): each row of docs as one struct, so that no name of its columns matters here."""
        rows = features(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), self.lexicon).drop("text")
        if self.trees is None:  # too few labels of one kind to learn from: the lexicon alone
            return rows.select("row", F.least(F.lit(1.0), F.expm1(F.col("_features")[2]) * 0.3).alias("score"))
        out = self.trees.transform(rows.withColumn("_vector", array_to_vector("_features")))
        out = out.withColumn("_margin", vector_to_array("_raw")[1])
        level = fine = 1 / (1 + F.exp(-2 * F.col("_margin")))
        if self.calibration is not None:
            out = self.calibration.transform(out)
            level = 0.999 * F.col("_level") + 0.001 * fine  # keeps the trees' order where the isotonic steps are flat
        return out.select("row", F.least(F.lit(1.0), F.greatest(F.lit(0.0), level)).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, most_rows: int = 30_000) -> Model:
    """Learn from labelled rows whose crc32 of the id is not 0 modulo `folds`.

    Where there are more than `most_rows` of them, the ones with the smallest hashes: a bounded sample, documented here.
    """
    named = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), folds) != 0))
    chosen = named.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("_hash", F.xxhash64("doc_id", F.lit(7)))
    chosen = chosen.orderBy("_hash", "doc_id").limit(most_rows)
    part = F.pmod(F.shiftright("_hash", 8), F.lit(10))
    # At most `most_rows` rows of three numbers: a proven bound for the broadcast.
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(chosen.withColumn("_part", part).drop("_hash")), "doc_id"), "labelled")
    lexicon = find_lexicon(rows.filter("_part < 4"))
    known = stored(features(rows.filter("_part >= 4"), lexicon).drop("text"), "features").coalesce(4)
    grow, settle = known.filter("_part < 8"), known.filter("_part >= 8")
    counts = {r["toxic"]: r["count"] for r in grow.groupBy("toxic").count().collect()}
    if min(counts.get(0, 0), counts.get(1, 0)) < 5:
        return Model(lexicon, None, None)
    vector = lambda df: df.select(array_to_vector("_features").alias("_vector"), F.col("toxic").cast("double").alias("label"))
    trees = GBTClassifier(featuresCol="_vector", labelCol="label", maxIter=20, maxDepth=3, stepSize=0.2, seed=7, maxBins=64, predictionCol="_prediction")
    trees = trees.setRawPredictionCol("_raw").setProbabilityCol("_probability").fit(vector(grow))
    counts = {r["toxic"]: r["count"] for r in settle.groupBy("toxic").count().collect()}
    if min(counts.get(0, 0), counts.get(1, 0)) < 20:
        return Model(lexicon, trees, None)
    margins = trees.transform(vector(settle)).select(vector_to_array("_raw")[1].alias("_margin"), "label")
    calibration = IsotonicRegression(featuresCol="_margin", labelCol="label", predictionCol="_level").fit(margins)
    return Model(lexicon, trees, calibration)


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, most_rows: int = 30_000, at: float = 0.5) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.

    Null and empty texts have all features zero and get a score like any other. Null ids are scored and count as held out.
    Repeated rows give equal rows; an empty documents table gives none; without labels of both kinds the lexicon alone scores.
    Columns other than doc_id, text and toxic are not read.
    """
    scored = fit(docs, labels, folds, most_rows).score(docs.select("doc_id", "text"))
    doc_id = F.col("row.doc_id")
    held = F.coalesce(remainder(doc_id, folds) == 0, F.lit(True))
    return scored.select(doc_id.alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5, most_rows: int = 30_000, at: float = 0.5) -> DataFrame:
    """The rows of docs that score below `at`; same columns, whatever their names.

    Null and empty texts score like any text without a sign of toxicity; rows without doc_id are judged and never learned from;
    repeated rows go or stay together; texts are read whole; an empty table stays empty.
    """
    return fit(docs, labels, folds, most_rows).score(docs).filter(F.col("score") < at).select("row.*")
