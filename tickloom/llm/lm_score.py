"""Language-model scores by weighted backoff over words.

Every training word, begin and end of a text is counted over all training documents. Pairs and triples that occur twice or more
are arcs, at every corpus size. A missing arc follows the failure arc to the shorter history, at the history's backoff weight;
the last history has every word. The model is never held in one place: texts are cut into chunks, and each chunk asks the
shards of the key space. First it sends its words, for their counts and numbers; then its pairs of words that occur twice, named
by the numbers of their words; then its triples of pairs that are arcs, named by the numbers of pair and word, along with the
sums behind the backoff weights of words; then those of pairs. So a gram moves once, under an exact name that is no longer than the
vocabulary asks, and no triple moves whose pairs rule it out. A text's score is the sum over its places of the longest arc there,
or of what the failure arcs from it weigh. Of the chunks that hold an arc, one adds it to its history.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm import shards
from tickloom.llm.common import discard, hash_words, mix64, one_a_batch, real_id, safe_id, stored, stored_by, utf8

#: Occurrences that make a pair or triple an arc, at every size.
LEAST = 2
#: Taken off each arc's count and given to the failure arc.
DISCOUNT = 0.5
#: Bytes of text that close a chunk. Each chunk writes a row for every shard, so small chunks cost rows as the square of the input.
CHUNK_BYTES = 6_000_000
#: Places for each pair or triple that reaches a shard, about: a chunk sends what it repeats once, and what cannot be an arc never.
PLACES_A_KEY = 2
_BEGIN, _END = np.uint64(0x5BE6137A0C4D92F1), np.uint64(0xE4D1A2B39C587F06)
_FACTORS = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA24BAED4963EE407)


def _chunks(rows: DataFrame) -> DataFrame:
    """Documents in bounded chunks: ids, which are held out, where each starts, the distinct words' hashes and times they are learned from, the words' places there."""

    def chunk(docs: list[tuple]) -> tuple:
        raws = [utf8(t) for _, t, _ in docs]
        gap = np.array([32], np.uint8)
        words, at, _ = hash_words(np.concatenate([x for raw in raws for x in (raw, gap)]))
        first = np.searchsorted(at, np.cumsum([0, *(len(raw) + 1 for raw in raws)]))
        starts = first[:-1] + 2 * np.arange(len(docs))
        flat = np.empty(len(words) + 2 * len(docs), np.uint64)
        edge = np.zeros(len(flat), bool)
        ends = np.append(starts[1:], len(flat)) - 1
        flat[starts], flat[ends] = _BEGIN, _END
        edge[starts] = edge[ends] = True
        flat[~edge] = words
        del words, at
        known, codes = np.unique(flat, return_inverse=True)
        held = np.array([h for _, _, h in docs])
        train = int(((ends - starts) * ~held).sum())
        counts = np.bincount(codes[np.repeat(~held, ends - starts + 1)], minlength=len(known)).astype("uint64")
        codes = codes.astype("uint16" if len(known) <= 1 << 16 else "uint32")
        return np.array([d for d, _, _ in docs], "int64").tobytes(), held.tobytes(), starts.astype("int64").tobytes(), shards.packed(known), shards.planes(counts), len(known), shards.planes(codes), len(flat), train, int((~held).sum())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, size = [], 0
        for batch in batches:
            for row in zip(batch["doc_id"], batch["text"], batch["held_out"], strict=True):
                own.append(row)
                size += len(row[1] or "") + 1
                if size >= CHUNK_BYTES:
                    yield pd.DataFrame([chunk(own)], columns=_COLUMNS)
                    own, size = [], 0
        if own:
            yield pd.DataFrame([chunk(own)], columns=_COLUMNS)

    return rows.mapInPandas(run, "ids binary, held binary, starts binary, words binary, counts binary, n_words long, codes binary, places long, train long, n_docs long").withColumn("chunk", F.monotonically_increasing_id())


_REQUEST = ["n", "shard", "chunk", "keys", "numbers"]
_COLUMNS = ["ids", "held", "starts", "words", "counts", "n_words", "codes", "places", "train", "n_docs"]


def _named(left: np.ndarray, right: np.ndarray, bits: tuple[int, int]) -> np.ndarray:
    """One number for each two of so many bits, spread evenly over as many bits as both have; beyond 64 bits, their hash."""
    width = sum(bits)
    left, right = left.view("uint64"), right.view("uint64")
    with np.errstate(over="ignore"):
        if width > 64:
            return mix64(mix64(left * _FACTORS[0]) + right)
        x, most, half = left << np.uint64(bits[1]), np.uint64((1 << width) - 1), np.uint64((width + 1) // 2)
        x |= right
        for factor in _FACTORS:  # each step can be undone, so different numbers stay different
            x *= factor
            x &= most
            x ^= x >> half
    return x


class _Chunk:
    """A chunk's places, its distinct words (1), pairs (2) and triples (3), and where each place's gram is among them.

    Grams that are known to occur once are left out: at[k] is -1 there. `name` has the number of each word and pair that may be
    the history of an arc, -1 for others, and -1 again at its end for no gram. Twice the count less the discount is a whole
    number, so sums over arcs are exact wherever they are made.
    """

    def __init__(self, row):
        self.ids, self.held, self.starts = np.frombuffer(row.ids, "int64"), np.frombuffer(row.held, bool), np.frombuffer(row.starts, "int64")
        one = shards.unplanes(row.codes, "uint16" if row.n_words <= 1 << 16 else "uint32").astype("int32")
        self.n = len(one)
        self.begin = np.zeros(self.n, bool)
        self.begin[self.starts] = True
        self.at, self.keys, self.place, self.count, self.owned, self.name, self.p = {1: one}, {}, {}, {}, {}, {}, {}
        self.twice, self.history, self.last = {}, {}, {}
        self.whole = {2: ~self.begin, 3: ~self.begin & np.concatenate([[False], ~self.begin[:-1]])}

    def counts(self, k: int) -> np.ndarray:
        """Times that each distinct gram occurs in documents that are learned from."""
        train = np.repeat(~self.held, np.diff(np.append(self.starts, self.n))) & (self.at[k] >= 0)
        return np.bincount(self.at[k][train], minlength=len(self.keys[k])).astype("uint64")

    def words(self, answers, bits: int, scale: int) -> None:
        """Takes the words' counts and numbers."""
        self.scale = scale
        self.count[1] = shards.numbers_of(answers, 1, 0, "uint64").astype("float64")
        self.name[1] = np.append(np.where(self.count[1] >= LEAST, shards.ranks_of(answers, 1, 1, bits), -1), -1)
        self.p[1] = (self.count[1] + 1) / scale

    def grams(self, k: int, bits: tuple[int, int]) -> None:
        """Finds the distinct grams of order k whose shorter grams occur twice."""
        repeated = (self.name[k - 1] >= 0)[self.at[k - 1]]
        places = np.flatnonzero(repeated[:-1] & repeated[1:] & self.whole[k][1:]) + 1
        names = _named(self.name[k - 1][self.at[k - 1][places - 1]], self.name[1][self.at[1][places]], bits)
        order = np.argsort(names)
        names, places = names[order], places[order]
        new = np.ones(len(names), bool)
        new[1:] = names[1:] != names[:-1]
        self.keys[k], self.place[k] = names[new], places[new]
        self.at[k] = np.full(self.n, -1, "int32")
        self.at[k][places] = np.cumsum(new, dtype="int32") - 1

    def arcs(self, k: int, answers, bits: int = 0) -> None:
        """Takes the whole counts of the grams of order k, and keeps those that are arcs."""
        x = shards.numbers_of(answers, k, 0, "uint64")
        kept = x > 0
        self.at[k] = np.append(np.where(kept, np.cumsum(kept) - 1, -1), -1).astype("int32")[self.at[k]]
        self.place[k], x = self.place[k][kept], x[kept]
        self.count[k], self.owned[k] = (x >> np.uint64(1)).astype("float64"), (x & np.uint64(1)).astype(bool)
        if k == 2:
            self.name[2] = np.append(shards.ranks_of(answers, 2, 1, bits)[kept], -1)
        self.twice[k] = 2 * self.count[k] - 2 * DISCOUNT
        self.history[k], self.last[k] = self.at[k - 1][self.place[k] - 1], self.at[k - 1][self.place[k]]
        self.p[k] = self.twice[k] / 2 / self.count[k - 1][self.history[k]]

    def asked(self, k: int) -> np.ndarray:
        """Grams that may be histories of arcs."""
        return np.flatnonzero(self.name[k][:-1] >= 0)

    def sums(self, k: int) -> list[np.ndarray]:
        """Names of the histories of order k - 1, and over the arcs of order k that this chunk owns: twice their discounted counts,
        and the numerators of the lower order's probabilities of their words."""
        at, own = self.asked(k - 1), self.owned[k]
        lower = self.count[1] + 1 if k == 2 else self.twice[2]
        n = len(self.count[k - 1])
        return [self.name[k - 1][at].astype("uint64"), *(np.bincount(self.history[k][own], x[own], n).astype("uint64")[at] for x in (self.twice[k], lower[self.last[k]]))]

    def weights(self, k: int, answers) -> np.ndarray:
        """Backoff weight of each history of order k - 1; 0 for those without arcs, and at the end for no history."""
        out = np.zeros(len(self.count[k - 1]) + 1)
        at = self.asked(k - 1)
        taken, lower = (shards.numbers_of(answers, k - 1, i, "uint64").astype("float64") for i in (0, 1))
        # A pair's arcs end in pairs that start with its second word.
        under = float(self.scale) if k == 2 else 2 * self.count[1][self.at[1][self.place[2][at]]]
        out[at] = _backoff(taken / (2 * self.count[k - 1][at]), lower / under)
        return out


def _ranks(total: np.ndarray) -> np.ndarray:
    """Numbers from 0, in order, of those that occur twice; others have that of the one before."""
    return np.maximum(np.cumsum(total >= LEAST), 1).astype("uint64") - np.uint64(1)


def _words(_k: int, keys: np.ndarray, counts: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Whole counts and numbers of words; in all, words that occur."""
    _, number = np.unique(keys, return_inverse=True)
    total = np.bincount(number, counts).astype("uint64")
    return [total[number], _ranks(total)[number]], int((total > 0).sum())


def _totals(keys: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Twice the whole count of each gram (0 for no arc), and one more at one of its places; and numbers of those that are arcs."""
    _, number = np.unique(keys, return_inverse=True)
    total = np.bincount(number, counts).astype("uint64")
    owner = np.zeros(len(total), "int64")
    owner[number] = np.arange(len(number))
    arc = total >= LEAST
    out = np.where(arc, total * np.uint64(2), np.uint64(0))[number]
    out[owner[arc]] += np.uint64(1)
    return [out, _ranks(total)[number]]


def _pairs(_k: int, keys: np.ndarray, counts: np.ndarray) -> tuple[list[np.ndarray], int]:
    return _totals(keys, counts), 0


def _triples_and_sums(k: int, keys: np.ndarray, *parts: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Triples are no histories and need no numbers."""
    return (_totals(keys, *parts)[:1], 0) if k == 3 else _sums(k, keys, *parts)


def _sums(_k: int, numbers: np.ndarray, *parts: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Whole sums of each history, from the sums over the arcs that chunks own."""
    _, history = np.unique(numbers, return_inverse=True)
    return [np.bincount(history, x).astype("uint64")[history] for x in parts], 0


def _backoff(taken: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """log10 of what a history's arcs leave, over what the shorter history gives to words without an arc."""
    return np.log10(np.maximum(1 - taken, 1e-9) / np.maximum(1 - lower, 1e-9))


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents with `held_out` true are scored but not learned from. Null and empty texts are one token, the end. Repeated rows
    give a row each and count each. An empty table gives no rows; without training documents every word is unseen. Columns
    other than doc_id and text are not read. Texts of any length are taken whole; a long one is a chunk of its own.
    """
    rows = docs.select(safe_id(), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    raw = stored(_chunks(rows), "raw")
    sizes = raw.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("places", "train", "n_docs", "n_words")]).first()
    tokens = sizes["train"]
    # For words and pairs: bits that name their shard, and bits of their numbers with the shard ahead.
    shard, bits = {1: shards.shard_bits(sizes["n_words"])}, {}

    def ask_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                yield pd.DataFrame(shards.requests(1, row.chunk, shard[1], shards.unpacked(row.words), shards.unplanes(row.counts, "uint64")), columns=_REQUEST)

    first = stored_by(shards.answered(raw.select("chunk", "words", "counts").mapInPandas(ask_words, shards.REQUEST), ["uint64"], _words, ranks=1), "first", "chunk", parts)
    bits[1] = shard[1] + shards.rank_bits(first)
    distinct = first.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0] - (sizes["n_docs"] > 0)  # begin is no word
    scale = tokens + distinct + 1
    # In buckets of the chunk, so that later passes meet their answers without moving the chunks again; the words' hashes are done with.
    chunks = stored_by(raw.drop("words", "counts"), "chunks", "chunk", parts)
    discard(raw)
    known = chunks.join(shards.by_chunk(first, "first"), "chunk")
    most = shards.shard_bits(sizes["places"] // PLACES_A_KEY)
    shard[2] = min(most, 2 * bits[1])

    def with_pairs(row) -> _Chunk:
        c = _Chunk(row)
        c.words(row.first, bits[1] - shard[1], scale)
        c.grams(2, (bits[1], bits[1]))
        return c

    def ask_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                c = with_pairs(row)
                yield pd.DataFrame(shards.requests(2, row.chunk, shard[2], c.keys[2], c.counts(2), width=min(64, 2 * bits[1])), columns=_REQUEST)

    second = stored_by(shards.answered(known.mapInPandas(ask_pairs, shards.REQUEST), ["uint64"], _pairs, ranks=1), "second", "chunk", parts)
    bits[2] = shard[2] + shards.rank_bits(second)
    paired = known.join(shards.by_chunk(second, "second"), "chunk", "left")
    shard[3] = min(most, bits[2] + bits[1])

    def with_triples(row) -> _Chunk:
        c = with_pairs(row)
        c.arcs(2, row.second, bits[2] - shard[2])
        c.grams(3, (bits[2], bits[1]))
        return c

    def ask_triples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                c = with_triples(row)
                out = [*shards.requests(3, row.chunk, shard[3], c.keys[3], c.counts(3), width=min(64, bits[2] + bits[1]))]
                yield pd.DataFrame([*out, *shards.requests(1, row.chunk, shard[1], *c.sums(2), width=bits[1])], columns=_REQUEST)

    third = stored_by(shards.answered(paired.mapInPandas(ask_triples, shards.REQUEST), ["uint64", "uint64"], _triples_and_sums), "third", "chunk", parts)
    tripled = paired.join(shards.by_chunk(third, "third"), "chunk", "left")

    def ask_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                c = with_triples(row)
                c.arcs(3, row.third)
                yield pd.DataFrame(shards.requests(2, row.chunk, shard[2], *c.sums(3), width=bits[2]), columns=_REQUEST)

    sums = stored_by(shards.answered(tripled.mapInPandas(ask_sums, shards.REQUEST), ["uint64", "uint64"], _sums), "sums", "chunk", parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                c = with_triples(row)
                c.arcs(3, row.third)
                one = np.log10(c.p[1])[c.at[1]]
                one[c.begin] = 0.0
                weight = one
                for k, answers in ((2, row.third), (3, row.sums)):
                    longer = np.zeros(c.n)
                    longer[1:] = c.weights(k, answers)[c.at[k - 1][:-1]]
                    longer[~c.whole[k]] = 0.0
                    longer += weight
                    arc = c.at[k] >= 0
                    longer[arc] = np.log10(c.p[k])[c.at[k][arc]]
                    weight = longer
                seen = (c.count[1] > 0)[c.at[1]] & ~c.begin
                yield pd.DataFrame({
                    "doc_id": c.ids, "held_out": c.held, "n_tokens": np.diff(np.append(c.starts, c.n)) - 1, "n_known": np.add.reduceat(seen.astype("int64"), c.starts),
                    "base_score": np.add.reduceat(one, c.starts), "score": np.add.reduceat(weight, c.starts),
                })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    with one_a_batch(docs.sparkSession):
        out = stored(tripled.join(shards.by_chunk(sums, "sums"), "chunk", "left").mapInPandas(run, schema), "scores")
    discard(chunks, first, second, third, sums)
    return out.select(real_id(), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
