"""Packing of tokenized documents into fixed-length sequences by cutting-stock column generation.

Documents are tokenized once and cut into full sequences, one multiple of `quantum` and a tail shorter than `quantum`: the
multiples fit each other, the tails fill what is left, and the program has few rows. Only the histogram of piece lengths (at
most `capacity` numbers) reaches the driver. There a linear program over patterns (multisets of lengths that fit a sequence) is
solved by column generation; a knapsack dynamic program prices new patterns. Rounded pattern counts become a small table of
rank intervals for each length; every piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import real_id, safe_id, stored

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACES = ("length", "low", "high", "copies", "first_sequence", "first_offset")
#: Pieces of one length that one window task ranks at most, on average.
RANKED = 2_000
_CACHE: dict = {}


class PieceEncoder:
    """Ids of whole texts as the library `tokenizers` gives them for a byte-level BPE file.

    Where the file's merges stand in the order of their ids, and nothing else is set, merging by rank is merging by id: then
    `tiktoken`, which is several times as fast on rare words, gives the same ids, and is taken. The library itself takes every
    other file, and texts with a very long word. Strings of the vocabulary's added tokens are single ids, as the library takes
    them, and are split off first.
    """

    def __init__(self, tokenizer_path: str | None):
        import public_tokenizers
        import regex

        self._path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
        with open(self._path, encoding="utf-8") as file:
            spec = json.load(file)
        self._added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        longest_first = sorted(self._added, key=len, reverse=True)
        self._split = regex.compile(f"({'|'.join(map(regex.escape, longest_first))})").split
        self._ranks = _ranks(spec, set(self._added), public_tokenizers.PATTERN)

    @cached_property
    def _tokens(self):
        """The library's tokenizer, loaded where a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._path)

    def _plain(self, text: str) -> list[int]:
        if self._ranks is None or _LONG_WORD.search(text):
            return self._tokens.encode(text, add_special_tokens=False).ids
        return self._ranks.encode_ordinary(text)

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not any(t in text for t in self._added):
            ids = self._plain(text)
        else:
            ids = [n for i, part in enumerate(self._split(text)) for n in ([self._added[part]] if i % 2 else self._plain(part))]
        return np.asarray(ids, "<u4").tobytes()


#: A word whose merges by rank would take time that grows with the square of its length.
_LONG_WORD = re.compile(r"\S{2000}")


def _ranks(spec: dict, added: set[str], pattern: str):
    """The file's tokens by their bytes, for merging by id; None where that is not the same as merging by rank."""
    import tiktoken

    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    vocab = {t: i for t, i in model.get("vocab", {}).items() if t not in added}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    made = [vocab.get(a + b, -1) for a, b in merges]
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    alone = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
    if not (plain and alone and all(a < b for a, b in pairwise(made)) and len(vocab) == len(merges) + 256):
        return None
    # A byte stands for itself where it prints, else for the next character from 256 on.
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(printed)]
    byte_of = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(other)}
    return tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks={bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items()}, special_tokens={})


def tokenized_pieces(docs: DataFrame, capacity: int = 1024, quantum: int = 64, tokenizer_path: str | None = None, end_id: int = 0) -> DataFrame:
    """doc_id and text to one row a piece: full pieces of `capacity` ids from the start, a multiple of `quantum`, the tail.

    Null text counts as empty; every document ends with `end_id`, so an empty one is a single id.
    """
    end = int(end_id).to_bytes(4, "little")

    def cuts(n: int) -> list[int]:
        edges = list(range(0, n + 1, capacity))
        if (whole := edges[-1] + (n - edges[-1]) // quantum * quantum) > edges[-1]:
            edges.append(whole)
        return edges if edges[-1] == n else [*edges, n]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if tokenizer_path not in _CACHE:
            _CACHE[tokenizer_path] = PieceEncoder(tokenizer_path)
        encode = _CACHE[tokenizer_path]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = (encode(text) if text else b"") + end
                n = len(ids) // 4
                for at, to in pairwise(cuts(n)):
                    rows.append((doc_id, at, to - at, zlib.crc32(ids[4 * at : 4 * to]), n))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(safe_id(), "text").mapInPandas(cut, PIECES)


# --- the linear program over the histogram -----------------------------------------------------------------------


def _best_patterns(lengths: np.ndarray, price: np.ndarray, capacity: int, most: int) -> list[tuple[float, Counter]]:
    """Unbounded knapsack by dynamic programming; up to `most` different patterns, the dearest first."""
    value, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(lengths[0]), capacity + 1):
        k = int(np.searchsorted(lengths, c, "right"))
        gain = price[:k] + value[c - lengths[:k]]
        best = int(gain.argmax())
        if gain[best] > value[c - 1]:
            value[c], took[c] = gain[best], best
        else:
            value[c] = value[c - 1]

    def walk(c: int) -> Counter:
        out: Counter = Counter()
        while c >= lengths[0]:
            if took[c] < 0:
                c -= 1
            else:
                out[int(took[c])] += 1
                c -= int(lengths[took[c]])
        return out

    first = price + value[capacity - lengths]
    found, seen = [], set()
    for i in np.argsort(-first)[: 4 * most]:
        pattern = walk(capacity - int(lengths[i]))
        pattern[int(i)] += 1
        key = tuple(sorted(pattern.items()))
        if key not in seen:
            seen.add(key)
            found.append((float(first[i]), pattern))
        if len(found) == most:
            break
    return found


def cutting_patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float = 5e-4, pivots: int = 6_000) -> list[tuple[Counter, float]]:
    """Fractional numbers of each pattern that use all counts with nearly the fewest sequences.

    Revised simplex from one-length patterns, priced between the basis' dual prices and the best known bound's (plain dual
    prices swing). It ends when Farley's bound shows that at most the share `gap` is left to gain, or after so many pivots
    (any basis on the way is a whole, feasible plan).
    """
    m = len(lengths)
    per = capacity // lengths
    basis: list[Counter] = [Counter({i: int(per[i])}) for i in range(m)]
    inverse, x = np.diag(1.0 / per), counts / per
    center = lengths / capacity  # the best prices wherever a plan without padding exists
    bound, done, pull = counts @ center, 0, 0.8
    while done < pivots and x.sum() > bound * (1 + gap):
        price = inverse.sum(axis=0)
        tried = pull * center + (1 - pull) * price
        found = _best_patterns(lengths, tried, capacity, 8)
        if (lower := counts @ tried / found[0][0]) > bound:
            bound, center = lower, tried / found[0][0]
        better = 0
        for _, pattern in found:
            rows = list(pattern)
            amounts = np.array([pattern[i] for i in rows], float)
            if amounts @ inverse[:, rows].sum(axis=0) <= 1 + gap / 10:
                continue
            step = inverse[:, rows] @ amounts
            able = np.flatnonzero(step > 1e-9)
            if not len(able):
                continue
            ratio = x[able] / step[able]
            out = int(able[ratio.argmin()])
            theta = x[out] / step[out]
            x -= theta * step
            x[out] = theta
            np.maximum(x, 0, out=x)
            row = inverse[out] / step[out]
            step[out] = 0
            inverse -= np.outer(step, row)
            inverse[out] = row
            basis[out] = pattern
            better += 1
        done += max(1, better)
        if not better:
            if pull == 0:
                break
            pull = pull / 2 if pull > 0.1 else 0
        else:
            pull = min(0.8, pull + 0.1)
    return list(zip(basis, x, strict=True))


def _fill(left: Counter, capacity: int) -> Counter:
    """One more sequence: the longest piece left, then the subset of the others that fills the most (bitset of sums)."""
    first = max(left)
    room, sums, steps = capacity - first, 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted(left, reverse=True):
        have = left[length] - (length == first)
        if length > room or have <= 0:
            continue
        for _ in range(min(have, room // length)):
            grown = (sums | (sums << length)) & mask
            if grown == sums:
                break
            steps.append((length, sums))
            sums = grown
        if sums >> room & 1:
            break
    took, at = Counter({first: 1}), sums.bit_length() - 1
    for length, before in reversed(steps):
        if not before >> at & 1:
            took[length] += 1
            at -= length
    return took


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Whole numbers of patterns that use every piece of the histogram exactly once."""
    out: list[tuple[Counter, int]] = []
    left = Counter({k: v for k, v in histogram.items() if v > 0})
    if full := left.pop(capacity, 0):
        out.append((Counter({capacity: 1}), full))
    if left:
        lengths = np.array(sorted(left), dtype=np.int64)
        counts = np.array([left[int(k)] for k in lengths], float)
        for pattern, amount in cutting_patterns(lengths, counts, capacity):
            if times := int(np.floor(amount + 1e-6)):
                named = Counter({int(lengths[i]): n for i, n in pattern.items()})
                times = min([times, *(left[k] // n for k, n in named.items())])
                if times:
                    out.append((named, times))
                    for k, n in named.items():
                        left[k] -= n * times
        left = +left
        while left:
            took = _fill(left, capacity)
            times = min(left[k] // n for k, n in took.items())
            out.append((took, times))
            left = left - Counter({k: n * times for k, n in took.items()})
    return out


def intervals(patterns: list[tuple[Counter, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, copies in a sequence, first sequence, offset) for each pattern and length."""
    rows, taken, sequence = [], Counter(), 0
    for pattern, times in patterns:
        at = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            rows.append((length, taken[length], taken[length] + n * times, n, sequence, at))
            taken[length] += n * times
            at += n * length
        sequence += times
    return rows


def pack(docs: DataFrame, capacity: int = 1024, quantum: int = 64, tokenizer_path: str | None = None) -> DataFrame:
    """Pack every id of every document into sequences of at most `capacity` ids.

    One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null texts are empty; a document
    without text is one piece of one id. Repeated rows are packed each on their own (their ranks are tied: any order of them
    is a right result). An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    pieces = stored(tokenized_pieces(docs, capacity, quantum, tokenizer_path), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    spark = docs.sparkSession
    rows = intervals(plan(histogram, capacity))
    # An Arrow table is read by the JVM alone; from a list Spark would start Python workers of another kind, which stay.
    places = spark.createDataFrame(pa.table({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(PLACES)}))
    groups = [1] * (capacity + 1)
    for length, n in histogram.items():
        groups[length] = -(-n // RANKED)
    share = F.pmod(F.xxhash64("doc_id", "start"), F.array(*map(F.lit, groups))[F.col("length").cast("int")].cast("long"))
    pieces = pieces.withColumn("_share", share)
    before = Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.groupBy("length", "_share").count().select("length", "_share", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_share").orderBy("doc_id", "start")
    ranked = pieces.withColumn("_rank", F.row_number().over(within) - 1).join(starts, ["length", "_share"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before"))
    # The plan has one row for each pattern and length: bounded by the capacity, whatever the number of documents.
    at = F.col("_rank") - F.col("low")
    return (
        ranked.join(F.broadcast(places.withColumnRenamed("length", "_length")), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high")))
        .select(
            real_id(), "start", "length", "ids_crc32", "doc_tokens",
            (F.col("first_sequence") + F.floor(at / F.col("copies"))).alias("sequence_id"),
            (F.col("first_offset") + F.pmod(at, F.col("copies")) * F.col("length")).alias("offset"),
        )
    )
