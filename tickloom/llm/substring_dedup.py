"""Repeated passages: similar lines by MinHash banding, and exact runs of words wherever they stand.

Paragraphs are the lines of a text. Equal ones (by their words) are one class; a class is listed under its bands and joined by
the same tile join as whole documents: bitmaps, exact Jaccard, components. 14 bands of 4 rows find a pair of similarity 0.8
with probability 0.9994, more above.

A run of 50 words that stands in two documents is found whatever lines it stands in. Each text selects the smallest hash of 25
words of every 26 in a row: two equal runs of 50 words select an equal hash. Only windows of 50 words around selected hashes
that another document has too are asked for in the shards of the key space, which tell the first document that holds each;
windows in a row make a passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import shards
from tickloom.llm.common import discard, mix64, pieces_of, safe_id, shingle_hashes, small, stored, words_of
from tickloom.llm.ngram_join import PIECE, bitmap_bits, join_tiles

BANDS, ROWS = 14, 4
#: Words of a window: a run of so many that stands in two documents is found.
RUN = 50
#: Characters of text that close a chunk.
CHUNK = 4_000_000
_SCHEMA = "doc_id long, paragraph long, start long, end long, n_words long, n long, f long, bands array<long>, bits binary"


class Lines:
    """The lines of several texts that have at least `least` words: place in code points, words, hash of the words, shingles."""

    def __init__(self, texts: list[str | None], least: int, k: int):
        w = words_of(texts)
        ends = w.raw == 10
        ends[w.at[1:] - 1] = True  # the gap after each text
        stop = np.flatnonzero(ends)
        edge = np.concatenate([[0], np.searchsorted(w.start, stop)])
        line = np.flatnonzero(np.diff(edge) >= least)
        begin = np.concatenate([[0], stop[:-1] + 1])
        first_line = np.searchsorted(stop, w.at[:-1])
        self.text = np.searchsorted(w.at, begin[line], "right") - 1
        self.number = line - first_line[self.text]
        points = np.concatenate([[0], np.cumsum((w.raw & 0xC0) != 0x80)])
        base = points[w.at[self.text]]
        self.start, self.end = points[begin[line]] - base, points[stop[line]] - base
        self.n_words = np.diff(edge)[line]
        own = np.repeat(np.arange(len(line)), self.n_words)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(self.n_words) - self.n_words, self.n_words)
        words = w.hash[np.repeat(edge[line], self.n_words) + nth]
        fine = nth < np.repeat(self.n_words - k + 1, self.n_words)
        self.shingles = shingle_hashes(words, k)[fine[: len(words) - k + 1]] if len(words) >= k else words[:0]
        self.at = np.cumsum(self.n_words - k + 1) - (self.n_words - k + 1)
        with np.errstate(over="ignore"):
            self.f = np.add.reduceat(mix64(words + mix64(nth.astype(np.uint64))), np.cumsum(self.n_words) - self.n_words, dtype=np.uint64).view(np.int64) if len(line) else np.zeros(0, np.int64)
        self.of = own[fine]

    def __len__(self) -> int:
        return len(self.f)

    def set_of(self, i: int) -> np.ndarray:
        return np.unique(self.shingles[self.at[i] : self.at[i + 1] if i + 1 < len(self.at) else None])

    def sizes(self) -> np.ndarray:
        """Distinct shingles of each line."""
        value = mix64(self.shingles ^ mix64(self.of.astype(np.uint64)))
        order = np.sort(value)
        again = np.unique(order[1:][order[1:] == order[:-1]])
        n = np.bincount(self.of, minlength=len(self))
        if len(again):
            at = np.minimum(np.searchsorted(again, value), len(again) - 1)
            hit = np.flatnonzero(again[at] == value)
            _, one = np.unique(value[hit], return_index=True)
            n -= np.bincount(self.of[hit], minlength=len(self)) - np.bincount(self.of[hit[one]], minlength=len(self))
        return n

    def bitmaps(self, sizes: np.ndarray) -> list[bytes]:
        """Bitmaps of the lines' shingle sets, as those of whole documents."""
        bits = np.array([bitmap_bits(int(n)) for n in sizes], np.int64)
        first = np.cumsum(bits) - bits
        out = np.zeros(int(bits.sum()), np.uint8)
        out[first[self.of] + (mix64(self.shingles) & (bits[self.of] - 1).astype(np.uint64)).astype(np.int64)] = 1
        packed = np.packbits(out).tobytes()
        return [packed[a : a + n] for a, n in zip((first // 8).tolist(), (bits // 8).tolist(), strict=True)]

    def bands(self, seed: int = 9) -> np.ndarray:
        """One hash a band for each line: minima of its shingles under random multiplications, mixed by band."""
        rng = np.random.default_rng(seed)
        factors = rng.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        shifts = rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
        flat = (mix64(self.shingles) >> np.uint64(32)).astype(np.uint32)
        out = np.zeros((len(self), BANDS), np.uint64)
        with np.errstate(over="ignore"):
            for r in range(BANDS * ROWS):
                low = np.minimum.reduceat((flat ^ shifts[r]) * factors[r], self.at)
                out[:, r // ROWS] = mix64(out[:, r // ROWS] * np.uint64(31) + low + np.uint64(r // ROWS + 1))
        return out.view(np.int64)


def paragraphs(docs: DataFrame, least: int, k: int) -> DataFrame:
    """A row a line; bands and bits stand at the first of equal lines in a piece."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces_of(batches, PIECE):
            lines = Lines(batch["text"].to_list(), least, k)
            if len(lines):
                n = lines.sizes()
                _, one = np.unique(lines.f, return_index=True)
                bands, bits, all_bands, all_bits = [None] * len(lines), [None] * len(lines), list(lines.bands()), lines.bitmaps(n)
                for i in one:
                    bands[i], bits[i] = all_bands[i], all_bits[i]
                yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[lines.text], "paragraph": lines.number, "start": lines.start, "end": lines.end, "n_words": lines.n_words, "n": n, "f": lines.f, "bands": bands, "bits": bits})

    return docs.filter("doc_id IS NOT NULL").select(safe_id(), "text").mapInPandas(scan, _SCHEMA)


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted documents' texts with what stands in `wanted` for each: ids go to the texts first, if there are few enough of
    them, so that other texts do not move."""
    few = docs.select("doc_id", "text").join(small(wanted.select("doc_id"), wanted.count()), "doc_id", "left_semi")
    return few.join(wanted, "doc_id")


def repeated(docs: DataFrame, least: int = 20, share: tuple[int, int] = (4, 5), k: int = 5, across: bool = True) -> DataFrame:
    """One row a repeated paragraph: doc_id, paragraph (line number from 0), start, end, n_words, cluster_doc, cluster_paragraph, n_docs, removed.

    Offsets are code points, ends exclusive. The cluster is named by its first paragraph (smallest doc_id, then number), which
    stays; the others are marked removed. `across` leaves clusters within one document out. Lines of fewer than `least` words
    (`k` at least) are too short to judge. Rows without doc_id are left alone. Null and empty texts have no paragraphs. Repeated
    rows under one doc_id are one document. An empty table gives no rows; columns other than doc_id and text are not read.
    """
    least = max(least, k)
    rows = stored(paragraphs(docs, least, k), "paragraphs")
    # Map-side aggregation joins equal paragraphs before they move.
    classes = rows.groupBy(F.col("f").alias("id")).agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.first("bands", True).alias("bands"), F.first("bits", True).alias("bits"))
    classes = stored(classes, "classes")

    def contents(ids: DataFrame) -> DataFrame:
        """(id, s): sets of the named classes, from the documents where each class stands first."""
        wanted = stored(ids.join(classes.select("id", "doc_id"), "id").groupBy("doc_id").agg(F.collect_list("id").alias("ids")), "wanted")

        def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in pieces_of(batches, PIECE):
                lines = Lines(batch["text"].to_list(), least, k)
                at = np.flatnonzero(np.isin(lines.f, np.concatenate(batch["ids"].to_list())))
                yield pd.DataFrame({"id": lines.f[at], "s": [lines.set_of(i).tobytes() for i in at]})

        found = _texts_of(docs, wanted).mapInPandas(sets, "id long, s binary")
        return found.groupBy("id").agg(F.first("s").alias("s"))

    listed = classes.select("id", "n", F.explode("bands").alias("h"))
    parts = stored(join_tiles(listed, classes.select("id", "n", "bits"), contents, share, lambda k, na, nb: k >= 1), "parts")
    plain = rows.select("doc_id", "paragraph", "start", "end", "n_words", "f")
    named = stored(plain.join(small(parts.withColumnRenamed("id", "f"), parts.count()), "f", "left").withColumn("c", F.coalesce("component_id", "f")).drop("component_id", "f").distinct(), "named")
    discard(rows, classes, parts)
    docs_of = named.select("c", "doc_id").distinct().groupBy("c").agg(F.count("*").alias("n_docs"))
    size = named.groupBy("c").agg(F.count("*").alias("m"), F.min(F.struct("doc_id", "paragraph")).alias("first")).filter("m > 1").join(docs_of, "c")
    if across:
        size = size.filter("n_docs > 1")
    size = stored(size.select("c", "n_docs", "first"), "clusters")
    out = named.join(small(size, size.count()), "c")
    removed = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("paragraph") != F.col("first.paragraph"))
    return out.select("doc_id", "paragraph", "start", "end", "n_words", F.col("first.doc_id").alias("cluster_doc"), F.col("first.paragraph").alias("cluster_paragraph"), "n_docs", removed.alias("removed"))


def _slide(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The best of every `width` numbers in a row; as many as there are such rows."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = best(x[: len(x) - step], x[step:])
        done += step
    return x


def selected(words: np.ndarray, whole: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the half runs selected: the smallest of each window of `run` words that starts at one of `whole`.

    Equal windows select equal hashes, so documents that share a window share a selected hash.
    """
    half = (run + 1) // 2
    width = run - half + 1
    if not len(whole):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    halves = shingle_hashes(words, half)
    least = np.zeros(len(words) - run + 1, np.uint64)  # 0 where no window is
    least[whole] = _slide(halves, width, np.minimum)[whole]
    edge = np.zeros(width - 1, np.uint64)
    covering = _slide(np.concatenate([edge, least, edge]), width, np.maximum)  # of the windows that hold a half
    at = np.flatnonzero(covering[: len(halves)] == halves)
    return at, halves[at]


class _Windows:
    """Words of a chunk's texts; the distinct windows of a run around hashes that others share, with their first and last document."""

    def __init__(self, ids, texts, shared, run: int):
        self.words = w = words_of(list(texts))
        whole = w.places(run)
        at, halves = selected(w.hash, whole, run)
        text_of = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        # A half may be shared by one text of the chunk and not by another: asking for a few more windows changes no answer.
        at = at[np.isin(halves, np.concatenate([np.asarray(s, "int64") for s in shared]).view(np.uint64))]
        near = np.zeros(len(w.hash) + 1, np.int64)
        width = run - (run + 1) // 2 + 1
        np.add.at(near, np.maximum(0, at - width + 1), 1)
        np.add.at(near, at + 1, -1)
        self.place = whole[np.cumsum(near)[whole] > 0]
        self.row = text_of[self.place]
        self.doc = np.asarray(ids, "int64")[self.row]
        keys = shingle_hashes(w.hash, run)[self.place] if len(self.place) else np.zeros(0, np.uint64)
        self.keys, self.at = np.unique(keys, return_inverse=True)
        order = np.argsort(self.at, kind="stable")
        starts = np.searchsorted(self.at[order], np.arange(len(self.keys)))
        docs = self.doc[order]
        self.least, self.most = (f.reduceat(docs, starts) if len(docs) else docs for f in (np.minimum, np.maximum))


def _first_of(_n: int, keys: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[list[np.ndarray], int]:
    """The smallest document of each window, and 1 if another document holds it too."""
    known, at = np.unique(keys, return_inverse=True)
    low, high = np.full(len(known), np.iinfo("int64").max), np.full(len(known), np.iinfo("int64").min)
    np.minimum.at(low, at, least)
    np.maximum.at(high, at, most)
    return [low[at], (low < high).astype("uint8")[at]], 0


def passages(docs: DataFrame, run: int = RUN) -> DataFrame:
    """One row a passage whose every window of `run` words stands in another document too: doc_id, start, end, n_words, cluster_doc, removed.

    Words are compared without case and white space, so line breaks do not matter. A passage is as long as its windows follow
    each other and have the same first document (smallest doc_id), which names the cluster and keeps it; passages with different
    first documents may overlap. Offsets are code points, ends exclusive. Rows without doc_id are left alone; repeated rows under
    one doc_id are one document. Null, empty and shorter texts have none; an empty table gives none. Other columns are not read.
    """
    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")

    def halves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces_of(batches, PIECE):
            w = words_of(batch["text"].to_list())
            at, value = selected(w.hash, w.places(run), run)
            text = np.searchsorted(w.first, at, "right") - 1
            yield pd.DataFrame({"h": value.view("int64"), "doc_id": batch["doc_id"].to_numpy("int64")[text]}).drop_duplicates()

    chosen = stored(rows.mapInPandas(halves, "h long, doc_id long"), "halves")
    # Sums of a task come first, so a passage that a third of all documents hold is one row a task.
    shared = stored(chosen.groupBy("h").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).filter("_a < _b").select("h"), "shared")
    near = stored(chosen.join(small(shared, shared.count()), "h").groupBy("doc_id").agg(F.collect_set("h").alias("shared")), "near")
    discard(chosen, shared)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in pieces_of(batches, CHUNK):
            yield pd.DataFrame({"ids": [part["doc_id"].to_list()], "texts": [part["text"].to_list()], "shared": [part["shared"].to_list()], "words": [int(part["text"].map(len).sum()) // 6 + 1]})

    schema = "ids array<long>, texts array<string>, shared array<array<long>>, words long"
    chunks = stored(_texts_of(rows, near).mapInPandas(cut, schema).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    discard(near)
    bits = shards.shard_bits(chunks.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                w = _Windows(row.ids, row.texts, row.shared, run)
                yield pd.DataFrame(shards.requests(1, row.chunk, bits, w.keys, w.least, w.most), columns=["n", "shard", "chunk", "keys", "numbers"])

    found = shards.answered(chunks.mapInPandas(ask, shards.REQUEST), ["int64", "int64"], _first_of)
    answers = stored(shards.by_chunk(found, "found"), "found")

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                w = _Windows(row.ids, row.texts, row.shared, run)
                lead, shared = (shards.numbers_of(row.found, 1, i, t)[w.at] for i, t in enumerate(("int64", "uint8")))
                hit = np.flatnonzero(shared)
                if not len(hit):
                    continue
                place, lead, doc, of = w.place[hit], lead[hit], w.doc[hit], w.row[hit]
                new = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 1) | (np.diff(lead) != 0) | (np.diff(of) != 0)]))
                last = np.append(new[1:], len(hit)) - 1
                points = np.concatenate([[0], np.cumsum((w.words.raw & 0xC0) != 0x80)])
                base = points[w.words.at[of[new]]]
                yield pd.DataFrame({
                    "doc_id": doc[new], "start": points[w.words.start[place[new]]] - base, "end": points[w.words.end[place[last] + run - 1]] - base, "n_words": place[last] - place[new] + run,
                    "cluster_doc": lead[new], "removed": lead[new] != doc[new],
                })

    out = chunks.join(answers, "chunk").mapInPandas(tell, "doc_id long, start long, end long, n_words long, cluster_doc long, removed boolean")
    out = stored(out.distinct(), "passages")
    discard(chunks, answers)
    return out


def found(docs: DataFrame, least: int = 20, share: tuple[int, int] = (4, 5), k: int = 5, run: int = RUN) -> DataFrame:
    """Rows of repeated() for similar lines and of passages() for runs of words, these without paragraph numbers: doc_id,
    paragraph, start, end, n_words, cluster_doc, cluster_paragraph, removed. Nulls, repeated rows and the rest as there."""
    none = F.lit(None).cast("long")
    runs = passages(docs, run).select("doc_id", none.alias("paragraph"), "start", "end", "n_words", "cluster_doc", none.alias("cluster_paragraph"), "removed")
    return repeated(docs, least, share, k).drop("n_docs").unionByName(runs)


def _without(text: str | None, spans: list | None) -> str | None:
    """Text without the spans (start, end, is_line); a line goes with its line break."""
    if text is None or spans is None:
        return text
    kept, at = [], 0
    for a, b in sorted((s["start"], s["end"] + s["line"]) for s in spans):
        kept.append(text[at : max(at, a)])
        at = max(at, b)
    out = "".join(kept) + text[at:]
    return out[:-1] if at > len(text) and out.endswith("\n") else out


def without_repeats(docs: DataFrame, least: int = 20, share: tuple[int, int] = (4, 5), k: int = 5, run: int = RUN) -> DataFrame:
    """docs with the removed paragraphs and passages cut out of their texts; same rows and columns, whatever their names.

    Rows without doc_id and null or empty texts stay as they are; repeated rows are cut alike.
    """
    span = F.struct("start", "end", F.col("paragraph").isNotNull().cast("int").alias("line"))
    gone = found(docs, least, share, k, run).filter("removed").groupBy("doc_id").agg(F.collect_set(span).alias("spans"))
    cut = F.udf(_without, "string")
    text = F.when(gone["spans"].isNull(), docs["text"]).otherwise(cut(docs["text"], gone["spans"])).alias("text")
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left").select(*[text if c == "text" else docs[f"`{c}`"] for c in docs.columns])
