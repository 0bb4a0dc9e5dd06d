"""Self-join of documents by Jaccard similarity of their word shingles, down to linked groups.

Documents with equal shingle sets are one class. A class lists the first part of its shingles in a global order (common
shingles last, then by hash): two classes that link must share one of those. Shared shingles make tiles. First every class is
held against one class of its tiles, which joins groups of copies without pairing them off. What is still apart after that
meets in two ways: in a small tile as pairs, which must share enough listed shingles; in large tiles as blocks, gathered by the
group that leads the tile and by bands of set size (linked sets differ by a quarter at most). Blocks first see hashed bitmaps
alone, whose bit counts bound an overlap from above; only sets that may still link travel, and a task intersects them exactly
and tells the links that join groups, never all pairs.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import NO_ID, discard, mix64, pieces_of, real_id, safe_id, shingle_hashes, small, stored, whole_groups, words_of
from tickloom.llm.components import components

#: Documents that make a shingle common; common ones go last in the order (which steers speed, never results).
COMMON = 8
#: Most common shingles that are sent along, the most frequent first.
COMMON_MOST = 1_000_000
#: Members in a tile that make a group large: it takes in others by one member before blocks are made. How often it may, and
#: the share of those asked (one in so many) that must have linked to make a next time worth it. All steer speed, never results.
LARGE, ROUNDS, WORTH = 16_384, 4, 20
#: Members of a tile that are paired off one by one; larger tiles are compared in blocks.
PAIRED = 32
#: Sets in a block, and shingles in it.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
#: Characters of text that are hashed together, and those whose shingles are counted together.
PIECE, COUNTED = 1_000_000, 8_000_000


def shingle_sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of whole texts; the whole sequence as one with fewer words."""
    w = words_of(texts)
    runs = shingle_hashes(w.hash, k) if len(w.hash) >= k else w.hash[:0]
    out = []
    for a, b in zip(w.first.tolist(), w.first[1:].tolist(), strict=False):
        out.append(np.unique(runs[a : b - k + 1] if b - a >= k else shingle_hashes(w.hash[a:b], k)))
    return out


def common_shingles(docs: DataFrame, k: int = 5) -> np.ndarray:
    """Sorted hashes of shingles that many documents share, gathered from every task's own counts.

    Only an ordering hint: the join gives the same groups whatever is in it. Texts are hashed in pieces, and the sets of several
    pieces are counted together, whatever the batches that they came in.
    """

    def repeated(sets: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        own = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        own.sort()
        again = own[1:][own[1:] == own[:-1]]
        if len(again):
            value, n = np.unique(again, return_counts=True)
            yield pd.DataFrame({"h": value.view("int64"), "n": n + 1})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets, held = [], 0
        for batch in pieces_of(batches, PIECE):
            sets += shingle_sets(batch["text"].to_list(), k)
            held += sum(len(t) + 1 if t else 1 for t in batch["text"])
            if held >= COUNTED:
                yield from repeated(sets)
                sets, held = [], 0
        yield from repeated(sets)

    rows = docs.select("text").mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON)
    top = rows.orderBy(F.desc("n"), "h").limit(COMMON_MOST).select("h").toPandas()  # bounded by COMMON_MOST numbers
    return np.sort(top["h"].to_numpy("int64").view("uint64"))


def bitmap_bits(n: int) -> int:
    """Bits of a set's bitmap: at least twice its size, as a power of two from 64 up to 65536."""
    return 1 << min(16, max(6, (2 * n - 1).bit_length()))


def bitmap(values: np.ndarray) -> bytes:
    """One bit for each hashed value. A bitmap folds to half its size by joining its halves."""
    bits = bitmap_bits(len(values))
    out = np.zeros(bits, np.uint8)
    out[(mix64(values) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def _matrix(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit numbers, all folded to the size of the smallest."""
    size = min(map(len, bitmaps))
    rows = [b if len(b) == size else np.bitwise_or.reduce(np.frombuffer(b, np.uint8).reshape(-1, size)).tobytes() for b in bitmaps]
    return np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1)


def prefix_length(n: int, share: tuple[int, int]) -> int:
    """How many first shingles must hold one that any linked set shares: n - ceil(share n) + 1."""
    return n - -(-n * share[0] // share[1]) + 1


def _band(n: Column, share: tuple[int, int]) -> Column:
    """Size bands: linked sizes fall into the same band or the next."""
    return F.floor(F.log(n.cast("double")) / math.log(share[1] / share[0]) + F.lit(1e-9)).cast("int")


def fingerprint(s: np.ndarray) -> int:
    """One signed 64-bit number for a set of hashes."""
    with np.errstate(over="ignore"):
        return int(mix64(mix64(s).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(s))).view(np.int64)[0])


def signatures(docs: DataFrame, share: tuple[int, int], common: np.ndarray, k: int) -> DataFrame:
    """doc_id, n, f (fingerprint of the set), prefix (its first shingles in the global order) and bits (its bitmap)."""
    last = docs.sparkSession.sparkContext.broadcast(common)  # at most COMMON_MOST numbers

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = last.value
        for batch in pieces_of(batches, PIECE):
            rows = []
            for doc_id, s in zip(batch["doc_id"], shingle_sets(batch["text"].to_list(), k), strict=True):
                n = len(s)
                first = s[: min(n, prefix_length(n, share))] if n else s
                if n and len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    rare = often[at] != s
                    if not rare[: len(first)].all():
                        first = np.concatenate([s[rare], s[~rare]])[: len(first)]
                rows.append((doc_id, n, fingerprint(s), first.view(np.int64), bitmap(s)))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "f", "prefix", "bits"])

    return docs.select(safe_id(), "text").mapInPandas(sign, "doc_id long, n long, f long, prefix array<long>, bits binary")


class _Block:
    """Sets of one block pair: probes against homes of other groups. A link joins two groups (labels) for what follows."""

    def __init__(self, rows: dict[str, np.ndarray], a: int, b: int, share: tuple[int, int]):
        self.share = share
        self.id, self.n = rows["id"][a:b], rows["n"][a:b]
        self.label = np.unique(rows["c"][a:b], return_inverse=True)[1]
        self.bits = _matrix(list(rows["bits"][a:b]))
        self.pop = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        probe = rows["probe"][a:b]
        self.probes, self.homes = np.flatnonzero(probe), np.flatnonzero(~probe)

    def may_link(self, i: int, of: np.ndarray) -> np.ndarray:
        """Which of these may link with set i: other group, fitting sizes, and enough bits in common for the overlap they need."""
        p, q = self.share
        of = of[self.label[of] != self.label[i]]
        of = of[q * np.minimum(self.n[of], self.n[i]) >= p * np.maximum(self.n[of], self.n[i])]
        both = np.bitwise_count(self.bits[of] & self.bits[i]).sum(axis=1, dtype=np.int64)
        most = np.minimum(self.n[i] - self.pop[i], self.n[of] - self.pop[of]) + both
        return of[most >= self.need(i, of)]

    def need(self, i: int, of: np.ndarray) -> np.ndarray:
        p, q = self.share
        return -(-p * (self.n[i] + self.n[of]) // (p + q))

    def survivors(self) -> np.ndarray:
        keep = np.zeros(len(self.id), bool)
        for i in self.probes:
            if len(of := self.may_link(i, self.homes)):
                keep[i] = keep[of] = True
        return keep

    def links(self, sets: list[bytes]) -> Iterator[tuple[int, int]]:
        """Links that join groups, by exact intersection of sorted arrays."""
        own = [np.frombuffer(s, np.uint64) for s in sets]
        codes = None
        for i in self.probes:
            of = self.may_link(i, self.homes)
            while len(of):
                _, one = np.unique(self.label[of], return_index=True)  # one of each group first: the rest may then be settled
                now = of[one]
                if len(now) > 8 and codes is None:
                    edges = np.cumsum([0, *map(len, own)])
                    known, flat = np.unique(np.concatenate(own), return_inverse=True)
                    codes, mark = [flat[x:y] for x, y in zip(edges, edges[1:], strict=False)], np.zeros(len(known), bool)
                if len(now) > 8:
                    mark[codes[i]] = True
                    starts = np.cumsum([0, *(len(codes[j]) for j in now[:-1])])
                    shared = np.add.reduceat(mark[np.concatenate([codes[j] for j in now])].astype(np.int64), starts)
                    mark[codes[i]] = False
                else:
                    shared = np.array([len(np.intersect1d(own[i], own[j], assume_unique=True)) for j in now])
                for j in now[shared >= self.need(i, now)]:
                    if self.label[i] != self.label[j]:
                        self.label[self.label == self.label[j]] = self.label[i]
                        yield int(self.id[i]), int(self.id[j])
                rest = np.ones(len(of), bool)
                rest[one] = False
                of = of[rest & (self.label[of] != self.label[i])]


def _columns(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    return {c: rows[c].to_numpy() for c in rows.columns}


def link_blocks(meeting: DataFrame, signs: DataFrame, contents: Callable[[DataFrame], DataFrame], share: tuple[int, int]) -> DataFrame:
    """Stored links (a, b) between groups: rows (g, id, c, probe, home) say that in g each probe may link with each home.

    c is a set's group so far; sets of one group are not compared. Blocks and bands bound what a task holds; `signs` has
    (id, n, bits), `contents` takes ids and gives (id, s).
    """
    n_of = signs.select("id", "n")
    meeting = stored(meeting.join(n_of, "id").withColumn("band", _band(F.col("n"), share)), "meeting")
    homes = meeting.filter("home")
    probes = meeting.filter("probe").withColumn("band", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])))
    per = F.greatest(F.lit(16), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_SHINGLES) / F.max("n"))))
    sizes = homes.groupBy("g", "band").agg(F.ceil(F.count("*") / per).cast("int").alias("hs"), per.alias("per"))
    asked = probes.groupBy("g", "band").agg(F.count("*").alias("k"))
    sizes = stored(sizes.join(asked, ["g", "band"]).select("g", "band", "hs", F.ceil(F.col("k") / F.col("per")).cast("int").alias("ps")), "sizes")

    def spread(rows: DataFrame, own: str, other: str, probe: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("id", F.lit(3)), F.col(own)).cast("int").alias("mine")
        rows = rows.join(sizes, ["g", "band"]).select("g", "band", "id", "c", mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("met"))
        pair = ("mine", "met") if probe else ("met", "mine")
        return rows.select(F.xxhash64("g", "band", *pair).alias("key"), "id", "c", F.lit(probe).alias("probe"))

    placed = spread(probes, "ps", "hs", True).unionByName(spread(homes, "hs", "ps", False)).join(signs.select("id", "n", "bits"), "id")

    def sieve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, edges in whole_groups(batches, "key"):
            cols = _columns(rows)
            keep = np.concatenate([_Block(cols, a, b, share).survivors() for a, b in zip(edges, edges[1:], strict=False)])
            yield rows[keep]

    kept = placed.repartition("key").sortWithinPartitions("key").mapInPandas(sieve, placed.schema)
    kept = stored(kept, "kept")
    discard(meeting, sizes)
    if not kept.take(1):
        return kept.select(F.col("id").alias("a"), F.col("id").alias("b"))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, edges in whole_groups(batches, "key"):
            cols = _columns(rows)
            found = [pair for a, b in zip(edges, edges[1:], strict=False) for pair in _Block(cols, a, b, share).links(cols["s"][a:b])]
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    whole = kept.join(contents(kept.select("id").distinct()), "id")
    links = stored(whole.repartition("key").sortWithinPartitions("key").mapInPandas(exact, "a long, b long"), "links")
    discard(kept)
    return links


def _stars(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) as meetings: in a group named by a, a is the probe and every b a home."""
    g = F.xxhash64(F.lit(1), "a").alias("g")
    probes = pairs.select(g, F.col("a").alias("id"), F.col("ca").alias("c"), F.lit(True).alias("probe"), F.lit(False).alias("home")).distinct()
    return probes.unionByName(pairs.select(g, F.col("b").alias("id"), F.col("cb").alias("c"), F.lit(False).alias("probe"), F.lit(True).alias("home")))


def enough(shared: Column, na: Column, nb: Column, share: tuple[int, int]) -> Column:
    """Whether sets with so many common listed shingles may link.

    Of the set whose list ends first, what comes after its list is all that the other can add: n less the list's length,
    which is ceil(share n) - 1. An exact bound from above, so it drops no link.
    """
    p, q = share
    most = shared + F.greatest(F.ceil(na * p / q), F.ceil(nb * p / q)) - 1
    return most >= F.ceil((na + nb) * p / (p + q))


def _open(tiles: DataFrame, joined: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """The rows (h, id, n, c) of tiles that hold several groups, with groups, m (rows), largest and lead (one, c) of the tile.

    lead.one is the member of the largest group with the most weight, if `weights` are given, else any.
    """
    parts = stored(components(joined), "parts")
    named = tiles.select("h", "id", "n").join(parts, "id", "left").select("h", "id", "n", F.coalesce("component_id", "id").alias("c"))
    ranked = named.withColumn("weight", F.xxhash64("id")) if weights is None else named.join(weights, "id")
    sizes = ranked.groupBy("h", "c").agg(F.count("*").alias("m"), F.max_by("id", "weight").alias("one"))
    tops = F.max_by(F.struct("one", "c"), F.struct("m", "c"))
    open_tiles = sizes.groupBy("h").agg(F.count("*").alias("groups"), F.sum("m").alias("m"), F.max("m").alias("largest"), tops.alias("lead")).filter("groups > 1")
    out = stored(named.join(open_tiles, "h"), "open")
    discard(parts)
    return out


def join_tiles(listed: DataFrame, signs: DataFrame, contents: Callable[[DataFrame], DataFrame], share: tuple[int, int], may_link: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Rows (h, id, n) of sets of size n listed under keys h to (id, component_id) of sets that link.

    `may_link` tells from the number of shared keys and both sizes whether a pair can link (always true where keys do not bound
    it); see link_blocks() for `signs` and `contents`. Keys that list one set go first; then each set meets the smallest id of
    the key it shares most with; then what shares a key with a large group meets another member of it; then all that is still
    apart under a common key meets, as pairs or as blocks.
    """
    p, q = share
    shared = listed.groupBy("h").agg(F.min("id").alias("lead"), F.max("id").alias("_last"), F.count("*").alias("m")).filter("lead < _last").select("h", "lead", "m")
    tiles = stored(listed.join(shared, "h"), "tiles")
    first = tiles.filter("lead <> id").groupBy("id", "lead", "n").count().filter(may_link(F.col("count"), F.col("n"), F.col("n")))
    one = first.groupBy("id").agg(F.max_by("lead", F.struct("count", F.bitwise_not("lead"))).alias("a"))
    joined = link_blocks(_stars(one.select("a", F.col("id").alias("b"), F.col("a").alias("ca"), F.col("id").alias("cb"))), signs, contents, share)
    open_ = _open(tiles, joined)
    for turn in range(ROUNDS):
        large = open_.filter((F.col("largest") >= LARGE) & (F.col("c") != F.col("lead.c")))
        if not large.take(1):
            break
        if not turn:  # what shares most with others is near the text that copies were made from, and so links to most of them
            weights = stored(tiles.groupBy("id").agg(F.sum("m").alias("weight")), "weights")
            discard(open_)
            open_ = _open(tiles, joined, weights)
            large = open_.filter((F.col("largest") >= LARGE) & (F.col("c") != F.col("lead.c")))
        again = large.groupBy("id", "n", "c", "lead").agg(F.count("*").alias("k")).filter(may_link(F.col("k"), F.col("n"), F.col("n")))
        again = again.groupBy("id", "c").agg(F.max_by("lead", F.struct("k", "lead.one")).alias("lead"))
        again = stored(again.select(F.col("lead.one").alias("a"), F.col("id").alias("b"), F.col("lead.c").alias("ca"), F.col("c").alias("cb")), "again")
        more, asked = link_blocks(_stars(again), signs, contents, share), again.count()
        joined = joined.unionByName(more)
        discard(open_, again)
        open_ = _open(tiles, joined, weights.select("id", F.xxhash64("id", F.lit(turn)).alias("weight")))
        if more.count() * WORTH < asked:
            break
    discard(tiles)
    rows = open_.filter(F.col("m") <= PAIRED).select("h", "id", "n", "c", _band(F.col("n"), share).alias("band"))
    low = rows.select("h", "band", F.col("id").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"))
    high = rows.select("h", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"))
    meet = (F.col("ca") != F.col("cb")) & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))) & (F.col("na") * q >= F.col("nb") * p)
    # Keys in large tiles are not counted here: a pair that shares one of those meets in its blocks.
    met = low.join(high, ["h", "band"]).filter(meet).groupBy("a", "b", "na", "nb", "ca", "cb").agg(F.count("*").alias("k"))
    pairs = _stars(met.filter(may_link(F.col("k"), F.col("na"), F.col("nb"))))
    g = F.col("lead.c")
    blocks = open_.filter(F.col("m") > PAIRED).select(F.xxhash64(F.lit(2), g).alias("g"), "id", "c", (F.col("c") != g).alias("probe"), F.lit(True).alias("home")).distinct()
    last = link_blocks(pairs.unionByName(blocks), signs, contents, share)
    discard(open_)
    return components(joined.unionByName(last))


def _grouped(docs: DataFrame, share: tuple[int, int], k: int) -> DataFrame:
    """doc_id, n, f (fingerprint of the set) and component_id of each row."""
    signed = stored(signatures(docs, share, common_shingles(docs, k), k), "signatures")
    named = signed.filter((F.col("n") > 0) & (F.col("doc_id") != NO_ID))
    # Map-side aggregation joins copies before they move, so a large group of copies is one row a task.
    classes = named.groupBy("f").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "prefix", "bits")])
    classes = stored(classes.withColumnRenamed("f", "id"), "classes")
    homes = classes.select("id", "doc_id")

    def contents(ids: DataFrame) -> DataFrame:
        wanted = stored(ids.join(homes, "id"), "wanted")

        def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in pieces_of(batches, PIECE):
                own = shingle_sets(batch["text"].to_list(), k)
                yield pd.DataFrame({"id": [fingerprint(x) for x in own], "s": [x.tobytes() for x in own]})

        found = docs.select(safe_id(), "text").join(small(wanted.select("doc_id"), wanted.count()), "doc_id", "left_semi").mapInPandas(sets, "id long, s binary")
        return found.groupBy("id").agg(F.first("s").alias("s"))

    listed = classes.select("id", "n", F.explode("prefix").alias("h"))
    parts = join_tiles(listed, classes.select("id", "n", "bits"), contents, share, lambda k, na, nb: enough(k, na, nb, share))
    whole = stored(homes.join(parts, "id"), "parts")
    least = whole.groupBy("component_id").agg(F.min("doc_id").alias("first"))
    known = homes.join(whole.join(least, "component_id").select("id", "first"), "id", "left").select(F.col("id").alias("f"), F.coalesce("first", "doc_id").alias("component_id"))
    out = signed.select("doc_id", "n", F.when((F.col("n") > 0) & (F.col("doc_id") != NO_ID), F.col("f")).alias("f")).join(known, "f", "left")
    return out.select("doc_id", "n", "f", F.when(F.col("doc_id") != NO_ID, F.coalesce("component_id", "doc_id")).alias("component_id"))


def groups(docs: DataFrame, share: tuple[int, int] = (4, 5), k: int = 5) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest linked doc_id, its own if none).

    Null and empty texts and texts of white space alone have no shingles and link with nothing. Repeated rows under one doc_id
    each give a row; rows without doc_id get no component and join nothing. An empty table gives none. Columns other than doc_id
    and text are not read. Texts are taken whole, whatever their length. Ties (equal sets, equal ids) need no order.
    """
    return _grouped(docs, share, k).select(real_id(), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, share: tuple[int, int] = (4, 5), k: int = 5) -> DataFrame:
    """The rows of docs whose doc_id is its group's smallest; same columns, whatever their names.

    Rows without doc_id, null and empty texts stay; so do repeated rows of the smallest doc_id. Of different texts under one
    doc_id each is judged by its own group. Texts are taken whole; an empty table stays empty.
    """
    rows = stored(_grouped(docs, share, k).select("doc_id", "f", (F.col("doc_id") != F.col("component_id")).alias("goes")), "judged")
    gone = rows.filter("goes").select("doc_id", "f").distinct()
    both = stored(gone.join(rows.filter("NOT goes").select("doc_id").distinct(), "doc_id"), "both")
    gone = stored(gone.join(both, ["doc_id", "f"], "left_anti").select("doc_id").distinct(), "gone")
    gone = small(gone, gone.count())
    out = docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
    if not both.take(1):
        return out

    @F.pandas_udf("long")
    def own(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(s) for s in shingle_sets(texts.to_list(), k)])

    f = f"f{uuid.uuid4().hex}"
    out = out.withColumn(f, own("text"))
    return out.join(both, (out["doc_id"] == both["doc_id"]) & (out[f] == both["f"]), "left_anti").drop(f)
