"""Large sorted key sets that move as packed bytes: a chunk of documents asks, a shard of the key space answers.

A chunk sends each shard its distinct 64-bit keys in order, with numbers to each; a shard sees all chunks' keys of its range at
once and sends numbers back in the same order, so that keys move once and answers without them. Chunks are bounded and shards
grow in number with the input, so no task holds more at a larger size. Distinct keys are named by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of a shard, about.
SHARD_KEYS = 1_000_000


def planes(x: np.ndarray) -> bytes:
    """Numbers by byte planes, which compress well where high bytes are alike; their length goes ahead."""
    data = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unplanes(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def packed(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, "uint64"), dtype=np.uint64)


def shard_bits(keys: int) -> int:
    """Bits of a key that name its shard, for so many keys in all."""
    return max(0, (-(-keys // SHARD_KEYS) - 1).bit_length())


def requests(n: int, chunk: int, bits: int, keys: np.ndarray, *numbers: np.ndarray, width: int = 64) -> Iterator[tuple]:
    """Rows (n, shard, chunk, keys, numbers) of sorted keys of so many bits, one a shard that has any."""
    cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(width - bits)) if bits else []
    edges = [0, *cuts, len(keys)]
    for shard, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if a < b:
            yield n, shard, chunk, packed(keys[a:b]), [planes(x[a:b]) for x in numbers]


REQUEST = "n int, shard int, chunk long, keys binary, numbers array<binary>"


def answered(asked: DataFrame, dtypes: list[str], answer: Callable[..., tuple[list[np.ndarray], int]], ranks: int | None = None) -> DataFrame:
    """(n, shard, chunk, answers, total): `answer` takes n, all keys of a shard and their numbers, and gives numbers in the same
    order and one total, which stands on one row of the shard. Keys come in the order of their chunks; a kind n may have fewer
    numbers than others. `ranks`: which answers are numbers of the shard's keys in their order; these go as differences, and a
    column `ranked` has how many the shard has at most."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        keys = [unpacked(k) for k in rows["keys"]]
        edges = np.cumsum([0, *map(len, keys)])
        numbers = [np.concatenate([unplanes(x[i], t) for x in rows["numbers"]]) for i, t in enumerate(dtypes[: len(rows["numbers"].iloc[0])])]
        found, total = answer(int(rows["n"].iloc[0]), np.concatenate(keys), *numbers)
        out = rows[["n", "shard", "chunk"]].copy()
        out["answers"] = [[packed(x[a:b]) if i == ranks else planes(x[a:b]) for i, x in enumerate(found)] for a, b in zip(edges, edges[1:], strict=False)]
        out["total"] = [total] + [0] * (len(out) - 1)
        if ranks is not None:
            out["ranked"] = int(found[ranks].max()) + 1
        return out

    return asked.groupBy("n", "shard").applyInPandas(run, "n int, shard int, chunk long, answers array<binary>, total long" + (", ranked long" if ranks is not None else ""))


def rank_bits(found: DataFrame) -> int:
    """Bits that hold every rank in answers with ranks."""
    return max(1, ((found.agg(F.max("ranked")).first()[0] or 1) - 1).bit_length())


def by_chunk(found: DataFrame, name: str) -> DataFrame:
    """(chunk, name): a chunk's answers in the order of n and shard."""
    return found.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("n", "shard", "answers"))).alias(name))


def numbers_of(answers: list | None, n: int, at: int, dtype: str) -> np.ndarray:
    """All numbers that a chunk was given for its keys of kind n, in their order."""
    parts = [unplanes(a["answers"][at], dtype) for a in (answers if answers is not None else []) if a["n"] == n]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def ranks_of(answers: list | None, n: int, at: int, bits: int) -> np.ndarray:
    """All ranks that a chunk was given for its keys of kind n, with so many bits a rank and the shard ahead: as sorted as the keys."""
    parts = [unpacked(a["answers"][at]).astype("int64") + (a["shard"] << bits) for a in (answers if answers is not None else []) if a["n"] == n]
    return np.concatenate(parts) if parts else np.zeros(0, "int64")
