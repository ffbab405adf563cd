"""Word rules shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
#: A-Z to a-z and nothing else.
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8: bytes.split() cuts at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class HashCache(dict):
    """Word -> XXH64; emptied when it holds ``most`` words, so memory stays bounded."""

    def __init__(self, seed: int = 0, most: int = 400_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolling(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Polynomial hash of every k consecutive values, modulo 2**64, mixed."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out = h[:n].copy()
    b = np.uint64(base)
    for j in range(1, k):
        out = out * b + h[j : j + n]
    return mix(out)


def cover(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """True at each of n positions that a length-k window from ``starts`` covers."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + k, n), -1)
    return np.cumsum(change[:-1]) > 0


def _holds_map(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_holds_map(f.dataType) for f in kind)
    return isinstance(kind, MapType) or isinstance(kind, ArrayType) and _holds_map(kind.elementType)


def hashable(df: DataFrame, *columns: str) -> list[Column]:
    """The columns, those that hold a map as JSON, since Spark hashes no maps."""
    return [F.to_json(F.struct(F.col(f"`{c}`").alias("c"))) if _holds_map(df.schema[c].dataType) else F.col(f"`{c}`") for c in columns]


#: Texts of one Arrow batch are handled in slices of about so many bytes, which bounds a task's memory.
SLICE_BYTES = 8 << 20


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts a batch into slices whose texts together have about SLICE_BYTES, one row at least."""
    lengths = np.cumsum(np.asarray(_byte_lengths(batch.column(column))))
    at = 0
    while at < batch.num_rows:
        done = lengths[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(lengths, done + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def _byte_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def map_texts(docs: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text") -> DataFrame:
    """``fn`` over bounded slices of every partition; no shuffle, each task keeps one slice in memory."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, column):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return docs.mapInArrow(run, schema)
