"""Words, their hashes and rolling hashes, for code that runs on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Order of a document whose id is missing: after all others.
LAST_ID = 2**63 - 1

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def order_id(id_col: str) -> Column:
    """The id as a number that is never missing."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))


def text_hash(text_col: str) -> Column:
    """64 bits of the text; a missing text counts as an empty one."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """UTF-8 of each text of a batch, one at a time; a missing text is empty."""
    for value in batch.column(name).cast(pa.binary()):
        yield value.as_py() or b""


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX_1
    x ^= x >> np.uint64(27)
    x *= _MIX_2
    x ^= x >> np.uint64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)


class WordHashes(dict):
    """Hashes of words. What it remembers is dropped when it holds `limit` words."""

    def __init__(self, rewrite: Callable[[bytes], bytes] | None = None, limit: int = 400_000):
        super().__init__()
        self.rewrite, self.limit = rewrite, limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(self.rewrite(word) if self.rewrite else word)
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Rolling:
    """Polynomial hashes modulo 2**64 of all windows of a sequence of 64-bit numbers."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers), 4096)
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                table = np.full(n, base, np.uint64)
                table[0] = 1
                setattr(self, name, np.cumprod(table, dtype=np.uint64))

    def prefix(self, x: np.ndarray) -> np.ndarray:
        """Sums that `between` takes; one more than there are numbers."""
        self._grow(len(x) + 1)
        out = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * self.powers[: len(x)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of x[start:end]; the length is part of the hash."""
        raw = (prefix[end] - prefix[start]) * self.inverses[start]
        return mix(raw + (end - start).astype(np.uint64) * _ODD)

    def windows(self, x: np.ndarray, width: int, prefix: np.ndarray | None = None) -> np.ndarray:
        """Hashes of all windows of `width` numbers."""
        prefix = self.prefix(x) if prefix is None else prefix
        n = len(x) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((prefix[width:] - prefix[:-width]) * self.inverses[:n] + np.uint64(width * int(_ODD) % 2**64))


def list_array(lengths: list[int] | np.ndarray, values: pa.Array) -> pa.ListArray:
    """A list column from the lists' lengths and all their values."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
