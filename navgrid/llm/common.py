"""Helpers of the operators: table access, text columns as byte arrays, and window hashes over them."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

CHUNK = 1 << 20  # bytes of text that are worked on at once inside a task


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the rows' offsets in them. Null counts as empty."""
    wide = pa.large_binary()
    column = pc.fill_null(column.cast(wide) if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
                          else column.cast(pa.large_string()).cast(wide), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, one row at least."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their differences over all bits. Works in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of any stretch of a byte array from one pass over it: a polynomial over random values per byte."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.values = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = rng.integers(1, 2**61, 1, dtype=np.uint64)[0] * np.uint64(8) + np.uint64(5)
        self.inverse = np.uint64(pow(int(self.base), -1, 2**64))
        self.powers = np.ones(1, np.uint64)

    def over(self, data: np.ndarray) -> "Rolling":
        n = len(data)
        if len(self.powers) <= n:
            self.powers, self.back = (np.multiply.accumulate(np.concatenate(
                [np.ones(1, np.uint64), np.full(max(n, CHUNK), x, np.uint64)])) for x in (self.base, self.inverse))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[:n], out=self.sums[1:])
        return self

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


# Bytes of a word in lower case: digits, letters and everything beyond ASCII. A-Z map to a-z, all else to 0.
WORD = np.zeros(256, np.uint8)
for _low, _high in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    WORD[_low:_high] = np.arange(_low, _high)
WORD[0x41:0x5B] = np.arange(0x61, 0x7B)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in `data` (0: no word byte), and the number of words before each row."""
    inside = data != 0
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_FACTORS = np.random.Generator(np.random.PCG64(77)).integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def grams(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes."""
    n = len(word) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += word[j:j + n] * _FACTORS[j]
    return mix(out)


def bounded(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows: the check before a broadcast."""
    return df.limit(rows + 1).count() <= rows
