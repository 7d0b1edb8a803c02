"""Importance resampling towards a target distribution, over hashed runs of one and two words.

A feature's bucket is the CRC-32 of its bytes. CRC is linear: a byte contributes a value that depends only on the byte and
on its distance from the end of the feature, and the feature's length adds a constant. So contributions come from a table
by (distance, byte) and are combined by ``bitwise_xor.reduceat`` over the features' spans. A word's contributions serve its
own feature and, moved by the length of the next word, the pair of both. Spans longer than the table fold block by block.

Two passes over the texts: counts per bucket (one row per bucket and task, then sums), and weights per document. Ranks
come from one range sort of (doc_id, counts, score); nothing but the table of buckets reaches the driver.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from navgrid.llm.common import WORD, chunks, utf8, words
from navgrid.session import discard, materialise

BUCKETS = 10_000
LEAST_WORDS = 20  # documents with fewer words are not drawn
REACH = 128  # distances from the end that the table covers; longer spans fold

_COUNTS = "bucket int, n long"
_WEIGHTS = "doc_id long, n_words long, n_features long, weight long"


def _shifted(register: np.ndarray, times: int, table: np.ndarray) -> np.ndarray:
    for _ in range(times):
        register = table[register & 0xFF] ^ (register >> np.uint32(8))
    return register


class PositionTable:
    """CRC-32 of stretches of bytes from contributions by distance from the end."""

    def __init__(self, reach: int = REACH):
        byte = np.arange(256, dtype=np.uint32)
        first = byte.copy()
        for _ in range(8):  # the reflected polynomial of CRC-32
            first = np.where(first & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (first >> np.uint32(1))
        self.reach = reach
        self.table = np.empty((reach, 256), np.uint32)
        self.table[0] = first
        for distance in range(1, reach):
            self.table[distance] = _shifted(self.table[distance - 1], 1, first)
        # A register moved by a whole block, byte by byte of the register.
        self.block = [_shifted(byte << np.uint32(8 * k), reach, first).tolist() for k in range(4)]
        self.constant = np.array([zlib.crc32(bytes(n)) for n in range(2 * reach + 2)], np.uint32)

    def length_constant(self, length: np.ndarray) -> np.ndarray:
        """CRC-32 of so many zero bytes: what the length alone contributes."""
        out = self.constant[np.minimum(length, len(self.constant) - 1)]
        for i in np.flatnonzero(length >= len(self.constant)).tolist():
            out[i] = zlib.crc32(bytes(int(length[i])))
        return out

    def folded(self, data: np.ndarray) -> int:
        """Contributions of a span of any length, block by block from its start."""
        blocks = -(-len(data) // self.reach)
        padded = np.zeros(blocks * self.reach, np.uint8)  # leading zero bytes contribute nothing
        padded[len(padded) - len(data):] = data
        far = np.arange(self.reach - 1, -1, -1)
        register, (a, b, c, d) = 0, self.block
        for part in np.array_split(padded.reshape(blocks, self.reach), 1 + blocks // 4096):
            for x in np.bitwise_xor.reduce(self.table[far, part], axis=1).tolist():
                register = a[register & 255] ^ b[register >> 8 & 255] ^ c[register >> 16 & 255] ^ d[register >> 24] ^ x
        return register

    def features(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """CRC-32 of every word, and of every word with a space and the word after it (one less)."""
        n, length = len(starts), ends - starts
        if not n:
            return np.empty(0, np.uint32), np.empty(0, np.uint32)
        first = np.concatenate([[0], np.cumsum(length + 1)[:-1]])  # words, each followed by one space
        word = np.repeat(np.arange(n), length + 1)
        place = np.arange(len(word)) - first[word]
        to_end = length[word] - place  # 0 at the space
        space = to_end == 0
        byte = np.where(space, np.uint8(0x20), low[np.minimum(starts[word] + place, len(low) - 1)])
        own = self.table[np.clip(to_end - 1, 0, self.reach - 1), byte]
        own[space] = 0
        one = np.bitwise_xor.reduceat(own, first)
        for i in np.flatnonzero(length > self.reach).tolist():
            one[i] = self.folded(low[starts[i]:ends[i]])
        after = np.append(length[1:], 0)
        moved = self.table[np.minimum(to_end + after[word], self.reach - 1), byte]
        two = np.bitwise_xor.reduceat(moved, first)[:-1]
        for i in np.flatnonzero(length[:-1] + 1 + length[1:] > self.reach).tolist():
            pair = np.concatenate([low[starts[i]:ends[i]], [np.uint8(0x20)], low[starts[i + 1]:ends[i + 1]]])
            two[i] = np.uint32(self.folded(pair)) ^ one[i + 1]
        return (one ^ self.length_constant(length),
                two ^ one[1:] ^ self.length_constant(length[:-1] + 1 + length[1:]))


def importance(documents: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, buckets: int = BUCKETS,
               least_words: int = LEAST_WORDS) -> DataFrame:
    """Draw documents in proportion to how likely the target texts make their features: columns doc_id, n_features,
    weight, score, rank, one row per document.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased; features are all words and all pairs of
    neighbouring words, repeats counted. A bucket's gain is floor(1000 ln ratio) of its smoothed shares in `target` and in
    `documents`, a document's weight the floored mean of its gains. Score adds Gumbel noise from (seed, doc_id), so the
    highest scores are a sample without replacement. Of the documents with `least_words` words or more, `percent` percent
    (rounded down) have a rank; equal scores go by doc_id.

    documents needs doc_id and text, target text; further columns are ignored. A null or wordless text has weight 0. A null
    doc_id draws the noise of an empty id and comes first among equal scores; rows with equal ids are documents of their
    own, equal in noise. An empty target gives gains from the documents' counts alone, empty documents give no rows.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gain = _gains(_counts(texts.select("text"), buckets), _counts(target.select(F.col("text").cast("string")), buckets), buckets)
    scored = texts.mapInArrow(lambda batches: _weigh(batches, gain), _WEIGHTS)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    gumbel = F.floor(F.lit(-1000.0) * F.ln(-F.ln((noise.cast("double") + 0.5) / 4294967296.0)))
    scored = materialise(scored.withColumn("score", F.col("weight") + gumbel))
    drawn = scored.where(F.col("n_words") >= least_words).count() * percent // 100
    return _ranked(scored, F.col("n_words") >= least_words, drawn).select("doc_id", "n_features", "weight", "score", "rank")


def resampled(documents: DataFrame, target: DataFrame, **options) -> DataFrame:
    """documents, all columns, with only the drawn rows and their rank as __rank. Equal rows of one id are drawn together."""
    drawn = importance(documents, target, **options).where("rank is not null").groupBy(F.col("doc_id").alias("__id")).agg(
        F.min("rank").alias("__rank"))
    return documents.join(drawn, F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))).drop("__id")


def _ranked(scored: DataFrame, eligible, drawn: int) -> DataFrame:
    """Rank by one range sort: place inside the partition plus the rows of the partitions before it."""
    order = [F.desc("eligible"), F.desc("score"), F.asc_nulls_first("doc_id"), "n_features", "weight"]
    placed = materialise(scored.withColumn("eligible", eligible).orderBy(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("place", 33)
    sizes = placed.groupBy(part.alias("part")).count()  # one row per partition of the sort
    offsets = sizes.selectExpr("part", "sum(count) over (order by part) - count as before")
    position = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part")
    out = materialise(ranked.withColumn("rank", F.when(F.col("eligible") & (position <= drawn), position)))
    discard(scored, placed)
    return out


def _counts(texts: DataFrame, buckets: int) -> dict[int, int]:
    """Features per bucket: at most `buckets` rows leave a task, and as many reach the driver."""
    rows = texts.mapInArrow(lambda batches: _count(batches, buckets), _COUNTS).groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r["bucket"]: r["n"] for r in rows.collect()}


def _gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    all_source, all_target = sum(source.values()), sum(target.values())
    ratio = lambda b: (float((target.get(b, 0) + 1) * (all_source + buckets))
                       / float((source.get(b, 0) + 1) * (all_target + buckets)))
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], np.int64)


def _features(column: pa.Array, table: PositionTable):
    """Per range of rows: CRC of words and of pairs, which pairs lie inside one row, and words before each row."""
    data, offsets = utf8(column)
    for lo, hi in chunks(offsets):
        low = WORD[data[offsets[lo]:offsets[hi]]]
        starts, ends, before = words(low, offsets[lo:hi + 1] - offsets[lo])
        one, two = table.features(low, starts, ends)
        inside = np.ones(len(two), bool)
        edges = before[1:-1]
        inside[edges[(edges > 0) & (edges < len(one))] - 1] = False
        yield one, two, inside, before


def _count(batches, buckets):
    table, total = PositionTable(), np.zeros(buckets, np.int64)
    for batch in batches:
        for one, two, inside, _ in _features(batch.column(0), table):
            total += np.bincount(one % buckets, minlength=buckets) + np.bincount(two[inside] % buckets, minlength=buckets)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["bucket", "n"])


def _weigh(batches, gain):
    table, buckets = PositionTable(), len(gain)
    for batch in batches:
        out = [np.empty((0, 3), np.int64)]
        for one, two, inside, before in _features(batch.column(1), table):
            single = np.concatenate([[0], np.cumsum(gain[one % buckets])])
            double = np.concatenate([[0], np.cumsum(np.where(inside, gain[two % buckets], 0)), [0]])
            double[-1] = double[-2] if len(double) > 1 else 0
            n = np.diff(before)
            features = n + np.maximum(n - 1, 0)
            total = single[before[1:]] - single[before[:-1]] + double[before[1:]] - double[before[:-1]]
            out.append(np.stack([n, features, total // np.maximum(features, 1)], axis=1))
        n, features, weight = np.concatenate(out).T
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(features), pa.array(weight)],
                                         names=["doc_id", "n_words", "n_features", "weight"])
