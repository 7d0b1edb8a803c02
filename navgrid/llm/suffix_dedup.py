"""Dedup of repeated byte strings with a difference cover as filter and equal hashes in place of a suffix order.

A string of `length` bytes is repeated if it starts at two places. No suffixes are sorted, ranked or merged:

1. Sampled strings. Positions i of a text with i mod 133 in a cover of 12 residues are sampled: for any two positions
   there is a shift below 133 that takes both into the sample. The strings of length - 132 bytes at sampled positions
   are named by hashes, which are grouped in buckets.
2. Filter. If two places start the same string of `length` bytes, a shift below 133 leads both to sampled positions of
   the same name; so only positions at most 132 before a repeated name go on, sampled or not.
3. What goes on gets a hash of its whole `length` bytes; these are grouped in buckets and equal ones are marked.

Texts are packed into blocks. A block sends each name once, so a copy held by a third of all rows reaches a bucket once
per block, and what a bucket returns is one code per name in the order in which the block sent them. Names are compared
by 64 bits inside buckets that are chosen by an independent hash, so the chance of a false match does not grow with the
number of buckets. Copies of a whole text are found first and only one of them goes on.
"""

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from navgrid.llm.common import Rolling, chunks, partitions, utf8
from navgrid.session import shared_dir

PERIOD = 133
COVER = [0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109]  # every difference modulo 133 occurs between two of these
BLOCK = 16 << 20
BUCKET = 500_000  # names in a bucket, about

_BLOCKS = "block long, doc_ids array<long>, lengths array<long>, body binary, bytes long"
_NAMES = "bucket long, block long, names binary"
_CODES = "bucket long, block long, codes binary"
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def repeated_substrings(documents: DataFrame, length: int = 200, block_bytes: int = BLOCK,
                        bucket_names: int = BUCKET) -> DataFrame:
    """Per document the bytes covered by a string of `length` bytes that also starts anywhere else.

    documents needs doc_id and text; further columns are ignored. Null text is empty, an empty table gives no rows,
    repeated rows (also equal doc_ids, also null ones) are texts of their own. Texts shorter than `length` lose nothing.
    Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that stay), spans (byte ranges removed).
    """
    if length < PERIOD:
        raise ValueError(f"length must be {PERIOD} or more")
    spark = documents.sparkSession
    blocks = _bucketed(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
                       .mapInArrow(lambda batches: _pack(batches, block_bytes), _BLOCKS))
    size = blocks.agg(F.sum("bytes").alias("n")).first().n or 0
    buckets = max(1, round(size * len(COVER) / PERIOD / bucket_names))
    sampled = blocks.mapInArrow(lambda batches: _sampled(batches, length, buckets), _NAMES)
    spanning = _by_block(blocks, _repeated(sampled, buckets),
                         lambda block, codes: _surviving(block, codes, length, buckets), _NAMES)
    return _by_block(blocks, _repeated(spanning, 0), lambda block, codes: _cut(block, codes, length, buckets), _RESULT)


def _bucketed(blocks):
    """Written once, bucketed by block: neither of the two steps that come back to the texts shuffles them."""
    spark, name = blocks.sparkSession, f"navgrid_blocks_{uuid.uuid4().hex}"
    (blocks.write.bucketBy(2 * partitions(spark), "block").option("compression", "none")
     .option("path", f"{shared_dir(spark)}/navgrid/{name}").saveAsTable(name))
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files, which have a path of their own, stay
    return table


def _by_block(blocks, codes, work, schema):
    return blocks.groupBy("block").cogroup(codes.groupBy("block")).applyInPandas(work, schema)


def _pack(batches, limit):
    ids, sizes, body, size, seq = [], [], [], 0, 0
    part = TaskContext.get().partitionId()

    def flush():
        packed = zstandard.ZstdCompressor(level=3).compress(b"".join(body))
        return pa.RecordBatch.from_pydict(
            {"block": [(part << 24) + seq], "doc_ids": [ids], "lengths": [sizes], "body": [packed], "bytes": [size]},
            pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                       ("body", pa.binary()), ("bytes", pa.int64())]))

    for batch in batches:
        data, offsets = utf8(batch.column(1))
        rows = batch.column(0).to_pylist()
        for lo, hi in chunks(offsets):
            if size and size + offsets[hi] - offsets[lo] > limit:
                yield flush()
                ids, sizes, body, size, seq = [], [], [], 0, seq + 1
            ids += rows[lo:hi]
            sizes += np.diff(offsets[lo:hi + 1]).tolist()
            body.append(data[offsets[lo]:offsets[hi]].tobytes())
            size += int(offsets[hi] - offsets[lo])
    if ids:
        yield flush()


class _Names:
    """Strings of a block: name and bucket from two independent hashes, over ranges of texts at a time."""

    def __init__(self, body: bytes, lengths: np.ndarray):
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8) if body else np.empty(0, np.uint8)
        self.lengths = lengths
        self.offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.one, self.two = Rolling(11), Rolling(23)

    def ranges(self):
        for lo, hi in chunks(self.offsets):
            begin, end = self.offsets[lo], self.offsets[hi]
            self.one.over(self.data[begin:end])
            self.two.over(self.data[begin:end])
            yield lo, hi, begin, end

    def sample(self, lo, hi, n):
        """Sampled positions of these texts, from the start of the range."""
        size = self.lengths[lo:hi]
        start = self.offsets[lo:hi] - self.offsets[lo]
        rounds = (size + PERIOD - 1) // PERIOD
        first = np.repeat(start, rounds)
        step = np.arange(rounds.sum()) - np.repeat(np.cumsum(rounds) - rounds, rounds)
        at = (step * PERIOD)[:, None] + np.asarray(COVER)[None, :]
        ok = at + n <= np.repeat(size, rounds)[:, None]
        return (first[:, None] + at)[ok]

    def name(self, at, n, buckets):
        return self.one.hash(at, at + n), (self.two.hash(at, at + n) % np.uint64(buckets)).astype(np.int64)

    def texts(self, lo, hi, begin):
        start, end = self.offsets[lo:hi] - begin, self.offsets[lo + 1:hi + 1] - begin
        return self.one.hash(start, end), self.two.hash(start, end)


def _split(bucket):
    """Each bucket and the places of its names."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, edges) if len(order) else []:
        yield int(bucket[part[0]]), part


def _packets(block, names, bucket):
    """One row per bucket with its names in order, each name once."""
    for b, part in _split(bucket):
        yield {"bucket": b, "block": block, "names": np.unique(names[part]).tobytes()}


def _level_one(names: _Names, length, buckets):
    """Names of whole texts (buckets from `buckets` on) and of sampled strings, with their positions in the block."""
    n = length - PERIOD + 1
    at, value, bucket, text = [], [], [], []
    for lo, hi, begin, _ in names.ranges():
        p = names.sample(lo, hi, n)
        v, b = names.name(p, n, buckets)
        at.append(p + begin), value.append((v >> np.uint64(32)).astype(np.uint32)), bucket.append(b.astype(np.int32))
        one, two = names.texts(lo, hi, begin)
        text.append(np.stack([one, two]))
    return np.concatenate(at), np.concatenate(value), np.concatenate(bucket), np.concatenate(text, axis=1)


def _text_buckets(text, buckets):
    """Whole texts go to buckets of their own: the first half of the second hash chooses, both hashes name."""
    few = max(1, buckets // 64)
    return buckets + (text[1] % np.uint64(few)).astype(np.int64)


def _sampled(batches, length, buckets):
    for batch in batches:
        for row in batch.to_pylist():
            names = _Names(row["body"], np.asarray(row["lengths"], np.int64))
            _, value, bucket, text = _level_one(names, length, buckets)
            rows = list(_packets(row["block"], value, bucket))
            rows += list(_packets(row["block"], text[0], _text_buckets(text, buckets)))
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("names", pa.binary())]))


def _repeated(packets: DataFrame, short: int) -> DataFrame:
    """Per packet one code for each of its names: 0 in no other packet, 1 in others too and here first, 2 in others.

    Buckets below `short` hold 32-bit names (a filter only), negative ones what a block keeps for its next step."""
    def work(pdf):
        if pdf["bucket"].iloc[0] < 0:
            return pdf.rename(columns={"names": "codes"})
        kind = np.uint32 if pdf["bucket"].iloc[0] < short else np.uint64
        pdf = pdf.sort_values("block", ignore_index=True)
        parts = [np.frombuffer(x, kind) for x in pdf["names"]]
        sizes = np.array([len(x) for x in parts])
        every = np.concatenate(parts)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        same = ranked[1:] == ranked[:-1]
        codes = np.zeros(len(every), np.uint8)
        head = np.zeros(len(every), bool)
        head[:-1] = same
        tail = np.zeros(len(every), bool)
        tail[1:] = same
        codes[order[head]] = 1
        codes[order[tail]] = 2
        out = [zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in np.split(codes, np.cumsum(sizes)[:-1])]
        return pd.DataFrame({"bucket": pdf["bucket"], "block": pdf["block"], "codes": out})
    return packets.groupBy("bucket").applyInPandas(work, _CODES)


def _unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)


def _apply_codes(value, bucket, codes):
    """Code of each name; 1 at least where the block holds it more than once."""
    out = np.zeros(len(value), np.uint8)
    for b, part in _split(bucket):
        _, back, count = np.unique(value[part], return_inverse=True, return_counts=True)
        out[part] = np.maximum(codes[b][back], (count > 1)[back])
    return out


def _surviving(block: pd.DataFrame, found: pd.DataFrame, length, buckets) -> pd.DataFrame:
    """Names over the whole length for positions at most a period before a repeated name."""
    row = block.iloc[0]
    codes = {int(b): _unpack(c) for b, c in zip(found["bucket"], found["codes"])}
    names = _Names(row["body"], np.asarray(row["lengths"], np.int64))
    at, value, bucket, text = _level_one(names, length, buckets)
    repeated = _apply_codes(value, bucket, codes) > 0
    copies = _text_codes(text, codes, buckets)
    before = np.zeros(len(names.data) + 1, np.int32)  # repeated names before each position
    before[at[repeated] + 1] = 1
    np.cumsum(before, out=before)
    marks, out_value, out_bucket = [], [], []
    for lo, hi, begin, end in names.ranges():
        size = names.lengths[lo:hi]
        p = np.arange(begin, end)
        fits = p + length <= np.repeat(names.offsets[lo + 1:hi + 1], size)
        fits &= np.repeat(copies[lo:hi] < 2, size)
        p = p[fits]
        p = p[before[p + PERIOD] > before[p]]
        v, b = names.name(p - begin, length, buckets)
        mark = np.zeros(end - begin, bool)
        mark[p - begin] = True
        marks.append(mark), out_value.append(v), out_bucket.append(b)
    rows = list(_packets(row["block"], np.concatenate(out_value), np.concatenate(out_bucket)))
    state = zstandard.ZstdCompressor(level=3).compress(np.packbits(np.concatenate(marks)).tobytes())
    rows.append({"bucket": -1 - 2 * row["block"], "block": row["block"], "names": state})
    rows.append({"bucket": -2 - 2 * row["block"], "block": row["block"], "names": copies.tobytes()})
    return pd.DataFrame(rows, columns=["bucket", "block", "names"])


def _text_codes(text, codes, buckets):
    """0: only text of its kind, 1: first of its kind, 2: later copy."""
    bucket = _text_buckets(text, buckets)
    out = _apply_codes(text[0], bucket, codes)
    _, first = np.unique(text[0], return_index=True)
    later = np.ones(text.shape[1], bool)
    later[first] = False
    out[later] = 2
    return out


def _cut(block: pd.DataFrame, found: pd.DataFrame, length, buckets) -> pd.DataFrame:
    row = block.iloc[0]
    parts = {int(b): c for b, c in zip(found["bucket"], found["codes"])}
    names = _Names(row["body"], np.asarray(row["lengths"], np.int64))
    n = len(names.data)
    mark = np.unpackbits(_unpack(parts.pop(-1 - 2 * row["block"])), count=n).astype(bool)
    copies = np.frombuffer(parts.pop(-2 - 2 * row["block"]), np.uint8)
    codes = {b: _unpack(c) for b, c in parts.items()}
    places, value, bucket = [], [], []
    for lo, hi, begin, end in names.ranges():
        p = np.flatnonzero(mark[begin:end])
        v, b = names.name(p, length, buckets)
        places.append(p + begin), value.append(v), bucket.append(b)
    delta = np.zeros(n + 1, np.int32)
    places, value, bucket = (np.concatenate(x) for x in (places, value, bucket))
    hit = places[_apply_codes(value, bucket, codes) > 0]
    delta[hit] += 1
    delta[hit + length] -= 1
    gone = np.cumsum(delta[:n], dtype=np.int32) > 0
    gone |= np.repeat((copies > 0) & (names.lengths >= length), names.lengths)
    out = []
    for k, doc_id in enumerate(row["doc_ids"]):
        x = gone[names.offsets[k]:names.offsets[k + 1]]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], x.view(np.int8), [0]])))
        kept = names.data[names.offsets[k]:names.offsets[k + 1]][~x].tobytes()
        spans = [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]
        out.append((doc_id, len(x), int(x.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans))
    return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
