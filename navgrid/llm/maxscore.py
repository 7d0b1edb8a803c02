"""Ranked lexical search: an inverted index in shards of documents, searched by Block-Max MaxScore.

Index: tasks cut their texts into shards of a few MB. A shard is one row: document ids and lengths, the sorted hashes of
its terms, and per term a list of postings in blocks of 128, packed in bytes of the width that the block needs. A block
keeps its last document, its highest term count and its shortest document outside the packed data; the bound of its scores
follows from these two with the statistics of the whole corpus, which are known only after all shards are written.

Search: a query's lists in a shard are ordered by their highest bound. Lists are read whole while those left could bring a
new document among the best (the essential ones); what is left only adds to candidates. A candidate that cannot reach the
threshold with the bounds of the blocks it may be in is rejected before these are unpacked, and only blocks of surviving
candidates are. The threshold is the k-th best score of the task's shards so far. Tasks return their k best per query,
which are merged in two rounds, so no task of the merge grows with the number of shards.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from navgrid.llm.common import WORD, Rolling, chunks, utf8, words
from navgrid.session import discard, materialise

SHARD = 4 << 20  # bytes of text per shard; a longer text is a shard of its own
BLOCK = 128  # postings per block
ITEMS, ITEM_BYTES = 2_000, 16 << 20  # queries that are searched in one pass over the index
MERGE = 64  # parts of the first round of the merge

_INDEX = ("ids array<long>, lengths binary, n_docs long, n_terms long, terms binary, held binary, last binary, top binary, "
          "least binary, widths binary, data binary")


def build_index(documents: DataFrame) -> DataFrame:
    """Write the index of documents (doc_id, text; further columns are ignored) to the shared folder, a row per shard.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z lower-cased, known by a 64-bit hash. Null and
    wordless texts are in the index with no term. ``session.discard`` removes it."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(texts.mapInArrow(_build, _INDEX))


def search(index: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k best documents of every query row (item_id, text): item_id, rank, doc_id, score.

    With N documents that have a term, L all their terms with repeats, df the documents with a term, w = floor(1000
    ln((2N + 2) / (2 df + 1))), and m = 75 + 25 n N div L of a document with n terms, the score sums w (10^9 tf div (1000 tf +
    12 m)) over the query's terms, repeats included. Only scores above 0 count; equal scores go by doc_id (null first,
    then in any order). Query rows are ranked each on their own, also if ids are equal or null; a null or wordless query
    and an empty index give no rows. The driver holds one block of queries at a time (2,000 rows or 16 MB)."""
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    item = T.StructField("item_id", queries.schema["item_id"].dataType)
    schema = T.StructType([item, *T._parse_datatype_string("query long, doc_id long, score long").fields])
    found = []
    kind = to_arrow_type(item.dataType)
    for items, asked_texts in _blocks(queries.select("item_id", F.col("text").cast("string").alias("text"))) if n_terms else ():
        asked = _asked(asked_texts)
        distinct = np.unique(np.concatenate([t for t, _ in asked]))
        if not len(distinct):
            continue
        counted = index.select("terms", "held").mapInArrow(lambda batches: _document_counts(batches, distinct), "term long, df long")
        df = {r["term"]: r["df"] for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in distinct.view(np.int64).tolist()], np.int64)
        wanted = [(np.searchsorted(distinct, t), times) for t, times in asked]
        best = index.mapInArrow(lambda batches: _search(batches, pa.array(items, kind), distinct, weight, wanted, n_docs, n_terms, k), schema)
        first = Window.partitionBy("query", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE))).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        best = best.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        last = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        found.append(materialise(best.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
                                 .select("item_id", "rank", "doc_id", "score")))
    out = queries.sparkSession.createDataFrame([], T.StructType([item, *T._parse_datatype_string("rank int, doc_id long, score long").fields]))
    for part in found:
        out = out.unionByName(part)
    return out


def ranked(documents: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """search() in an index of documents that is removed afterwards."""
    index = build_index(documents)
    out = search(index, queries, k)
    discard(index)
    return out


def _blocks(queries: DataFrame):
    """Query rows as columns, so many at a time that a block has ITEMS rows or ITEM_BYTES characters at most (one row at least)."""
    items, texts, size = [], [], 0
    for row in queries.toLocalIterator():
        text = row["text"] or ""
        if texts and (len(texts) == ITEMS or size + len(text) > ITEM_BYTES):
            yield items, texts
            items, texts, size = [], [], 0
        items.append(row["item_id"])
        texts.append(text)
        size += len(text)
    if texts:
        yield items, texts


def _hashed(column: pa.Array, limit: int):
    data, offsets = utf8(column)
    rolling = Rolling(53)
    for lo, hi in chunks(offsets, limit):
        low = WORD[data[offsets[lo]:offsets[hi]]]
        starts, ends, before = words(low, offsets[lo:hi + 1] - offsets[lo])
        yield lo, hi, rolling.over(low).hash(starts, ends), before


def _asked(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct term hashes of each query with how often it has them."""
    out = []
    for _, _, value, before in _hashed(pa.array(texts, pa.large_string()), SHARD):
        out += [np.unique(value[a:b], return_counts=True) for a, b in zip(before[:-1], before[1:])]
    return out


# --- building ------------------------------------------------------------------------------------------------

def _build(batches):
    for batch in batches:
        for lo, hi, value, before in _hashed(batch.column(1), SHARD):
            yield _shard(batch.column(0).slice(lo, hi - lo), value, before)


def _shard(ids, value, before):
    length = np.diff(before)
    order = np.argsort(value, kind="stable")
    value, doc = value[order], np.repeat(np.arange(len(length)), length)[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(value)))
    value, doc = value[at], doc[at]
    head = np.ones(len(value), bool)
    head[1:] = value[1:] != value[:-1]
    lists = np.flatnonzero(head)
    held = np.diff(np.append(lists, len(value)))
    inside = np.arange(len(value)) - np.repeat(lists, held)
    delta = doc - np.where(head, -1, np.concatenate([[0], doc[:-1]]))
    blocks = np.flatnonzero(inside % BLOCK == 0)
    count = np.diff(np.append(blocks, len(value)))
    top = lambda x: np.maximum.reduceat(x, blocks) if len(blocks) else np.empty(0, np.int64)
    least = np.minimum.reduceat(length[doc], blocks) if len(blocks) else np.empty(0, np.int64)
    wide_delta, wide_tf = _width(top(delta)), _width(top(tf))
    size = count * (wide_delta + wide_tf)
    offset = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    place = np.arange(len(value)) - np.repeat(blocks, count)
    for x, wide, base in ((delta, wide_delta, offset), (tf, wide_tf, offset + count * wide_delta)):
        wide_of, to = np.repeat(wide, count), np.repeat(base, count) + place * np.repeat(wide, count)
        for byte in range(int(wide.max(initial=0))):
            has = wide_of > byte
            data[to[has] + byte] = (x[has] >> (8 * byte)) & 255
    binary = lambda x, kind: pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary())
    one = lambda x: pa.array([int(x)], pa.int64())
    return pa.RecordBatch.from_arrays([
        pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), binary(length, "<i4"), one((length > 0).sum()), one(length.sum()),
        binary(value[lists], "<u8"), binary(held, "<i4"), binary(doc[np.append(blocks, len(value))[1:] - 1], "<i4"),
        binary(top(tf), "<i4"), binary(least, "<i4"), binary(wide_delta * 16 + wide_tf, "u1"), binary(data, "u1")],
        names=[x.split()[0] for x in _INDEX.split(", ")])


def _width(x: np.ndarray) -> np.ndarray:
    return np.select([x < 1 << 8, x < 1 << 16], [1, 2], 4).astype(np.int64)


# --- searching -----------------------------------------------------------------------------------------------

def _document_counts(batches, distinct):
    total = np.zeros(len(distinct), np.int64)
    for batch in batches:
        for terms, held in zip(*(batch.column(i).to_pylist() for i in range(2))):
            at, found = _positions(np.frombuffer(terms, "<u8"), distinct)
            total[found] += np.frombuffer(held, "<i4")[at[found]]
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(distinct[some].view(np.int64)), pa.array(total[some])], names=["term", "df"])


def _positions(terms, distinct):
    at = np.minimum(np.searchsorted(terms, distinct), max(len(terms) - 1, 0))
    return at, terms[at] == distinct if len(terms) else np.zeros(len(distinct), bool)


class Shard:
    """One row of the index, with the bounds of its blocks and the blocks unpacked so far."""

    def __init__(self, row, n_docs, n_terms):
        read = lambda name, kind: np.frombuffer(row[name].as_buffer(), kind)
        self.length, self.terms, self.held = read("lengths", "<i4").astype(np.int64), read("terms", "<u8"), read("held", "<i4").astype(np.int64)
        self.last, self.top, self.least = (read(x, "<i4").astype(np.int64) for x in ("last", "top", "least"))
        self.widths, self.data = read("widths", "u1"), read("data", "u1")
        self.scale = n_docs, n_terms
        self.m = self.slope(self.length)
        blocks = -(-self.held // BLOCK)
        self.first = np.concatenate([[0], np.cumsum(blocks)])
        full = np.full(len(self.last), BLOCK)
        full[self.first[1:] - 1] = self.held - (blocks - 1) * BLOCK
        self.count = full
        size = full * (self.widths // 16 + self.widths % 16).astype(np.int64)
        self.offset = np.cumsum(size) - size
        self.share = _share(self.top, self.slope(self.least))  # bound of a block, for weight 1
        self.open = {}

    def slope(self, length):
        n_docs, n_terms = self.scale
        return 75 + 25 * length * n_docs // n_terms

    def block(self, term: int, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and their scores for weight 1."""
        if number not in self.open:
            n, at = int(self.count[number]), int(self.offset[number])
            wide = int(self.widths[number])
            delta = np.frombuffer(self.data, f"<u{wide // 16}", n, at)
            tf = np.frombuffer(self.data, f"<u{wide % 16}", n, at + n * (wide // 16)).astype(np.int64)
            docs = np.cumsum(delta, dtype=np.int64) + (self.last[number - 1] if number > self.first[term] else -1)
            self.open[number] = docs, _share(tf, self.m[docs])
        return self.open[number]

    def best(self, lists: list[tuple[int, int]], k: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (places in the shard) that may be among the k best of a query, with their scores. lists: term, weight."""
        bounds = [weight * int(self.share[self.first[t]:self.first[t + 1]].max()) for t, weight in lists]
        order = sorted(range(len(lists)), key=lambda i: -bounds[i])
        rest = np.cumsum([0, *(bounds[i] for i in reversed(order))])[::-1].tolist()  # of the lists from each on
        score, at = np.zeros(len(self.length), np.int64), 0
        kth = lambda x: int(np.partition(x, len(x) - k)[len(x) - k]) if len(x) >= k else 0
        while at < len(order) and rest[at] >= max(threshold, 1):  # essential: lists that may bring a new document
            term, weight = lists[order[at]]
            for number in range(self.first[term], self.first[term + 1]):
                docs, share = self.block(term, number)
                score[docs] += weight * share
            at += 1
            threshold = max(threshold, kth(score))
        found = np.flatnonzero((score > 0) & (score + rest[at] >= threshold))
        for i in range(at, len(order)):
            term, weight = lists[order[i]]
            lo, hi = int(self.first[term]), int(self.first[term + 1])
            number = lo + np.searchsorted(self.last[lo:hi], found)
            within = number < hi
            bound = np.where(within, weight * self.share[np.minimum(number, hi - 1)], 0)
            stays = score[found] + bound + rest[i + 1] >= threshold
            found, number, within = found[stays], number[stays], within[stays]
            for one in np.unique(number[within]).tolist():
                docs, share = self.block(term, one)
                mine = found[within & (number == one)]
                place = np.minimum(np.searchsorted(docs, mine), len(docs) - 1)
                held = docs[place] == mine
                score[mine[held]] += weight * share[place[held]]
            threshold = max(threshold, kth(score[found]))
        found = found[score[found] >= max(threshold, 1)]
        return found, score[found]


def _share(tf, m):
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _search(batches, items, distinct, weight, wanted, n_docs, n_terms, k):
    best = [(np.empty(0, object), np.empty(0, np.int64))] * len(wanted)
    for batch in batches:
        for r in range(batch.num_rows):
            row = {name: batch.column(i)[r] for i, name in enumerate(batch.schema.names)}
            shard, ids = Shard(row, n_docs, n_terms), np.array(row["ids"].as_py(), object)
            term, held = _positions(shard.terms, distinct)
            for q, (terms, times) in enumerate(wanted):
                has = held[terms]
                lists = list(zip(term[terms[has]].tolist(), (weight[terms[has]] * times[has]).tolist()))
                if not lists:
                    continue
                so_far, scores = best[q]
                found, score = shard.best(lists, k, int(scores[-1]) if len(scores) == k else 0)
                if len(found):
                    so_far, scores = np.concatenate([so_far, ids[found]]), np.concatenate([scores, score])
                    order = sorted(range(len(scores)), key=lambda i: (-scores[i], so_far[i] is not None, so_far[i] or 0))[:k]
                    best[q] = so_far[order], scores[order]
    query = np.repeat(np.arange(len(best)), [len(scores) for _, scores in best])
    docs, scores = (np.concatenate([x[i] for x in best]) for i in range(2))
    yield pa.RecordBatch.from_arrays([items.take(pa.array(query)), pa.array(query), pa.array(docs.tolist(), pa.int64()), pa.array(scores)],
                                     names=["item_id", "query", "doc_id", "score"])
