"""Benchmark decontamination by winnowing.

A window is `window` consecutive words of an item; an item of fewer words is one window of its own size. The fingerprint
of a window is the smallest hash of its k-word grams. A text keeps the smallest gram hash of each of its windows, so a
shared window always leaves the same fingerprint on both sides. Fingerprints that meet are extended: the window around
them is compared word by word before its words count as hit.

The windows of the test set are sent to the tasks in blocks of a bounded number of rows; a larger test set takes more
passes over the texts. Texts are never shuffled.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from navgrid.llm.common import WORD, Rolling, chunks, grams, utf8, words
from navgrid.session import materialise

BLOCK_ROWS = 200_000  # windows of the test set held by a task at once
_FILTER = np.uint64((1 << 22) - 1)

_WINDOWS = "item_id string, size int, fingerprint long, window binary"
_HITS = "doc_id long, copy long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per document the words inside any occurrence of a window of the test set, and the items these come from.

    documents needs doc_id and text, benchmark item_id and text; further columns are ignored. Null and empty texts have
    no words and no hits; null or equal doc_ids are documents of their own; an item with a null id counts as item ''.
    An empty test set gives no hits, an empty document table no rows.
    Columns: doc_id, n_words, n_hit, items (sorted), spans (word ranges hit, disjoint and ascending).
    """
    texts = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("copy"), "text")
    found = [texts.mapInArrow(lambda batches, held=held: _scan(batches, held.value, window, k), _HITS)
             for held in _blocks(benchmark, window, k, block_rows)]
    out, blocks = found[0], len(found)
    if blocks > 1:
        for other in found[1:]:
            out = out.unionByName(other)
        # Rows with the same id and text have the same hits: joined here, and given back as often as they came.
        out = (out.groupBy("doc_id", "copy")
               .agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"),
                    F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
                    F.count(F.lit(1)).alias("rows"))
               .withColumn("row", F.explode(F.sequence(F.lit(1), (F.col("rows") / blocks).cast("int"))))
               .select("doc_id", "copy", "n_words", "spans", "items").mapInArrow(_merge, _HITS))
    return out.select("doc_id", "n_words", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)").alias("n_hit"),
                      F.array_sort("items").alias("items"), "spans")


def clean_texts(documents: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of documents, whole, of which no word is hit in contamination(); a pass per block, and no shuffle."""
    column = documents.columns.index("text")
    for held in _blocks(benchmark, window, k, block_rows):
        documents = documents.mapInArrow(lambda batches, held=held: _unhit(batches, held.value, window, k, column), documents.schema)
    return documents


def _blocks(benchmark, window, k, block_rows):
    """The test set's windows in broadcast blocks of about block_rows rows."""
    windows = materialise(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text")
                          .mapInArrow(lambda batches: _windows(batches, window, k), _WINDOWS).distinct())
    blocks = max(1, math.ceil(windows.count() / block_rows))
    for block in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("item_id", "window"), F.lit(blocks)) == block)
        yield benchmark.sparkSession.sparkContext.broadcast(_held(part.collect()))


def _unhit(batches, held, window, k, column):
    for batch in batches:
        one = pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64())] * 2 + [batch.column(column)], names=["a", "b", "text"])
        spans = next(_scan([one], held, window, k)).column(3)
        yield batch.filter(pc.equal(pc.list_value_length(spans), 0))


def _lower_words(column):
    data, offsets = utf8(column)
    for lo, hi in chunks(offsets):
        low = WORD[data[offsets[lo]:offsets[hi]]]
        starts, ends, first = words(low, offsets[lo:hi + 1] - offsets[lo])
        yield lo, hi, low, starts, ends, first


def _text(low, starts, ends, a, b):
    return b" ".join(low[i:j].tobytes() for i, j in zip(starts[a:b], ends[a:b]))


def _windows(batches, window, k):
    rolling = Rolling(5)
    for batch in batches:
        ids = batch.column(0).to_pylist()
        out = []
        for lo, hi, low, starts, ends, first in _lower_words(batch.column(1)):
            value = rolling.over(low).hash(starts, ends)
            for row in range(hi - lo):
                a, b = first[row], first[row + 1]
                size = int(min(window, b - a))
                if not size:
                    continue
                small = grams(value[a:b], min(k, size))
                for i in range(b - a - size + 1):
                    mark = small[i:i + size - min(k, size) + 1].min() if size == window else grams(value[a:b], size)[0]
                    out.append({"item_id": ids[lo + row], "size": size, "fingerprint": int(mark.view(np.int64)),
                                "window": _text(low, starts, ends, a + i, a + i + size)})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("item_id", pa.string()), ("size", pa.int32()),
                                                         ("fingerprint", pa.int64()), ("window", pa.binary())]))


def _held(rows):
    """By window size: sorted fingerprints, a filter over their low bits, and the items of each window."""
    sizes = {}
    for row in rows:
        marks, items = sizes.setdefault(row["size"], (set(), {}))
        marks.add(row["fingerprint"])
        items.setdefault(bytes(row["window"]), []).append(row["item_id"])
    out = {}
    for size, (marks, items) in sizes.items():
        marks = np.unique(np.array(sorted(marks), np.int64).view(np.uint64))
        likely = np.zeros(int(_FILTER) + 1, bool)
        likely[marks & _FILTER] = True
        out[size] = marks, likely, items
    return out


def _smallest(values, n):
    """Smallest of every n consecutive values."""
    out = values[:len(values) - n + 1].copy()
    for j in range(1, n):
        np.minimum(out, values[j:j + len(out)], out=out)
    return out


def _scan(batches, held, window, k):
    rolling = Rolling(5)
    for batch in batches:
        ids, copies = batch.column(0), batch.column(1)
        n_words, spans, items = [], [], []
        for lo, hi, low, starts, ends, first in _lower_words(batch.column(2)):
            value = rolling.over(low).hash(starts, ends)
            doc = np.repeat(np.arange(hi - lo), np.diff(first))
            hits = {}
            for size, (marks, likely, texts) in held.items():
                if size == window:
                    mark = grams(value, k)
                    mark = _smallest(mark, window - k + 1) if len(mark) > window - k else mark[:0]
                else:
                    mark = grams(value, size)
                at = np.flatnonzero(likely[mark & _FILTER])
                at = at[(doc[at] == doc[at + size - 1]) & np.isin(mark[at], marks)]
                for i in at.tolist():
                    of = texts.get(_text(low, starts, ends, i, i + size))
                    if of:
                        hit = hits.setdefault(int(doc[i]), ([], set()))
                        hit[0].append((i - int(first[doc[i]]), i - int(first[doc[i]]) + size))
                        hit[1].update(of)
            n_words += np.diff(first).tolist()
            for row in range(hi - lo):
                spans.append(_union(hits[row][0]) if row in hits else [])
                items.append(sorted(hits[row][1]) if row in hits else [])
        yield _hits(ids, copies, n_words, spans, items)


def _hits(ids, copies, n_words, spans, items):
    return pa.RecordBatch.from_arrays([ids, copies, pa.array(n_words, pa.int64()), pa.array(
        [[{"start": a, "end": b} for a, b in x] for x in spans],
        pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string()))],
        names=["doc_id", "copy", "n_words", "spans", "items"])


def _union(ranges):
    out = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _merge(batches):
    for batch in batches:
        by = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        spans = [_union((s["start"], s["end"]) for s in x) for x in by["spans"].to_pylist()]
        yield _hits(by["doc_id"], by["copy"], by["n_words"].to_pylist(), spans, by["items"].to_pylist())
