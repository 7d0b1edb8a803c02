"""Quality scores by voting of the nearest labelled texts in a latent-semantic space.

A text's terms are hashed byte trigrams, trigrams of character kinds (case, digits, spaces, kinds of punctuation), and
how often a word repeats the word one or two before. Roots of relative frequencies, weighted by inverse document
frequency, are projected on the leading singular vectors of the sample. The labelled vectors are broadcast (their
number is bounded); every text's cosines with all of them come from products of blocks, and the nearest vote with a
power of their cosine as weight.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from navgrid.llm.common import WORD, Rolling, chunks, utf8, words

PER_LABEL = 1_500  # labelled texts per label, about
DIMENSIONS = 64
NEIGHBOURS = 25
POWER = 8
_HASHED = 4096
_KINDS = np.full(256, 3, np.int64)  # other punctuation
_KINDS[0x61:0x7B], _KINDS[0x41:0x5B], _KINDS[0x30:0x3A] = 0, 1, 2
_KINDS[0x80:] = 4
for _at, _set in ((5, b" \t"), (6, b"\n\r"), (7, b".,;:"), (8, b"!?"), (9, b"#*$%&"), (10, b"|<>{}[]"), (11, b"'\"()-")):
    _KINDS[list(_set)] = _at
_N_KINDS = 12
_TERMS = _HASHED + _N_KINDS ** 3
_REPEATS = 3
_ROWS = 256  # texts whose terms are held densely at once
_FEATURES = "label int, terms binary"


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def fit(documents: DataFrame, labels: DataFrame, training: Column, per_label: int = PER_LABEL,
        dimensions: int = DIMENSIONS) -> Model:
    """Model from about `per_label` labelled documents of each label (0, 1), chosen by a hash of doc_id among the rows
    of labels (doc_id, label) that `training` allows. Only their term vectors reach the driver."""
    rows = labels.where(training & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("int"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    nothing = Model(np.ones(_TERMS, np.float32), np.zeros((_TERMS + _REPEATS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    if not counts:
        return nothing
    share = F.lit(0.0)
    for label, count in counts.items():
        share = F.when(F.col("label") == label, min(1.0, per_label / count)).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) < share)
    sample = (documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")
              .mapInArrow(_terms, _FEATURES).collect())
    if not sample:
        return nothing
    sample.sort(key=lambda r: (r["label"], bytes(r["terms"])))
    known = np.array([r["label"] for r in sample])
    x = np.stack([np.frombuffer(r["terms"], np.float32) for r in sample])
    idf = np.log((1 + len(x)) / (1 + (x[:, :_TERMS] > 0).sum(axis=0))).astype(np.float32) + 1
    x = _weighted(x, idf)
    rng = np.random.Generator(np.random.PCG64(3))
    dimensions = min(dimensions, len(x))
    base = rng.standard_normal((x.shape[1], dimensions + min(16, len(x)))).astype(np.float32)
    for _ in range(4):
        base, _ = np.linalg.qr(x.T @ (x @ base))
    _, _, turned = np.linalg.svd(x @ base, full_matrices=False)
    projection = (base @ turned.T[:, :dimensions]).astype(np.float32)
    return Model(idf, projection, _unit(x @ projection), known.astype(np.float64))


def scores(documents: DataFrame, model: Model, neighbours: int = NEIGHBOURS) -> DataFrame:
    """documents (doc_id, text; further columns are ignored) with a score from 0 to 1: doc_id, score. Null and empty
    texts have score 0; without labels every score is 0."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lambda batches: _vote(batches, held.value, neighbours), "doc_id long, score double")


def _counts(column):
    """Ranges of rows with their term frequencies (roots of relative frequencies) and shares of repeated words."""
    data, offsets = utf8(column)
    rolling = Rolling(17)
    for lo, hi in ((a, min(a + _ROWS, last)) for first, last in chunks(offsets) for a in range(first, last, _ROWS)):
        text = data[offsets[lo]:offsets[hi]]
        size = np.diff(offsets[lo:hi + 1])
        doc = np.repeat(np.arange(hi - lo), size)
        out = np.zeros((hi - lo, _TERMS + _REPEATS), np.float32)
        if len(text) > 2:
            inside = doc[2:] == doc[:-2]
            at = (doc[:-2] * _TERMS)[inside]
            kind = _KINDS[text]
            shape = ((kind[:-2] * _N_KINDS + kind[1:-1]) * _N_KINDS + kind[2:])[inside]
            code = text.astype(np.uint32)
            code = ((code[:-2] << np.uint32(16)) | (code[1:-1] << np.uint32(8)) | code[2:])[inside] * np.uint32(0x9E3779B1)
            count = np.bincount(at + _HASHED + shape, minlength=(hi - lo) * _TERMS)
            count += np.bincount(at + (code >> np.uint32(20)).astype(np.int64), minlength=(hi - lo) * _TERMS)
            out[:, :_TERMS] = np.sqrt(count.reshape(hi - lo, _TERMS) / np.maximum(size - 2, 1)[:, None])
        low = WORD[text]
        starts, ends, first = words(low, offsets[lo:hi + 1] - offsets[lo])
        value = rolling.over(low).hash(starts, ends)
        n = np.maximum(np.diff(first), 1)
        word_doc = np.repeat(np.arange(hi - lo), np.diff(first))
        for k in (1, 2):
            same = (value[k:] == value[:-k]) & (word_doc[k:] == word_doc[:-k])
            out[:, _TERMS + k] = np.sqrt(np.bincount(word_doc[k:][same], minlength=hi - lo) / n)
        out[:, _TERMS] = np.sqrt(np.maximum(0, 1 - out[:, _TERMS + 1] ** 2 - out[:, _TERMS + 2] ** 2))
        out[size == 0] = 0
        yield lo, hi, out


def _terms(batches):
    for batch in batches:
        out = [row.tobytes() for _, _, x in _counts(batch.column(1)) for row in x]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["label", "terms"])


def _weighted(x, idf):
    """Three groups of terms, each of unit length."""
    x = x.copy()
    x[:, :_TERMS] *= idf
    for a, b in ((0, _HASHED), (_HASHED, _TERMS), (_TERMS, _TERMS + _REPEATS)):
        x[:, a:b] = _unit(x[:, a:b])
    return x


def _unit(x):
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def _vote(batches, model, neighbours):
    for batch in batches:
        out = [np.zeros(0)]
        for lo, hi, x in _counts(batch.column(1)):
            score = np.zeros(hi - lo)
            some = x.any(axis=1)
            if len(model.vectors) and some.any():
                near = _unit(_weighted(x[some], model.idf) @ model.projection) @ model.vectors.T
                k = min(neighbours, near.shape[1])
                best = np.argpartition(-near, k - 1, axis=1)[:, :k]
                weight = np.maximum(np.take_along_axis(near, best, axis=1), 1e-6).astype(np.float64) ** POWER
                score[some] = (weight * model.labels[best]).sum(axis=1) / weight.sum(axis=1)
            out.append(np.clip(score, 0.0, 1.0))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], names=["doc_id", "score"])
