"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the number of byte n-grams (n = 1 to 3, ASCII lower-cased) that both have, over the root of
the product of their numbers of n-grams. Nystroem: some training texts are landmarks; with K the kernel among them, a
text's features are its kernel values with the landmarks times K^(-1/2). One-versus-rest kernel ridge regression on these
features gives a score per language. Presence is linear in the n-grams, so landmarks, K^(-1/2) and coefficients multiply
to one matrix of n-grams by languages, and texts are scored by products of batches of presence vectors with it.

Presence is kept as sorted sets and made dense only for stretches of n-grams (fitting) or few texts (scoring) at a time, so
memory does not grow with n-grams times landmarks.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from navgrid.llm.common import utf8

PER_LANGUAGE = 400  # training texts per language, about
LANDMARKS = 60  # landmarks per language
TEXTS_IN_ALL = 10_000  # shared out where there are over 25 languages, as are the landmarks
LANDMARKS_IN_ALL = 1_500
RIDGE = 1e-3
SHARPNESS = 8.0
UNKNOWN = "und"
BATCH = 256  # texts in a matrix product at most
DENSE = 1 << 22  # cells of a dense presence matrix
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_GRAMS = (1 << 24) + (1 << 16) + (1 << 8)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    codes: np.ndarray  # n-grams of the landmarks
    weights: np.ndarray  # n-grams by languages


def fit(documents: DataFrame, training: Column, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS,
        ridge: float = RIDGE) -> Model:
    """Model of every value of lang from a sample of the rows that `training` allows: about `per_language` texts of each
    language, chosen by a hash of doc_id. Only these texts' sets of n-grams reach the driver. With many languages
    TEXTS_IN_ALL and LANDMARKS_IN_ALL are shared out evenly; each language has one text and one landmark at least, so
    beyond that the driver's memory bounds their number, and a fit that exceeds it fails. Rows without text or lang are
    not used; without any usable row the model knows no language and every prediction is `und`."""
    rows = documents.where(training & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return Model([], np.empty(0, np.int64), np.empty((0, 0), np.float32))
    per_language = max(1, min(per_language, TEXTS_IN_ALL // len(counts)))
    landmarks = max(1, min(landmarks, LANDMARKS_IN_ALL // len(counts)))
    spark, kind = documents.sparkSession, documents.schema["lang"].dataType.simpleString()
    shares = spark.createDataFrame([(r["lang"], min(1.0, per_language / r["count"])) for r in counts], f"lang {kind}, __share double")
    draw = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)) / float(1 << 30)
    sets = "lang string, grams binary"
    sample = (rows.join(F.broadcast(shares), "lang").where(draw < F.col("__share")).select("lang", "text")
              .mapInArrow(_sets, sets).collect())
    missed = {r["lang"] for r in counts} - {r["lang"] for r in sample}
    if missed:  # by the draw: their text with the smallest hash
        left = rows.join(F.broadcast(spark.createDataFrame([(x,) for x in sorted(missed)], f"lang {kind}")), "lang")
        sample += (left.groupBy("lang").agg(F.min_by("text", F.struct(draw, "text")).alias("text")).select("lang", "text")
                   .mapInArrow(_sets, sets).collect())
    sample.sort(key=lambda r: (r["lang"], bytes(r["grams"])))
    sets = [np.frombuffer(r["grams"], np.int32) for r in sample]
    languages = sorted({r["lang"] for r in sample})
    number = {x: i for i, x in enumerate(languages)}
    known = np.array([number[r["lang"]] for r in sample])
    marks = np.concatenate([np.flatnonzero(known == c)[np.linspace(0, (known == c).sum() - 1, min(landmarks, (known == c).sum())).astype(int)]
                            for c in range(len(languages))])
    codes = np.unique(np.concatenate([sets[i] for i in marks]))
    roots = np.sqrt([len(s) for s in sets])
    kernel = _common(sets, [sets[i] for i in marks], codes) / roots[:, None] / roots[marks][None, :]
    values, vectors = np.linalg.eigh(kernel[marks])
    keep = values > 1e-6 * values[-1]
    whiten = (vectors[:, keep] / np.sqrt(values[keep])) @ vectors[:, keep].T
    features = kernel @ whiten
    ridge_matrix = features.T @ features + ridge * len(sets) * np.eye(len(marks))
    moments = features.T @ (known[:, None] == np.arange(len(languages)))
    of_marks = (whiten @ np.linalg.solve(ridge_matrix, moments)) / roots[marks][:, None]
    weights = np.empty((len(codes), len(languages)), np.float32)
    for lo, hi, mine in _stretches([sets[i] for i in marks], codes):
        weights[lo:hi] = mine.T @ of_marks
    return Model(languages, codes, weights)


def _stretches(sets, codes):
    """Ranges of n-grams (ascending codes) with the presence of these in every set."""
    width = max(1, DENSE // max(1, len(sets)))
    at = [np.searchsorted(codes, x) for x in sets]
    held = [a[codes[np.minimum(a, len(codes) - 1)] == x] for a, x in zip(at, sets)]
    doc, gram = np.repeat(np.arange(len(sets)), [len(x) for x in held]), np.concatenate(held)
    order = np.argsort(gram, kind="stable")
    doc, gram = doc[order], gram[order]
    for lo in range(0, len(codes), width):
        hi = min(lo + width, len(codes))
        a, b = np.searchsorted(gram, [lo, hi])
        mine = np.zeros((len(sets), hi - lo), np.float32)
        mine[doc[a:b], gram[a:b] - lo] = 1
        yield lo, hi, mine


def _common(sets, marks, codes):
    """Number of n-grams that each set has in common with each landmark, exactly, by the cheaper of two ways."""
    return _common_dense(sets, marks, codes) if len(codes) * len(marks) <= 16 * DENSE else _common_sparse(sets, marks, codes)


def _common_dense(sets, marks, codes):
    """By products of presence matrices, for few landmarks."""
    out = np.zeros((len(sets), len(marks)))
    place = np.full(_GRAMS, -1, np.int32)
    place[codes] = np.arange(len(codes))
    own = [np.sort(p[p >= 0]) for p in (place[x] for x in sets)]
    for lo, hi, mine in _stretches(marks, codes):
        for first in range(0, len(sets), BATCH):
            some = own[first:first + BATCH]
            x = np.zeros((len(some), hi - lo), np.float32)
            for i, p in enumerate(some):
                a, b = np.searchsorted(p, [lo, hi])
                x[i, p[a:b] - lo] = 1
            out[first:first + BATCH] += x @ mine.T
    return out


def _common_sparse(sets, marks, codes):
    """By the lists of landmarks that have an n-gram, for many landmarks with n-grams of their own."""
    gram = np.searchsorted(codes, np.concatenate(marks))
    mark = np.repeat(np.arange(len(marks), dtype=np.int32), [len(x) for x in marks])[np.argsort(gram, kind="stable")]
    begin = np.concatenate([[0], np.cumsum(np.bincount(gram, minlength=len(codes)))])
    out = np.zeros((len(sets), len(marks)))
    for i, x in enumerate(sets):
        at = np.searchsorted(codes, x)
        at = at[codes[np.minimum(at, len(codes) - 1)] == x]
        n = begin[at + 1] - begin[at]
        each = np.repeat(begin[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out[i] = np.bincount(mark[each], minlength=len(marks))
    return out


def languages(documents: DataFrame, model: Model) -> DataFrame:
    """documents with lang_pred and score: the language with the largest score and its softmax share among all.

    A text that is null or has no letter is `und` with score 0. documents needs text; its own columns of these two names
    are replaced, all others and all rows stay as they are.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)
    plain = documents.drop("lang_pred", "score")
    schema = plain.withColumn("lang_pred", F.lit("").cast("string")).withColumn("score", F.lit(0.0)).schema
    column = plain.columns.index("text")
    return plain.mapInArrow(lambda batches: _score(batches, held.value, column), schema)


def _codes(text: np.ndarray) -> np.ndarray:
    """Distinct n-grams of a text, ascending."""
    one = text.astype(np.int32)
    out = []
    if len(one) > 2:
        out.append(np.unique((one[:-2] << 16) | (one[1:-1] << 8) | one[2:]))
    if len(one) > 1:
        out.append(np.unique((one[:-1] << 8) | one[1:]) + (1 << 24))
    out.append(np.unique(text).astype(np.int32) + (1 << 24) + (1 << 16))
    return np.concatenate(out)


def _sets(batches):
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        data = _LOWER[data]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
            [_codes(data[a:b]).tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())], names=["lang", "grams"])


def _presence(sets, place, width):
    out = np.zeros((len(sets), width), np.float32)
    for i, codes in enumerate(sets):
        at = place[codes]
        out[i, at[at >= 0]] = 1
    return out


def _score(batches, model, column):
    place = np.full(_GRAMS, -1, np.int32)
    place[model.codes] = np.arange(len(model.codes))
    letters = np.zeros(256, bool)
    letters[0x61:0x7B] = True
    for batch in batches:
        data, offsets = utf8(batch.column(column))
        names, scores = [], []
        at_once = max(1, min(BATCH, DENSE // max(1, len(model.codes))))
        for lo in range(0, len(offsets) - 1, at_once):
            hi = min(lo + at_once, len(offsets) - 1)
            texts = [_LOWER[data[a:b]] for a, b in zip(offsets[lo:hi], offsets[lo + 1:hi + 1])]
            known = np.array([bool(len(model.languages)) and (letters[x].any() or any(map(str.isalpha, x.tobytes().decode("utf-8", "replace"))))
                              for x in texts])
            best, share = np.zeros(hi - lo, int), np.zeros(hi - lo)
            if known.any():
                sets = [_codes(x) for x, ok in zip(texts, known) if ok]
                x = _presence(sets, place, len(model.codes)) @ model.weights
                x = x / np.sqrt([len(s) for s in sets])[:, None] * SHARPNESS
                x = np.exp(x - x.max(axis=1, keepdims=True))
                best[known], share[known] = x.argmax(axis=1), x.max(axis=1) / x.sum(axis=1)
            names += [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)]
            scores.append(share)
        scores = np.concatenate(scores) if scores else np.empty(0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)],
                                         names=[*batch.schema.names, "lang_pred", "score"])
