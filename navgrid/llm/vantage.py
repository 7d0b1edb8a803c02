"""SimHash near-duplicates: fingerprints within a few bits, found exactly by vantage-point trees over Hamming distance.

Equal fingerprints count once. A tree from a bounded sample parts the distinct ones into shards: a node holds a vantage
point and a radius, what lies within goes left. By the triangle inequality a fingerprint has links beyond the radius only
if its distance is within the link radius of it, so only such fingerprints visit the other side, and only from left to
right, which finds each link once. In a shard's task the same splitting goes on over home and visiting fingerprints until
the sets are small, then all distances of home to home and home to visitor are taken.

A task returns one row per linked fingerprint, the smallest one it hangs together with there, never pairs; components of
these rows join the tasks' results. A shard with too many fingerprints for one task is dealt out as pairs of chunks.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from navgrid.llm.common import chunks, partitions, utf8
from navgrid.llm.graph import components
from navgrid.session import discard, materialise

RADIUS = 4
SAMPLE = 20_000  # fingerprints that the tree of shards is made from
SHARDS = 64  # least number of shards
HOME = 250_000  # fingerprints per shard from which more shards are made, as far as the sample tells them apart
CHUNK = 400_000  # fingerprints of one shard above which it is dealt out in pairs of chunks
SMALL = 1_024  # home fingerprints that are no longer split inside a task

_SIGNED = "doc_id long, n_shingles long, fp long"
_ROUTED = "shard int, fp long, home boolean"
_LINKED = "a long, b long"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLOCK = 1 << 16  # shingles whose bits are counted at once


def similar_fingerprints(documents: DataFrame, radius: int = RADIUS, shingle: int = 4) -> DataFrame:
    """Per document its SimHash and the component of documents it is linked with, directly or through others.

    Words are runs without ASCII white space, A-Z lower-cased; shingles are all runs of `shingle` words, repeats counted,
    joined by spaces (the whole sequence if there are fewer). A bit of the fingerprint is 1 if it is 1 in over half the
    shingles' XXH64 with seed 42. Two documents are linked if their fingerprints differ in at most `radius` bits.

    documents needs doc_id and text; further columns are ignored. Null and wordless texts have fingerprint 0, linked like
    any other. A component is named by its smallest doc_id, null ids left out (null if it has no other); rows with equal
    ids count on their own. Columns: doc_id, fingerprint (16 hex digits), component_id. An empty table gives no rows.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialise(texts.mapInArrow(lambda batches: _sign(batches, shingle), _SIGNED))
    classes = materialise(signed.groupBy("fp").agg(F.min("doc_id").alias("first")))
    edges = materialise(_linked(classes, radius))
    roots = components(edges)
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialise(rooted.join(names, "root").select("fp", "component_id"))
    out = materialise(signed.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))
    discard(signed, classes, edges, named)
    return out


def _sign(batches, size):
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        counts, prints = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for lo, hi in chunks(offsets):
            hashes, n = [], np.zeros(hi - lo, np.int64)
            for i in range(lo, hi):
                word = data[offsets[i]:offsets[i + 1]].tobytes().translate(_LOWER).split()  # splits at 0x20, 0x09-0x0D
                if not word:
                    continue
                text = b" ".join(word)
                end = np.cumsum(np.fromiter(map(len, word), np.int64, len(word)) + 1) - 1
                start = np.concatenate([[0], end[:-1] + 1])
                k = min(size, len(word))
                hashes.append(np.array([digest(text[a:b], 42) for a, b in zip(start[:len(word) - k + 1].tolist(), end[k - 1:].tolist())],
                                       np.uint64))
                n[i - lo] = len(word) - k + 1
            counts.append(n)
            prints.append(_majority(np.concatenate([np.empty(0, np.uint64), *hashes]), n))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(counts)), pa.array(np.concatenate(prints).view(np.int64))],
                                         names=["doc_id", "n_shingles", "fp"])


def _majority(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per text (n consecutive hashes each) the bits that over half of them have."""
    ones = np.zeros((len(n), 64), np.int64)
    text = np.repeat(np.arange(len(n)), n)
    for at in range(0, len(hashes), _BLOCK):
        of = text[at:at + _BLOCK]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        bits = np.unpackbits(hashes[at:at + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[of[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little")
    return packed.view("<u8").reshape(-1).astype(np.uint64)


# --- trees ---------------------------------------------------------------------------------------------------

def _far(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def _split(points: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """Vantage point and radius that part the points about evenly with the fewest near the border; None if none does."""
    best = None
    some = points[:: max(1, len(points) // 512)]
    for vantage in points[:: max(1, len(points) // 12)][:12]:
        far = _far(some, vantage)
        within = int(np.median(far))
        for level in (within - 1, within):
            share = float((far <= level).mean())
            if 0.1 <= share <= 0.9:
                border = float((np.abs(far - level) <= radius).mean()) + abs(share - 0.5)
                if best is None or border < best[0]:
                    best = border, vantage, level
    return best and (best[1], best[2])


def shard_tree(sample: np.ndarray, shards: int, radius: int) -> list[tuple[np.uint64, int, int, int]]:
    """Nodes (vantage, radius, left, right) of a tree over a sample; negative children are shards, -1 the first in order.

    The root is the last node; no node at all is one shard."""
    nodes, leaf = [], 0

    def grow(points: np.ndarray, wanted: int) -> int:
        nonlocal leaf
        split = _split(points, radius) if wanted > 1 and len(points) > 1 else None
        if split is None:
            leaf += 1
            return -leaf
        inside = _far(points, split[0]) <= split[1]
        left = grow(points[inside], wanted // 2)
        right = grow(points[~inside], wanted - wanted // 2)
        nodes.append((*split, left, right))
        return len(nodes) - 1

    grow(sample, shards)
    return nodes


def route(points: np.ndarray, nodes: list, radius: int):
    """(shard, indices, home): every point once at home, and as a visitor in the shards after it that its links may be in."""
    stack = [(len(nodes) - 1 if nodes else -1, np.arange(len(points)), np.ones(len(points), bool))]
    while stack:
        node, at, home = stack.pop()
        if not len(at):
            continue
        if node < 0:
            yield -node - 1, at, home
            continue
        vantage, level, left, right = nodes[node]
        far = _far(points[at], vantage)
        goes = np.where(home, far <= level, far <= level + radius)
        stack.append((left, at[goes], home[goes]))
        goes = far > level - radius
        stack.append((right, at[goes], (home & (far > level))[goes]))


class Roots:
    """Smallest member of each set of linked points, as links come in."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.of[a], self.of[b]
            open_ = x != y
            if not open_.any():
                return
            low, high = np.minimum(x, y)[open_], np.maximum(x, y)[open_]
            np.minimum.at(self.of, high, low)
            while (self.of[self.of] != self.of).any():
                self.of = self.of[self.of]
            a, b = low, high


def linked_roots(points: np.ndarray, home: np.ndarray, radius: int, among: bool = True) -> np.ndarray:
    """Per point (ascending) the smallest point it hangs together with by links of home points to home points (if `among`)
    and to visitors."""
    roots = Roots(len(points))
    stack = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while stack:
        own, visits = stack.pop()
        if not len(own) or len(own) + len(visits) < 2:
            continue
        split = _split(points[own], radius) if len(own) > SMALL else None
        if split is not None:
            far, met = _far(points[own], split[0]), _far(points[visits], split[0])
            left, right = far <= split[1], far > split[1]
            crossing = own[left & (far > split[1] - radius)] if among else own[:0]
            parts = [(own[left], visits[met <= split[1] + radius]),
                     (own[right], np.concatenate([visits[met > split[1] - radius], crossing]))]
            work = lambda a, b: len(a) * (len(a) / 2 + len(b))
            if sum(work(*p) for p in parts) < 0.9 * work(own, visits):
                stack += parts
                continue
        other = np.concatenate([own, visits]) if among else visits
        for at in range(0, len(own), 32):
            row = own[at:at + 32]
            for to in range(at if among else 0, len(other), 8192):
                column = other[to:to + 8192]
                i, j = np.nonzero(np.bitwise_count(points[row][:, None] ^ points[column][None, :]) <= radius)
                if len(i):
                    roots.link(row[i], column[j])
    return roots.of


def _linked(classes: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b), b < a as unsigned numbers, whose components are those of all links between distinct fingerprints."""
    spark = classes.sparkSession
    n = classes.count()
    drawn = classes.orderBy(F.xxhash64("fp"), "fp").select("fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    nodes = shard_tree(drawn, max(SHARDS, min(-(-n // HOME), SAMPLE // 16)), radius)
    routed = materialise(classes.select("fp").mapInArrow(lambda batches: _route(batches, nodes, radius), _ROUTED))
    sizes = routed.groupBy("shard").agg(F.ceil(F.count_if("home") / CHUNK).cast("int").alias("parts")).where("parts > 0")  # at most a row per shard of the sample's tree
    dealt = routed.join(F.broadcast(sizes), "shard").withColumn("own", F.when(F.col("home"), F.pmod(F.xxhash64("fp"), F.col("parts"))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("own", F.coalesce("own", "other"))
    tasks = dealt.select(
        "shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp",
        (F.col("home") & (F.col("own") <= F.col("other"))).alias("home"))
    grouped = tasks.repartition(max(partitions(spark), 2), "shard", "i", "j").groupBy("shard", "i", "j")
    return grouped.applyInPandas(lambda key, pdf: _search(key, pdf, radius), _LINKED)


def _route(batches, nodes, radius):
    for batch in batches:
        points = batch.column(0).to_numpy(zero_copy_only=False)
        for shard, at, home in route(points.view(np.uint64), nodes, radius):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int32)), pa.array(points[at]), pa.array(home)],
                                             names=["shard", "fp", "home"])


def _search(key, pdf, radius):
    points = pdf["fp"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(points)
    points, home = points[order], pdf["home"].to_numpy(bool)[order]
    root = points[linked_roots(points, home, radius, among=key[1] == key[2])]
    linked = root != points
    return pd.DataFrame({"a": points[linked].view(np.int64), "b": root[linked].view(np.int64)})
