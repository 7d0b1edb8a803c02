"""N-gram Jaccard self-join: banded MinHash with exact verification.

Texts with the same words are one class of copies and go on as one text. Each of `trees` bands is a fixed prefix of
minimum hashes in one label; its length is the largest up to `max_depth` with which the bands find a pair at the
threshold with the target probability, the same for all data. There is no sorted forest of signatures. Texts that meet in a band hang on the smallest of them (no pairs are sent), the
components of these links are gathered with their shingle sets, and every pair of texts inside a component is compared
exactly, by products of incidence matrices. Components that are too large for one task are dealt out as pairs of
chunks; their texts get link counts and one edge each from every task, never a row per pair.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from navgrid.llm.common import WORD, Rolling, bounded, chunks, grams, partitions, utf8, words
from navgrid.llm.graph import components
from navgrid.session import discard, materialise

BROADCAST_ROWS = 500_000  # candidates up to which the texts are matched with them without a shuffle (about 50 MB)
CHUNK_TEXTS = 1_500
COLD = 16  # shingles of so few texts are expanded to pairs inside a task; more frequent ones are multiplied

_SIGNATURES = "doc_id long, copy long, n_shingles long, one long, two long, labels array<long>"
_SETS = "node string, root string, copies long, parts int, shingles binary"
_LINKS = "node string, links long, peer string"


def prefix_depth(threshold: float, trees: int, max_depth: int, recall: float) -> int:
    """Longest prefix with which a pair at the threshold meets in one of the trees with probability `recall`."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


def similar_texts(documents: DataFrame, threshold: float = 0.8, shingle: int = 5, trees: int = 20, max_depth: int = 8,
                  recall: float = 0.9999) -> DataFrame:
    """Per document the class of texts it is linked with and the number of documents it is linked to.

    Two documents are linked if the Jaccard similarity of their sets of `shingle` consecutive words (all words, if there
    are fewer) is `threshold` or more; words are runs of digits, letters and characters beyond ASCII, lower-cased. A
    class is a connected component, named by its smallest doc_id. documents needs doc_id and text; further columns are
    ignored. Texts without a word (null, empty) are linked to nothing and are classes of their own. Rows with equal text
    are copies and linked, also if their ids are equal or null; a null id in a class with others gets the class's name.
    Columns: doc_id, class_id, n_links, n_shingles. An empty table gives no rows.
    """
    signed, of_class = _classes(documents, threshold, shingle, trees, max_depth, recall)
    return (signed.select("doc_id", "node", "n_shingles").join(of_class.select("node", "class_id", "links"), "node", "left")
            .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
                    F.coalesce("links", F.lit(0)).alias("n_links"), "n_shingles"))


def one_of_each(documents: DataFrame, threshold: float = 0.8, shingle: int = 5, trees: int = 20, max_depth: int = 8,
                recall: float = 0.9999) -> DataFrame:
    """documents, all columns, with one row of each class of similar_texts(): that of the smallest doc_id (null first),
    then of the smallest hash of its text. Texts without a word all stay, but rows with equal id and text stay once.
    Column names that start with two underscores are reserved."""
    signed, of_class = _classes(documents, threshold, shingle, trees, max_depth, recall)
    chosen = of_class.groupBy("root").agg(F.min("of").alias("of")).select("of.doc_id", "of.copy")
    chosen = chosen.union(signed.where("node is null").select("doc_id", "copy")).distinct()
    chosen = materialise(chosen.select(F.col("doc_id").alias("__id"), F.col("copy").alias("__of")))
    hashed = documents.withColumn("__copy", F.xxhash64("text"))
    kept = hashed.join(chosen, hashed.doc_id.cast("long").eqNullSafe(F.col("__id")) & (F.col("__copy") == F.col("__of")), "left_semi")
    if signed.groupBy("doc_id", "copy").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "__copy"])
    return kept.drop("__copy")


def _classes(documents, threshold, shingle, trees, max_depth, recall):
    """Signatures of all rows, and per node (text with words): root, class_id, links, of (its first row)."""
    depth = prefix_depth(threshold, trees, max_depth, recall)
    texts = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("copy"), "text")
    signed = materialise(texts.mapInArrow(lambda batches: _sign(batches, shingle, trees, depth), _SIGNATURES)
                         .withColumn("node", F.when(F.col("n_shingles") > 0, F.concat(F.hex("one"), F.lit("."), F.hex("two")))))
    worded = signed.where("node is not null")
    classes = materialise(worded.groupBy("node").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"),
        F.min(F.struct("doc_id", "copy")).alias("of")))
    labels = worded.select("node", F.explode("labels").alias("label")).distinct()
    hubs = labels.groupBy("label").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    meeting = materialise(labels.join(hubs.select("label", "hub"), "label").select("node", "hub").distinct())
    candidates = materialise(components(_contracted(meeting)).join(classes, "node"))
    discard(meeting)
    links = materialise(_verified(texts, candidates, threshold, shingle))
    linked = components(links.where("peer is not null").select(F.col("node").alias("a"), F.col("peer").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    of_class = (classes.join(linked, "node", "left").join(counts, "node", "left")
                .select("node", F.coalesce("root", "node").alias("root"), "first_id", "of",
                        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    of_class = materialise(of_class)
    names = of_class.groupBy("root").agg(F.min("first_id").alias("class_id"))
    return signed, of_class.join(names, "root")


def _contracted(meeting: DataFrame) -> DataFrame:
    """Edges with the components of (node, hub): each node on its smallest hub, and that hub on the node's other ones.

    Texts that are alike meet in the same bands, so a group of n texts over 20 bands is n edges and a few between hubs."""
    first = meeting.groupBy("node").agg(F.min("hub").alias("first"))
    between = meeting.join(first, "node").where("hub <> first").select(F.col("first").alias("a"), F.col("hub").alias("b")).distinct()
    return first.select(F.col("node").alias("a"), F.col("first").alias("b")).union(between)


def _shingles(column, size):
    """Ranges of rows with the hashes of their shingles and the number of these before each row."""
    data, offsets = utf8(column)
    rolling = Rolling(31)
    for lo, hi in chunks(offsets):
        low = WORD[data[offsets[lo]:offsets[hi]]]
        starts, ends, first = words(low, offsets[lo:hi + 1] - offsets[lo])
        value = rolling.over(low).hash(starts, ends)
        count = np.diff(first)
        doc = np.repeat(np.arange(hi - lo), count)
        every = grams(value, size)
        every = every[doc[:len(every)] == doc[size - 1:]] if len(every) else every
        full = np.maximum(count - size + 1, 0)
        before = np.concatenate([[0], np.cumsum(full)])
        short = np.flatnonzero((count > 0) & (full == 0))
        if len(short):  # one shingle of all words
            every = np.insert(every, before[short], [grams(value[first[i]:first[i + 1]], int(count[i]))[0] for i in short])
            full[short] = 1
            before = np.concatenate([[0], np.cumsum(full)])
        yield lo, hi, value, first, every, before


def _sign(batches, size, trees, depth):
    rng = np.random.Generator(np.random.PCG64(41))
    turn, factor = rng.integers(1, 2**32, (2, trees * depth), dtype=np.uint32)
    factor |= np.uint32(1)
    spread = rng.integers(1, 2**62, 1 << 12, dtype=np.uint64)
    for batch in batches:
        counts, one, two, labels = [], [], [], []
        for lo, hi, value, first, every, before in _shingles(batch.column(2), size):
            some = np.flatnonzero(np.diff(before))
            counts.append(np.diff(before))
            # Two hashes of the whole sequence of words.
            place = np.arange(len(value)) - np.repeat(first[:-1], np.diff(first))
            for out, by in ((one, 0x9E3779B97F4A7C15), (two, 0xC2B2AE3D27D4EB4F)):
                x = value * ((place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(by) | np.uint64(1))
                x ^= x >> np.uint64(31)
                x *= np.uint64(by) ^ spread[7]
                total = np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
                out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
            high = (every >> np.uint64(32)).astype(np.uint32)
            label = np.zeros((hi - lo, trees), np.uint64)
            if len(some):
                for t in range(trees):
                    x = np.full(len(some), spread[t], np.uint64)
                    for j in range(t * depth, (t + 1) * depth):
                        least = np.minimum.reduceat((high ^ turn[j]) * factor[j], before[some])
                        x = (x ^ least.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                        x ^= x >> np.uint64(29)
                    label[some, t] = x
            labels.append(label)
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        labels = join(labels).reshape(-1).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(join(counts), pa.int64()), pa.array(join(one)), pa.array(join(two)),
             pa.ListArray.from_arrays(pa.array(np.arange(0, len(labels) + 1, trees), pa.int32()), pa.array(labels))],
            names=["doc_id", "copy", "n_shingles", "one", "two", "labels"])


def _verified(texts, candidates, threshold, size):
    """Per node and task: number of documents linked, and one linked node of its component (null: none)."""
    sizes = candidates.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / CHUNK_TEXTS).cast("int").alias("parts"))
    wanted = candidates.join(sizes, "root").select(F.col("of.doc_id").alias("of_id"), F.col("of.copy").alias("of_copy"), "node",
                                                   "root", "copies", "parts")
    if bounded(candidates, BROADCAST_ROWS):
        wanted = F.broadcast(wanted)
    sets = (texts.join(wanted, texts.doc_id.eqNullSafe(F.col("of_id")) & (F.col("copy") == F.col("of_copy")))
            .select("node", "root", "copies", "parts", "text").mapInArrow(lambda batches: _sets(batches, size), _SETS))
    bins = max(1, candidates.count() // 500)
    small = sets.where("parts = 1").select(
        F.concat(F.lit("s"), F.pmod(F.xxhash64("root"), F.lit(bins))).alias("task"), F.lit(0).alias("side"), *_SETS_COLUMNS)
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    large = (sets.where("parts > 1").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select(F.concat_ws(".", "root", F.least("own", "other"), F.greatest("own", "other")).alias("task"),
                     F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
                     *_SETS_COLUMNS))
    tasks = small.unionByName(large).repartition(max(partitions(texts.sparkSession), 2), "task")
    return tasks.groupBy("task").applyInPandas(lambda pdf: _compare(pdf, threshold), _LINKS)


_SETS_COLUMNS = ["node", "root", "copies", "shingles"]


def _sets(batches, size):
    for batch in batches:
        out = []
        for lo, hi, _, _, every, before in _shingles(batch.column(4), size):
            out += [np.unique(every[before[i]:before[i + 1]]).tobytes() for i in range(hi - lo)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())],
                                         names=["node", "root", "copies", "parts", "shingles"])


def _compare(pdf, threshold):
    """Pairs inside a component (side 0) or between the two chunks of one (sides 1 and 2)."""
    pdf = pdf.sort_values("node", ignore_index=True)
    pdf = pdf[~pdf["node"].duplicated()].reset_index(drop=True)
    sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
    n = len(sets)
    size = np.array([len(x) for x in sets])
    doc = np.repeat(np.arange(n), size)
    root = pd.factorize(pdf["root"])[0]
    shingle = np.concatenate(sets)
    order = np.lexsort((shingle, root[doc]))
    doc, shingle, of = doc[order], shingle[order], root[doc[order]]
    new = np.ones(len(doc), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (of[1:] != of[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(doc)))
    common = np.zeros((n, n), np.float32)
    for c in np.unique(count[(count > 1) & (count <= COLD)]).tolist():
        members = doc[start[count == c][:, None] + np.arange(c)]
        i, j = np.triu_indices(c, 1)
        for part in np.array_split(members, 1 + members.shape[0] * len(i) // 2_000_000):
            pairs, times = np.unique(part[:, i].ravel() * n + part[:, j].ravel(), return_counts=True)
            common.ravel()[pairs] += times
    common += common.T
    hot = np.flatnonzero(count > COLD)
    for part in np.array_split(hot, 1 + len(hot) // 2048) if len(hot) else []:
        rows = np.concatenate([doc[start[c]:start[c] + count[c]] for c in part])
        held, rows = np.unique(rows, return_inverse=True)
        one = np.zeros((len(held), len(part)), np.float32)
        one[rows, np.repeat(np.arange(len(part)), count[part])] = 1
        common[np.ix_(held, held)] += one @ one.T
    need = threshold / (1 + threshold) * (size[:, None] + size[None, :]) - 1e-6
    linked = (common >= need) & (root[:, None] == root[None, :])
    side = pdf["side"].to_numpy()
    linked &= (side[:, None] != side[None, :]) | (side == 0)[:, None]
    np.fill_diagonal(linked, False)
    links = linked @ pdf["copies"].to_numpy().astype(np.int64)
    # One edge to each text's first partner is not enough to span a component: take roots by rounds of smallest label.
    peer = np.arange(n)
    i, j = np.nonzero(linked)
    while True:
        closer = peer.copy()
        np.minimum.at(closer, i, peer[j])
        closer = closer[closer]
        if (closer == peer).all():
            break
        peer = closer
    nodes = pdf["node"].to_numpy()
    return pd.DataFrame({"node": nodes, "links": links, "peer": np.where(links > 0, nodes[peer], None)})
