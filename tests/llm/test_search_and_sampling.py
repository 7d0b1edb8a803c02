"""Ranked search, SimHash components and importance resampling against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from navgrid.llm import importance, maxscore, vantage
from test_text_operators import LOWER, SCHEMA, SENTENCE, TEXTS, documents, empty, multiset, prose, words  # noqa: F401

LONG = (90, " ".join(f"{prose(90, 2500)} w{i}" for i in range(90)) + " " + "q" * 3000)  # over one chunk of 1 MB
ITEMS = [(1, SENTENCE), (2, prose(1, 30) + " " + prose(1, 5)), (3, "nothing-here qqqq"), (4, None), (None, prose(4, 3)), (6, ""), (2, "é" * 150 + " fox")]


@pytest.fixture(scope="module")
def benchmark_items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(1))


def brute_ranking(texts, items, k):
    terms = [collections.Counter(words(t)) for _, t in texts]
    n_docs, n_terms = sum(bool(t) for t in terms), sum(t.total() for t in terms)
    df = collections.Counter(x for t in terms for x in t)
    out = []
    for key, text in items:
        scores = []
        for (doc, _), held in zip(texts, terms):
            m = 75 + 25 * held.total() * n_docs // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * held[x] // (1000 * held[x] + 12 * m))
                        for x, times in collections.Counter(words(text)).items() if held[x])
            if score:
                scores.append((-score, doc is not None, doc or 0, doc))
        out += [(key, rank, doc, -s) for rank, (s, *_, doc) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("k", [2, 20])
def test_ranked_search(spark, documents, empty, benchmark_items, monkeypatch, k):
    monkeypatch.setattr(maxscore, "ITEMS", 3)
    texts = [*TEXTS, LONG]
    every = documents.select("doc_id", "text", "score").unionByName(spark.createDataFrame([LONG], SCHEMA).withColumn("score", F.lit(0)))
    found = maxscore.ranked(every, benchmark_items, k).collect()
    assert multiset(map(tuple, found)) == multiset(brute_ranking(texts, ITEMS, k))
    assert maxscore.ranked(empty, benchmark_items).count() == 0
    assert maxscore.ranked(documents, benchmark_items.limit(0)).count() == 0
    assert maxscore.ranked(documents, spark.createDataFrame([("a", "fox")], "item_id string, text string")).schema["item_id"].dataType.typeName() == "string"


def test_ranked_search_with_many_blocks(spark):
    """Lists of many blocks, so that thresholds reject blocks: shards at once and in one task after another."""
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(f"t{int(x)}" for x in rng.zipf(1.3, 5 + i % 40) % 300)) for i in range(6000)]
    items = [(i, " ".join(f"t{int(x)}" for x in rng.integers(0, 60, 12))) for i in range(40)]
    frame = spark.createDataFrame(texts, SCHEMA)
    for parts in (1, 5):
        found = maxscore.ranked(frame.repartition(parts), spark.createDataFrame(items, "item_id long, text string"), 7).collect()
        assert multiset(map(tuple, found)) == multiset(brute_ranking(texts, items, 7))


def test_blocks_are_rejected_unopened():
    """Common terms whose bounds fall under the threshold are looked up for candidates only."""
    n = 20_000
    terms = [["the"] * (1 + i % 3) + (["rare"] * 5 if i % 1000 == 0 else []) + [f"f{i % 7}"] * 40 for i in range(n)]
    _, _, value, before = next(maxscore._hashed(maxscore.pa.array([" ".join(t) for t in terms], maxscore.pa.large_string()), 1 << 30))
    batch = maxscore._shard(maxscore.pa.array(range(n)), value, before)
    row = {name: batch.column(i)[0] for i, name in enumerate(batch.schema.names)}
    shard = maxscore.Shard(row, n, int(before[-1]))
    the, rare = (int(np.searchsorted(shard.terms, maxscore._asked([x])[0][0][0])) for x in ("the", "rare"))
    docs, scores = shard.best([(the, 1), (rare, 9000)], 10, 0)
    assert len(shard.open) < 30 < len(range(shard.first[the], shard.first[the + 1]))
    m = shard.m
    full = {d: 9000 * (10**9 * 5 // (5000 + 12 * int(m[d]))) + 10**9 * (1 + d % 3) // (1000 * (1 + d % 3) + 12 * int(m[d])) for d in range(0, n, 1000)}
    assert sorted(zip(scores.tolist(), docs.tolist()), reverse=True)[:10] == sorted(((s, d) for d, s in full.items()), reverse=True)[:10]


def simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius):
    of = list(range(len(prints)))
    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= radius and of[i] != of[j]:
                a, b = of[i], of[j]
                of = [b if z == a else z for z in of]
    return of


def test_simhash_components(spark, documents, empty):
    texts = [*TEXTS, LONG, (91, LONG[1] + " tail"), (92, " \t\n\x0b "), (93, "A b"), (94, "a  B")]
    every = documents.select("doc_id", "text", "node").unionByName(
        spark.createDataFrame(texts[len(TEXTS):], SCHEMA).withColumn("node", F.lit(0)))
    prints = [simhash(t) for _, t in texts]
    of = brute_components(prints, 4)
    expected = []
    for i, (k, _) in enumerate(texts):
        ids = [texts[j][0] for j in range(len(texts)) if of[j] == of[i] and texts[j][0] is not None]
        expected.append((k, f"{prints[i]:016x}", min(ids, default=None)))
    found = vantage.similar_fingerprints(every)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert multiset(map(tuple, found.collect())) == multiset(expected)
    assert vantage.similar_fingerprints(empty).count() == 0


def planted_points(seed, n=3000):
    """Far apart, near others at 1 to 6 bits, and one crowd around a point."""
    rng = np.random.default_rng(seed)
    far = rng.integers(0, 2**64, n, dtype=np.uint64)
    near = far[: n // 3].copy()
    for step in range(6):
        flip = np.uint64(1) << rng.integers(0, 64, len(near), dtype=np.uint64)
        near ^= np.where(rng.random(len(near)) < 0.7, flip, np.uint64(0))
    crowd = np.repeat(far[:1], n // 3)
    for step in range(3):
        crowd = crowd ^ (np.uint64(1) << rng.integers(0, 64, len(crowd), dtype=np.uint64))
    return np.unique(np.concatenate([far, near, crowd]))


def all_links(points, radius):
    roots = vantage.Roots(len(points))
    for i in range(len(points)):
        j = np.flatnonzero(np.bitwise_count(points ^ points[i]) <= radius)
        roots.link(np.full(len(j), i), j)
    return points[roots.of]


@pytest.mark.parametrize("settings", [{}, {"SMALL": 16}, {"SMALL": 16, "CHUNK": 100, "SHARDS": 5}])
def test_linked_fingerprints(spark, monkeypatch, settings):
    """Every link is found through shards, visitors, splits inside tasks and chunks of a shard."""
    for name, value in settings.items():
        monkeypatch.setattr(vantage, name, value)
    points = planted_points(len(settings))
    want = dict(zip(points.view(np.int64).tolist(), all_links(points, 4).view(np.int64).tolist()))
    frame = spark.createDataFrame([(x,) for x in want], "fp long").repartition(3)
    edges = vantage._linked(frame, 4).collect()
    at = {x: i for i, x in enumerate(points.view(np.int64).tolist())}
    roots = vantage.Roots(len(points))
    roots.link(np.array([at[e.a] for e in edges]), np.array([at[e.b] for e in edges]))
    assert {x: int(y) for x, y in zip(want, points[roots.of].view(np.int64))} == want


def test_position_table():
    table = importance.PositionTable(reach=32)
    text = ["a bc " + "d" * 31 + " " + "e" * 32 + " " + "f" * 33 + " x " + "g" * 70, None, "", "h" * 5000 + " é " + "i" * 15 + " " + "j" * 16, "k"]
    data, offsets = importance.utf8(importance.pa.array(text))
    low = importance.WORD[data]
    starts, ends, _ = importance.words(low, offsets)
    one, two = table.features(low, starts, ends)
    word = [low[a:b].tobytes() for a, b in zip(starts, ends)]
    assert one.tolist() == [zlib.crc32(w) for w in word]
    assert two.tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(word, word[1:])]
    assert [len(x) for x in table.features(low[:0], starts[:0], ends[:0])] == [0, 0]


def brute_importance(texts, target, percent=25, seed=7):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(x).encode()) % 10000 for x in [*zip(w), *zip(w, w[1:])]]
    source, wanted = collections.Counter(), collections.Counter()
    for _, t in texts:
        source.update(features(t))
    for _, t in target:
        wanted.update(features(t))
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (source.total() + 10000) / ((source[b] + 1) * (wanted.total() + 10000))))
    rows = []
    for k, t in texts:
        f = features(t)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    eligible = [i for i, (_, t) in enumerate(texts) if len(words(t)) >= 20]
    eligible.sort(key=lambda i: (-rows[i][3], rows[i][0] is not None, rows[i][0] or 0, rows[i][1], rows[i][2]))
    for rank, i in enumerate(eligible[:percent * len(eligible) // 100], 1):
        rows[i][4] = rank
    return list(map(tuple, rows))


@pytest.mark.parametrize("percent", [0, 60])
def test_importance(spark, documents, empty, benchmark_items, percent):
    texts = [*TEXTS, LONG]
    every = documents.select("doc_id", "text", "score", "n_chars").unionByName(
        spark.createDataFrame([LONG], SCHEMA).withColumns({"score": F.lit(0), "n_chars": F.lit(1)}))
    found = importance.importance(every, benchmark_items, percent)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert multiset(map(tuple, found.collect())) == multiset(brute_importance(texts, ITEMS, percent))
    assert importance.importance(empty, benchmark_items).count() == 0
    nothing = importance.importance(documents, benchmark_items.limit(0))
    assert multiset(map(tuple, nothing.collect())) == multiset(brute_importance(TEXTS, []))


def test_ranks_over_many_partitions(spark):
    """Ranks run on over the partitions of the sort, with ties in score."""
    rows = [(i, 30, 60, 5, i // 40) for i in range(4000)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(7)
    found = importance._ranked(scored, F.col("n_words") >= 20, 1500).collect()
    order = sorted(rows, key=lambda r: (-r[4], r[0]))
    assert {r.doc_id: r.rank for r in found} == {r[0]: (i if i <= 1500 else None) for i, r in enumerate(order, 1)}


def test_resampled_rows(spark, documents, benchmark_items):
    drawn = importance.resampled(documents, benchmark_items, percent=50)
    assert drawn.columns == [*documents.columns, "__rank"]
    want = {r[0] for r in brute_importance(TEXTS, ITEMS, 50) if r[4]}
    assert {r.doc_id for r in drawn.collect()} == want
