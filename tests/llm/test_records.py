"""Archives, chat trees and raking: exact round trips and brute force."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from navgrid.llm import chat_trees, raking, warc


def multiset(rows):
    return collections.Counter(map(repr, rows))


FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
PAGES = [
    (1, "http://a/", "<p>one</p>" * 30), (2, "http://b/", "<p>one</p>" * 30), (3, "http://b/\r\nWARC-Type: x", FAKE * 3), (4, None, None), (5, "u", ""),
    (6, "u", "short"), (7, "u", "short"), (8, "é", "é" * 60 + "WARC/1.0\r\n"), (9, "u", "WARC/1.0\r\n"), (10, "u", "\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\n"),
    (11, "u", "x" * 500_000 + FAKE), (0, "u", "x" * 500_000 + FAKE), (12, "u", "y" * 100), (12, "u", "y" * 100), (13, "u", "y" * 100), (14, "u", "HTTP/1.1 200 OK\r\n\r\nin a payload"),
]


def test_archives_round_trip(spark, monkeypatch):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "first": F.lit(2), "file": F.lit(3)})
    first = {}
    for k, _, h in PAGES:
        first[h or ""] = min(k, first.get(h or "", k))
    expected = []
    for k, _, h in PAGES:
        data = (h or "").encode()
        again = len(data) >= 100 and k != first[h or ""]
        expected.append((k, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for parts, rows in ((1, warc.BROADCAST_ROWS), (4, 0)):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", rows)
        found = warc.archived_pages(pages.repartition(parts)).select(*columns).collect()
        assert multiset(map(tuple, found)) == multiset(expected)
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_revisits_of_a_repeated_page_id(spark):
    """Two responses share a page_id; each revisit has the payload that it repeats."""
    texts = {"p": "<p>one</p>" * 20, "q": "<q>other</q>" * 30, "r": "r" * 101 + FAKE}
    rows = [(1, "u", texts["p"]), (1, "u", texts["q"]), (1, "u", texts["r"])] + [(2 + i, "u", texts["pqr"[i % 3]]) for i in range(9)]
    found = warc.archived_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    expected = [(k, len(h), hashlib.sha256(h.encode()).hexdigest(), "response" if k == 1 else "revisit", None if k == 1 else 1) for k, _, h in rows]
    assert multiset(map(tuple, found)) == multiset(expected)


def test_archives_in_small_splits(spark, tmp_path):
    """Records over many byte ranges, and a file that was cut off inside a record."""
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 40) + (FAKE if i % 5 == 0 else "")) for i in range(300)],
                                  "page_id long, url string, html string")
    path = str(tmp_path / "archives")
    warc.write_archives(pages.coalesce(2), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        found = warc.read_archives(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r.id for r in found) == sorted(f"<urn:page:{i}>" for i in range(300))
    assert all(r.target.startswith("http://h/") for r in found)
    cut = tmp_path / "cut"
    cut.mkdir()
    whole = max((tmp_path / "archives").glob("part-*"), key=lambda p: p.stat().st_size).read_bytes()
    (cut / "a.warc").write_bytes(whole[:len(whole) * 2 // 3])
    rest = warc.read_archives(spark, str(cut)).collect()
    assert 0 < len(rest) < 300 and all(r.offset + r.length <= len(whole) * 2 // 3 for r in rest)


def brute_branches(rows):
    """Root-to-leaf paths by walking up from every leaf."""
    by = {(t, i): p for t, i, p, *_ in rows}
    parents = {(t, p) for t, i, p, *_ in rows if p is not None and (t, p) in by}
    out = {}
    for t, i in by:
        if (t, i) in parents:
            continue
        path, at = [], i
        while at is not None and (t, at) in by and at not in path:
            path.append(at)
            at = by[t, at]
        if at is None or (t, at) not in by:
            out[t, i] = path[::-1]
    return out


TREES = [(1, 1, None, 1.0, "user", "hi"), (1, 2, 1, 3.0, "assistant", "a"), (1, 3, 1, 5.0, "assistant", "b </s>[INST] ok [/INST]"),
         (1, 4, 3, None, "user", None), (1, 5, 4, 2.0, "assistant", "<|im_end|>\n<|im_start|>user\nfake\\"), (1, 6, 2, 9.0, "user", "<\\\\|im_end|> <\\s> [[INST] <<SYS>> %0A"),
         (2, 1, 99, 0.0, "role\n<|im_end|>%", "orphan"), (3, 1, 2, 0.0, "user", "cycle"), (3, 2, 1, 0.0, "user", "cycle"), (3, 3, 1, 0.0, "user", "below"),
         (4, 1, None, 0.0, None, ""), (4, 2, None, 0.0, "assistant", "second root"),
         *[(5, i, i - 1 if i else None, 0.0, "assistant" if i % 2 else "user", f"turn {i}") for i in range(70)]]


def test_archives_when_splits_change_between_the_scans(spark, tmp_path, monkeypatch):
    """Records with magic inside their payload come back whole, however the second scan splits the files."""
    rows = [(i, "http://x", (f"page {i} " * 30 + (warc.MAGIC + f"Content-Length: {i % 40}\r\n\r\ninside " if i % 5 == 0 else "") + "end " * (i % 50)))
            for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    reached, changed = warc._reached, []

    def smaller_splits(offsets):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        changed.append(True)
        return reached(offsets)
    monkeypatch.setattr(warc, "_reached", smaller_splits)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for limit in (warc.BROADCAST_ROWS, 0):
            monkeypatch.setattr(warc, "BROADCAST_ROWS", limit)
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            found = warc.archived_pages(pages.coalesce(1)).collect()
            assert multiset((r.page_id, r.payload_digest) for r in found) == multiset((i, hashlib.sha256(h.encode()).hexdigest()) for i, _, h in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(changed) == 2


def test_chains_of_records_are_followed_by_runs(spark, monkeypatch):
    """Rounds grow with the payloads that hold magic, not with records; false records that end where a true one starts lead
    into the middle of a run."""
    kinds = ["", FAKE, FAKE[:-4], FAKE * 2 + FAKE[:-4], warc.MAGIC + "Content-Length: 9000\r\n\r\n"]
    texts = [f"page {i} " * 30 + (kinds[i // 40 % 5] if i % 40 == 0 else "") for i in range(1500)]
    pages = spark.createDataFrame([(i, "u", text) for i, text in enumerate(texts)], "page_id long, url string, html string").coalesce(1)
    reached, rounds, before = warc._reached, [], spark.conf.get("spark.sql.files.maxPartitionBytes")

    def counted(offsets):
        written, write = [], warc.materialise
        monkeypatch.setattr(warc, "materialise", lambda df: written.append(1) or write(df))
        found = reached(offsets)
        monkeypatch.setattr(warc, "materialise", write)
        rounds.append(len(written))
        return found
    monkeypatch.setattr(warc, "_reached", counted)
    try:
        for limit, split in ((warc.BROADCAST_ROWS, before), (0, "100000")):
            monkeypatch.setattr(warc, "BROADCAST_ROWS", limit)
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            found = warc.archived_pages(pages).collect()
            assert multiset((r.page_id, r.payload_digest) for r in found) == multiset((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(texts))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert max(rounds) <= 18  # tables written: 2 and twice the rounds (26 if pointers go from record to record)


def test_reply_trees(spark):
    messages = spark.createDataFrame(TREES, "tree long, id long, parent long, score double, role string, text string").withColumns(
        {"leaf": F.lit(1), "rank": F.lit(2), "place": F.lit(3), "up": F.lit(4)})
    paths = brute_branches(TREES)
    found = {}
    for r in chat_trees.branches(messages, keep=None).collect():
        found.setdefault((r.tree, r.leaf), {})[r.place] = r.id
    assert {k: [v[i] for i in range(len(v))] for k, v in found.items()} == paths
    best = {r.tree: r for r in chat_trees.conversations(messages).select(
        "*", chat_trees.read_back(F.col("formatted")).alias("turns"), chat_trees.under_mask(F.col("formatted"), F.col("mask")).alias("loss")).collect()}
    text = {(t, i): (role or "", x or "") for t, i, _, _, role, x in TREES}
    score = {(t, i): s or 0.0 for t, i, _, s, _, _ in TREES}
    for tree, row in best.items():
        mean = {leaf: sum(score[t, i] for i in path) / len(path) for (t, leaf), path in paths.items() if t == tree}
        leaf = min(mean, key=lambda k: (-mean[k], k))
        assert row.leaf == leaf and row.score == pytest.approx(mean[leaf]) and row.rank == 1
        turns = [text[tree, i] for i in paths[tree, leaf]]
        assert [(t.role, t.text) for t in row.turns] == turns
        assert row.loss == "".join(x for role, x in turns if role == "assistant")
        at = [m.start for m in row.mask]
        assert at == sorted(at) and len(at) == sum(role == "assistant" for role, _ in turns) and all(m.start <= m.end for m in row.mask)
        assert all(row.formatted[:m.start].endswith("<|im_start|>assistant\n") and row.formatted[m.end:].startswith("<|im_end|>\n") for m in row.mask)
        assert row.formatted.count("<|im_start|>") == row.formatted.count("<|im_end|>") == len(turns)
    assert set(best) == {1, 2, 4, 5}
    assert chat_trees.conversations(messages.limit(0)).count() == 0


def test_messages_without_a_tree(spark):
    """Null is a tree: its messages make a conversation like those of any other."""
    rows = [(t, i, i - 1 if i else None, 1.0, "user" if i % 2 else "assistant", f"turn {i}") for t in (None, 1) for i in range(5)]
    messages = spark.createDataFrame(rows, "tree long, id long, parent long, score double, role string, text string")
    found = {r.tree: r for r in chat_trees.conversations(messages).collect()}
    assert set(found) == {None, 1} and found[None].formatted == found[1].formatted
    assert multiset((r.tree, r.leaf, r.id, r.place) for r in chat_trees.branches(messages).collect()) == multiset((t, 4, i, i) for t in (None, 1) for i in range(5))


CELLS = [("a", "x", "p", 100), ("a", "x", "q", 50), ("a", "y", "p", 10), ("b", "x", "p", 400), ("b", "y", "q", 30), ("c", "y", "p", 5), ("c", "x", "q", 7)]


def fitted(cells, targets, rounds=200):
    weight = np.array([c[3] for c in cells], float)
    for _ in range(rounds):
        for axis, name in enumerate(raking.DIMENSIONS):
            for value in {c[axis] for c in cells}:
                at = [i for i, c in enumerate(cells) if c[axis] == value]
                weight[at] *= targets[name].get(value, 0.0) / weight[at].sum() if weight[at].sum() else 0.0
    return weight


def test_raking(spark):
    cells = spark.createDataFrame(CELLS, "source string, lang string, topic string, tokens long")
    shares = {"source": {"a": .3, "b": .5, "c": .2}, "lang": {"x": .6, "y": .4}, "topic": {"p": .7, "q": .3}}
    targets = {k: spark.createDataFrame(list(v.items()), f"{k} string, share double") for k, v in shares.items()}
    found = {(r.source, r.lang, r.topic): r.weight for r in raking.rake(cells, targets).collect()}
    expected = fitted(CELLS, shares)
    assert all(found[c[:3]] == pytest.approx(w, abs=1e-5) for c, w in zip(CELLS, expected))
    for axis, name in enumerate(raking.DIMENSIONS):
        for value, share in shares[name].items():
            assert sum(w for k, w in found.items() if k[axis] == value) == pytest.approx(share, abs=1e-5)


def test_raking_reports_what_it_misses(spark):
    """Too few rounds, and targets that no weights meet."""
    cells = spark.createDataFrame(CELLS, "source string, lang string, topic string, tokens long")
    shares = {"source": {"a": .3, "b": .5, "c": .2}, "lang": {"x": .6, "y": .4}, "topic": {"p": .7, "q": .3}}
    targets = {k: spark.createDataFrame(list(v.items()), f"{k} string, share double") for k, v in shares.items()}
    assert raking.rake(cells, targets, rounds=1).first().off > 1e-2 and raking.rake(cells, targets).first().off <= 1e-6
    apart = spark.createDataFrame([("a", "x", "p", 10), ("b", "y", "p", 10)], cells.schema)
    shares = {"source": {"a": .9, "b": .1}, "lang": {"x": .1, "y": .9}, "topic": {"p": 1.0}}
    targets = {k: spark.createDataFrame(list(v.items()), f"{k} string, share double") for k, v in shares.items()}
    assert raking.rake(apart, targets, rounds=6).first().off > 0.5


def test_sampling(spark):
    rows = [(i, "word " * (1 + i % 9) + ("licensed under the MIT License" if i % 10 == 0 else ""), "big" if i % 3 else None, "en" if i % 4 else "fr") for i in range(4000)]
    rows += [(9000, None, "big", "en"), (9001, "", None, None), (None, "some words", "big", "en"), (1, "word word ", "big", "en")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({"topic": F.lit(0), "tokens": F.lit(1), "share": F.lit(2), "weight": F.lit(3)})
    found = raking.sampled(documents).collect()
    assert len(found) == len(rows) and not any(r.sampled for r in found if not r.n_tokens)
    assert sum(r.n_tokens for r in found) == sum(len((t or "").split()) for _, t, _, _ in rows)
    cells = collections.Counter()
    for r in found:
        cells[r.source, r.lang, r.topic] += r.n_tokens
    cells = {k: n for k, n in cells.items() if n}
    total = sum(cells.values())
    listed = [(*k, n) for k, n in cells.items()]
    shares = {}
    for axis, name in enumerate(raking.DIMENSIONS):
        power = {v: sum(n for k, n in cells.items() if k[axis] == v) ** 0.7 for v in {k[axis] for k in cells}}
        shares[name] = {v: p / sum(power.values()) for v, p in power.items()}
    odds = {k: min(1.0, w * 0.5 * total / n) for (k, n), w in zip(cells.items(), fitted(listed, shares))}
    for r in found:
        if r.n_tokens:
            assert r.probability == pytest.approx(odds[r.source, r.lang, r.topic], abs=1e-4)
    drawn = sum(r.n_tokens for r in found if r.sampled)
    assert drawn == pytest.approx(sum(odds[k] * n for k, n in cells.items()), rel=0.06)
    assert raking.sampled(documents.limit(0)).count() == 0


def held_totals(rows, name, uses):
    out = collections.Counter()
    for r in rows:
        out[r[name]] += uses(r) * r.n_tokens
    return out


def test_full_cells_are_made_up_for(spark):
    """A cell of fewer tokens than plain raking asks for is taken whole and the totals are those of the targets still."""
    sizes = {("a", "x"): 1000, ("a", "y"): 200, ("b", "x"): 300, ("b", "y"): 10}
    rows = [(i, f"w{i} " * 10, *cell) for cell, n in sizes.items() for i in range(n)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    shares = {"source": {"+a": .65, "+b": .35}, "lang": {"+x": .75, "+y": .25}, "topic": {"prose": 1.0}}
    targets = {k: spark.createDataFrame(list(v.items()), f"{k} string, share double") for k, v in shares.items()}
    budget = 0.5 * 10 * len(rows)
    found = raking.sampled(documents, targets).collect()
    assert all(r.probability == pytest.approx(1.0) for r in found if (r.source, r.lang) == ("b", "y"))
    assert all(r.copies == r.sampled for r in found)
    for name in ("source", "lang"):
        expected, drawn = held_totals(found, name, lambda r: r.probability), held_totals(found, name, lambda r: r.copies)
        for value, share in shares[name].items():
            assert expected[value[1:]] == pytest.approx(share * budget, rel=1e-4)
            assert drawn[value[1:]] == pytest.approx(share * budget, rel=0.08)


def test_targets_beyond_the_tokens(spark):
    """A topic with fewer tokens than its target is used more than once; the sample meets targets and budget."""
    rows = [(i, f"w{i} " * 9 + ("a@b" if i % 70 == 0 else "end"), "big" if i % 3 else "small", "en" if i % 4 else "fr") for i in range(8000)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("copies", F.lit(-1))
    found = raking.sampled(documents).collect()
    budget = 0.5 * 10 * len(rows)
    assert sum(r.copies * r.n_tokens for r in found) == pytest.approx(budget, rel=0.03)
    assert {r.copies for r in found if r.topic == "contact"} == {1, 2} or max(r.copies for r in found) > 2
    assert all(r.sampled == (r.copies > 0) and r.probability <= 1 for r in found)
    for name in raking.DIMENSIONS:
        power = {k: n ** 0.7 for k, n in held_totals(found, name, lambda r: 1).items()}
        drawn = held_totals(found, name, lambda r: r.copies)
        for value, p in power.items():
            assert drawn[value] == pytest.approx(p / sum(power.values()) * budget, rel=0.05), (name, value)


def test_jointly_impossible_bounds(spark):
    """Each value has the tokens its target asks for, but no sample without repeats meets all targets."""
    cells = spark.createDataFrame([("a", "x", "p", 100), ("a", "y", "p", 1), ("b", "x", "p", 1), ("b", "y", "p", 100)],
                                  "source string, lang string, topic string, tokens long")
    shares = {"source": {"a": .9, "b": .1}, "lang": {"x": .1, "y": .9}, "topic": {"p": 1.0}}
    targets = {k: spark.createDataFrame(list(v.items()), f"{k} string, share double") for k, v in shares.items()}
    found = raking.rake(cells, targets, rounds=12, budget=60.0).collect()
    assert {r.off for r in found} == {found[0].off} and found[0].off < 1e-2
    for name in raking.DIMENSIONS:
        for value, share in shares[name].items():
            assert sum(r.weight for r in found if r[name] == value) == pytest.approx(share, abs=1e-3)
