"""The operators on texts against brute force, with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from navgrid.llm import line_dedup, lsh_forest, neighbour_quality, string_kernel, suffix_dedup, winnowing
from navgrid.llm.host_rules import judged

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SENTENCE = "the quick brown fox jumps over the lazy dog while seven wizards brew tea in a tall stone tower near Größe "


def prose(seed, n):
    """n invented words; the same seed gives the same words."""
    return " ".join(hashlib.md5(f"{seed}/{i}".encode()).hexdigest()[:6] for i in range(n))


TEXTS = [
    (1, prose(1, 80)), (2, prose(1, 80)), (3, prose(1, 79) + " changed"), (4, prose(2, 40) + "\n" + prose(1, 60)), (5, None), (6, ""),
    (7, "é" * 150 + prose(3, 30)), (8, "é" * 150), (9, "ha " * 300), (10, prose(4, 3)), (10, prose(4, 3)), (None, prose(1, 80)),
    (None, None), (11, prose(5, 4000)), (12, prose(5, 4000)[500:20000]), (13, SENTENCE * 4), (14, "x\n" + SENTENCE + "\n" + SENTENCE + "\ny"),
    (15, "line one\n\n" + SENTENCE * 3 + "\ntail"), (16, "other\n" + SENTENCE * 3 + "\n\nend"), (17, "12 34 ### $$ %%"), (18, "a\nb\nc\n" * 30),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def documents(spark):
    extra = spark.createDataFrame(TEXTS, SCHEMA).repartition(3)
    return extra.withColumns({"lang": F.lit("en"), "source": F.when(F.col("doc_id") < 5, "a").otherwise("b"), "copy": F.lit(1),
                              "block": F.lit(2), "node": F.lit(3), "items": F.lit(4), "score": F.lit(5), "start": F.lit(6),
                              "n_chars": F.length("text").cast("long")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA + ", lang string, source string, n_chars long")


def multiset(rows):
    return collections.Counter(map(repr, rows))


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def test_repeated_substrings(documents, empty):
    texts = [(k, (t or "").encode()) for k, t in TEXTS]
    seen = collections.Counter(x[i:i + 200] for _, x in texts for i in range(len(x) - 199))
    expected = []
    for k, x in texts:
        gone = bytearray(len(x))
        for i in range(len(x) - 199):
            if seen[x[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(x, gone) if not g)
        spans = sum(1 for i in range(len(x)) if gone[i] and (not i or not gone[i - 1]))
        expected.append((k, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    for settings in ({}, {"block_bytes": 3000, "bucket_names": 200}):
        found = suffix_dedup.repeated_substrings(documents, **settings).drop("spans").collect()
        assert multiset(map(tuple, found)) == multiset(expected)
    assert suffix_dedup.repeated_substrings(empty).count() == 0


def test_cover_has_every_difference():
    cover, period = suffix_dedup.COVER, suffix_dedup.PERIOD
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("block_rows", [200_000, 7])
def test_contamination(spark, documents, empty, block_rows):
    items = [(1, SENTENCE), (2, prose(1, 30)), (3, "x 34"), (4, None), (None, prose(4, 3)), (6, " ".join(prose(1, 80).split()[20:35])), (2, prose(1, 30))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for k, t in items:
        w = words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add("" if k is None else str(k))
    expected = []
    for k, t in TEXTS:
        w, hit, of = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    of |= windows[tuple(w[i:i + n])]
        expected.append((k, len(w), len(hit), sorted(of)))
    found = winnowing.contamination(documents, benchmark, block_rows=block_rows).collect()
    assert multiset((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found) == multiset(expected)
    clean = winnowing.clean_texts(documents, benchmark, block_rows=block_rows)
    assert clean.columns == documents.columns
    assert multiset((r.doc_id, r.text) for r in clean.collect()) == multiset((k, t) for (k, t), e in zip(TEXTS, expected) if not e[2])
    assert winnowing.contamination(empty, benchmark).count() == 0
    assert winnowing.contamination(documents, benchmark.limit(0)).where("n_hit > 0").count() == 0


def jaccard_classes(texts, threshold=0.8):
    """Class and links per row by comparing all pairs."""
    sets = []
    for _, t in texts:
        w = words(t)
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = lambda a, b: a and b and len(a & b) >= threshold * len(a | b) - 1e-9
    links, of = [0] * len(texts), list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if near(sets[i], sets[j]):
            links[i] += 1
            links[j] += 1
            of = [of[i] if x == of[j] else x for x in of]
    names = []
    for i, (k, _) in enumerate(texts):
        ids = [texts[j][0] for j in range(len(texts)) if of[j] == of[i] and texts[j][0] is not None]
        names.append((k, min(ids) if ids else k, links[i]))
    return names, of


def test_similar_texts(documents, empty):
    expected, of = jaccard_classes(TEXTS)
    found = lsh_forest.similar_texts(documents).select("doc_id", "class_id", "n_links").collect()
    assert multiset(map(tuple, found)) == multiset(expected)
    kept = lsh_forest.one_of_each(documents)
    assert kept.columns == documents.columns
    worded = {c for c, (_, t) in zip(of, TEXTS) if words(t)}
    wordless = {(k, t) for k, t in TEXTS if not words(t)}
    assert kept.count() == len(worded) + len(wordless)
    assert lsh_forest.similar_texts(empty).count() == 0 and lsh_forest.one_of_each(empty).count() == 0


def test_similar_texts_in_chunks(spark, monkeypatch):
    """A class over many chunks: each text has a few words of its own, all are linked to all."""
    monkeypatch.setattr(lsh_forest, "CHUNK_TEXTS", 7)
    monkeypatch.setattr(lsh_forest, "BROADCAST_ROWS", 0)
    texts = [(i, prose(9, 200) + f" own{i}") for i in range(30)] + [(100 + i, prose(50 + i, 60)) for i in range(5)]
    found = lsh_forest.similar_texts(spark.createDataFrame(texts, SCHEMA)).select("doc_id", "class_id", "n_links").collect()
    assert multiset(map(tuple, found)) == multiset(jaccard_classes(texts)[0])


def test_prefix_is_shortened_to_the_recall():
    assert lsh_forest.prefix_depth(0.8, 20, 8, 0.9999) == 4 and lsh_forest.prefix_depth(0.8, 20, 8, 0.5) == 8


def line_runs(texts, least):
    """Lines left per text: every run of `least` words or more that starts at an earlier place is a later copy."""
    order = sorted({(k is not None, k or 0, t or "") for k, t in texts})
    lines = {}
    for key in order:
        every = key[2].split("\n")
        lines[key] = [(i, x) for i, x in enumerate(every) if re.search(r"[^\x20\x09-\x0D]", x)]
    count = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x))
    seen, gone = set(), collections.defaultdict(set)
    for key in order:
        for s in range(len(lines[key])):
            for e in range(s + 1, len(lines[key]) + 1):
                run = tuple(x for _, x in lines[key][s:e])
                if sum(map(count, run)) >= least:
                    if run in seen:
                        gone[key] |= {i for i, _ in lines[key][s:e]}
                    seen.add(run)
    out = []
    for k, t in texts:
        of = gone[(k is not None, k or 0, t or "")]
        every = (t or "").split("\n")
        out.append((k, None if t is None else "\n".join(x for i, x in enumerate(every) if i not in of), len(every), len(of)))
    return out


@pytest.mark.parametrize("least", [50, 20, 6])
def test_line_runs(documents, empty, least):
    texts = [x for x in TEXTS]
    found = line_dedup.without_repeated_runs(documents, least)
    assert found.columns == [*documents.columns, "n_lines", "n_removed"]
    assert multiset((r.doc_id, r.text, r.n_lines, r.n_removed) for r in found.collect()) == multiset(line_runs(texts, least))
    assert line_dedup.without_repeated_runs(empty, least).count() == 0


def test_line_runs_across_documents(spark):
    line = [prose(20 + i, 12) for i in range(9)]
    texts = [(1, "\n".join(line[:6])), (2, "\n".join([line[8], *line[1:6], line[7]])), (3, "\n".join(line[2:4])),
             (4, "\n".join([*line[1:6], "", *line[1:6]])), (5, "\n".join(line[0:6] + line[0:6]))]
    found = line_dedup.without_repeated_runs(spark.createDataFrame(texts, SCHEMA)).collect()
    assert multiset((r.doc_id, r.text, r.n_lines, r.n_removed) for r in found) == multiset(line_runs(texts, 50))


def test_host_rules(documents, empty):
    expected = []
    for k, t in TEXTS:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        twice = set()
        for i in range(len(w) - 7):
            if seen[tuple(w[i:i + 8])] > 1:
                twice |= set(range(i, i + 8))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected.append((k, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(twice),
                         len(w) < 20 or 100 * len(twice) > 30 * len(w)))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    found = judged(documents)
    assert multiset(map(tuple, found.select(*columns).collect())) == multiset(expected)
    assert not found.where("kept and base_failed").count()
    assert judged(empty).count() == 0


def test_a_host_of_failing_texts_is_rejected(spark):
    rows = [(i, prose(i, 30) + (" ##" * 20 if i < 40 else ""), "bad" if i < 45 else "good") for i in range(120)] + [(500, prose(500, 30), "tiny")]
    found = judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.source for r in found if r.kept} == {"good", "tiny"} and {r.source for r in found if not r.kept} == {"bad"}


def test_languages(spark, empty):
    letters = {"aa": "abcde", "bb": "vwxyz", "cc": "éèàùç"}
    rows = []
    for i in range(240):
        name = ("aa", "bb", "cc")[i % 3]
        digits = hashlib.md5(str(i).encode()).hexdigest() * 4
        rows.append((i, "".join(letters[name][int(c, 16) % 5] + (" " if int(c, 16) > 11 else "") for c in digits), name if i % 7 else None))
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 ...", "cc"), (1003, "Ω", None), (None, "abc dea", "aa")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(-1))
    model = string_kernel.fit(documents, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    found = {r.doc_id: r for r in string_kernel.languages(documents, model).collect()}
    assert len(found) == len(rows)
    assert all(found[i].lang_pred == ("aa", "bb", "cc")[i % 3] for i in range(240))
    assert [found[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and found[1003].lang_pred in letters and found[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in found.values())
    nothing = string_kernel.fit(empty, F.lit(True))
    assert string_kernel.languages(empty, model).count() == 0
    assert {r.lang_pred for r in string_kernel.languages(documents, nothing).collect()} == {"und"}


def test_every_language_is_learned(spark, monkeypatch):
    """Over 1,000 values of lang, and languages of which the draw takes no text."""
    word = lambda k: chr(0x4E00 + k) + chr(0x5E00 + 7 * k % 5000)
    rows = [(k, f"{word(k)} {word(k)}", f"l{k}") for k in range(1100)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = string_kernel.fit(documents, F.lit(True))
    assert set(model.languages) == {x for *_, x in rows}
    found = {r.doc_id: r.lang_pred for r in string_kernel.languages(documents, model).collect()}
    assert sum(found[k] == x for k, _, x in rows) > 1000
    monkeypatch.setattr(string_kernel, "TEXTS_IN_ALL", 3)
    monkeypatch.setattr(string_kernel, "LANDMARKS_IN_ALL", 3)
    many = spark.createDataFrame([(100 * k + i, f"{word(k)} {word(k)} {i}", f"l{k}") for k in range(30) for i in range(20)], documents.schema)
    model = string_kernel.fit(many, F.lit(True))
    assert set(model.languages) == {f"l{k}" for k in range(30)}
    assert all(r.lang_pred == f"l{r.doc_id // 100}" for r in string_kernel.languages(many, model).collect())


def test_neighbour_quality(spark, empty):
    rows = [(i, prose(i, 60) if i % 2 else "!! ".join(prose(i, 60).upper().split()), i % 2) for i in range(200)]
    rows += [(1000, None, 1), (1001, "", 0), (None, "x", 1)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = neighbour_quality.fit(documents, documents.select("doc_id", "label"), F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    found = {r.doc_id: r.score for r in neighbour_quality.scores(documents, model).collect()}
    assert len(found) == len(rows) and all(0 <= x <= 1 for x in found.values())
    assert all((found[i] >= 0.7) == bool(i % 2) for i in range(200)) and found[1000] == found[1001] == 0
    nothing = neighbour_quality.fit(documents, documents.select("doc_id", "label").limit(0), F.lit(True))
    assert {r.score for r in neighbour_quality.scores(documents, nothing).collect()} == {0.0}
    assert neighbour_quality.scores(empty, model).count() == 0


def plain_terms(text):
    """Term vector of a text, one byte and one word after the other."""
    q, data, w = neighbour_quality, (text or "").encode(), words(text)
    x = np.zeros(q._TERMS + 3)
    for i in range(len(data) - 2):
        code = ((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 0x9E3779B1) & 0xFFFFFFFF
        x[code >> 20] += 1
        a, b, c = (int(q._KINDS[v]) for v in data[i:i + 3])
        x[q._HASHED + (a * 12 + b) * 12 + c] += 1
    x = np.sqrt(x / max(len(data) - 2, 1))
    share = [sum(w[i] == w[i - k] for i in range(k, len(w))) / max(len(w), 1) for k in (1, 2)]
    x[q._TERMS:] = np.sqrt([max(0.0, 1 - sum(share)), *share]) if data else 0
    return x


def test_quality_is_the_vote_of_the_nearest(spark):
    """Scores against plain cosines with every labelled vector; a text over one chunk and a clashing column."""
    q = neighbour_quality
    rows = [(i, prose(i, 20 + i % 50) if i % 2 else "! ".join(prose(i, 30).upper().split()) + " the the", i % 2) for i in range(90)]
    rows += [(200, None, 1), (201, "", 0), (202, "x", None), (203, "ab ab ab ab", None), (204, prose(7, 180_000), None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, label int").withColumns({"score": F.lit("a"), "terms": F.lit(1)})
    model = q.fit(documents, documents.select("doc_id", "label"), F.col("doc_id") % 4 != 2)
    assert len(model.vectors) == sum(1 for i, t, label in rows if label is not None and i % 4 != 2)
    found = {r.doc_id: r.score for r in q.scores(documents, model).collect()}
    groups = ((0, q._HASHED), (q._HASHED, q._TERMS), (q._TERMS, q._TERMS + 3))
    for i, t, _ in rows[:-1]:
        x = plain_terms(t)
        if not x.any():
            assert found[i] == 0
            continue
        x[:q._TERMS] *= model.idf
        for a, b in groups:
            x[a:b] /= max(np.linalg.norm(x[a:b]), 1e-12)
        v = x @ model.projection
        near = model.vectors @ (v / max(np.linalg.norm(v), 1e-12))
        best = np.argsort(-near)[:q.NEIGHBOURS]
        weight = np.maximum(near[best], 1e-6) ** q.POWER
        assert found[i] == pytest.approx((weight * model.labels[best]).sum() / weight.sum(), abs=2e-3)
    assert 0 <= found[204] <= 1


def test_rows_of_terms_are_bounded():
    """Many short texts are made dense a few at a time."""
    column = neighbour_quality.pa.array([f"text {i}" for i in range(5000)])
    sizes = [x.shape[0] for _, _, x in neighbour_quality._counts(column)]
    assert sum(sizes) == 5000 and max(sizes) <= neighbour_quality._ROWS


def presence(text):
    data = text.encode().lower()
    return {data[i:i + n] for n in (1, 2, 3) for i in range(len(data) - n + 1)}


@pytest.mark.parametrize("dense", [1 << 22, 3000])
def test_language_scores_are_kernel_ridge_regression(spark, monkeypatch, dense):
    """With every training text a landmark, scores are those of ridge regression on the whole kernel matrix."""
    monkeypatch.setattr(string_kernel, "DENSE", dense)
    rows = [(i, prose(i, 8 + i % 9).translate(str.maketrans("0123456789abcdef", letters)), name)
            for i, (name, letters) in enumerate(itertools.islice(itertools.cycle(
                [("aa", "eariotnslcudpmhg"), ("bb", "eaüötnslßudpmhgz"), ("cc", "eçrêotnslcùdpmàé")]), 75))]
    rows += [(500, "ein", None), (501, prose(3, 180_000), None), (502, "3", None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("a"), "lang_pred": F.lit(1), "grams": F.lit(1)})
    training = [(t, lang) for i, t, lang in rows if lang and i % 5]
    model = string_kernel.fit(documents, F.col("doc_id") % 5 != 0, landmarks=1000)
    known, names = [presence(t) for t, _ in training], sorted({lang for _, lang in training})
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    gram = np.array([[kernel(a, b) for b in known] for a in known])
    of = np.linalg.solve(gram + string_kernel.RIDGE * len(known) * np.eye(len(known)), np.array([[lang == x for x in names] for _, lang in training], float))
    found = {r.doc_id: r for r in string_kernel.languages(documents, model).collect()}
    for i, t, _ in rows[:-2]:
        f = np.array([kernel(presence(t), b) for b in known]) @ of * string_kernel.SHARPNESS
        share = np.exp(f - f.max()) / np.exp(f - f.max()).sum()
        assert found[i].lang_pred == names[int(share.argmax())] and found[i].score == pytest.approx(share.max(), abs=2e-3)
    assert found[501].lang_pred in names and found[502].lang_pred == "und"


def test_common_ngrams_by_both_ways():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 900, 110)).astype(np.int32) for _ in range(50)]
    codes = np.unique(np.concatenate(sets[:9]))
    want = [[len(set(x) & set(y)) for y in sets[:9]] for x in sets]
    for way in (string_kernel._common_dense, string_kernel._common_sparse):
        assert (way(sets, sets[:9], codes) == want).all()
