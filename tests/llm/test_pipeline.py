"""The pipeline's stages and run() against brute force on a small folder of tables."""

import pytest

import corpus_pipeline
from test_text_operators import SENTENCE, jaccard_classes, line_runs, prose, words

FOREIGN = str.maketrans("0123456789abcdef", "éàèùçêîôûâäëïöüñ")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, prose(i, 40 + i % 30), "en") for i in range(60)] + [(100 + i, prose(i + 500, 50).translate(FOREIGN), "fr") for i in range(60)]
    rows += [(200, None, "en"), (201, "", "fr"), (202, "123 456", None), (203, prose(3, 43), "en"), (204, prose(1, 41) + " more", None),
             (205, prose(70, 30) + "\n" + prose(71, 60), "en"), (206, prose(72, 30) + "\n" + prose(71, 60), "en"), (207, prose(71, 60), "en"),
             (208, prose(73, 40) + " " + SENTENCE, "en"), (209, prose(74, 5), "en")]
    rows = [(k, t, lang, "a" if k % 3 else "b", len(t or "")) for k, t, lang in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, SENTENCE), (2, prose(74, 5))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def contaminated(text, items):
    w = words(text)
    for item in items:
        x = words(item)
        n = min(10, len(x))
        windows = {tuple(x[i:i + n]) for i in range(len(x) - n + 1)}
        if any(tuple(w[i:i + n]) in windows for i in range(len(w) - n + 1)):
            return True
    return False


def test_stages_and_run(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    text = {k: t for k, t, *_ in rows}
    expected = {k: t for k, t in text.items() if t and any(map(str.isalpha, t))}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        got = {r.doc_id: r.text for r in out.collect()}
        if name == "line_runs":
            left = line_runs(sorted(expected.items()), 50)
            expected = {k: t for k, t, _, gone in left if not gone or t.split()}
        elif name == "near_duplicates":
            names, _ = jaccard_classes(sorted(expected.items()))
            expected = {k: expected[k] for k, of, _ in names if k == of}
        elif name == "decontamination":
            expected = {k: t for k, t in expected.items() if not contaminated(t, [SENTENCE, prose(74, 5)])}
        if name == "mixing":
            assert set(got.items()) <= set(expected.items()) and 0 < len(got) < len(expected)
            assert all(0 < r.probability <= 1 for r in out.collect())
        else:
            assert got == expected, name
            assert out.columns == docs.columns
        target = f"{path}/stage{number}"
        out.write.parquet(target)
        docs = spark.read.parquet(target)
    assert 203 not in expected and 207 not in expected and 208 not in expected
    again = corpus_pipeline.run(spark, path)
    assert {(r.doc_id, r.text) for r in again.collect()} == set(got.items())


def test_short_texts_of_many_languages_stay(spark):
    """One word is enough to be kept, whatever its score among 30 languages."""
    letters = [chr(0x3B1 + i) + chr(0x431 + i % 20) + chr(97 + i % 26) for i in range(24)] + [chr(0x5D0 + i) for i in range(6)]
    rows = [(100 * k + i, " ".join(x * (1 + (i + j) % 3) for j in range(20)), f"l{k}") for k, x in enumerate(letters) for i in range(12)]
    short = [(9000 + k, x, None) for k, x in enumerate(letters)] + [(9100, "ok", "l0"), (9101, "De.", None)]
    docs = spark.createDataFrame(rows + short + [(9200, "12 ...", "l1"), (9201, None, "l1")], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert kept == {k for k, *_ in rows + short}


def test_the_rest_does_not_need_the_subpackage():
    import __spark_entry__
    names = set(__spark_entry__.queries())
    assert {"pipeline", *(n for n in names if n.startswith("op"))} <= names and len([n for n in names if n.startswith("op")]) == 13
    assert all(corpus_pipeline.STAGES[i][0] for i in range(5)) and corpus_pipeline.ORACLE_SQL is None
