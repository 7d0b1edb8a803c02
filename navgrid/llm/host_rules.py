"""Quality rules with verdicts on hosts.

Each text is measured with DataFrame functions. Failures of each rule are summed by host; with few texts a host's rate
says little, so it is shrunk by a beta prior that is fitted to all hosts' rates (method of moments). A host whose shrunk
rate is over the limit for any rule is rejected with all its texts; the verdict is joined back to the texts.
"""

from pyspark.sql import Column, DataFrame, functions as F

from navgrid.session import materialise

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
RULES = {  # failed if true
    "base": "n_words < 20 or 100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines",
    "length": "word_chars < 2 * n_words or word_chars > 30 * n_words",
}
LIMIT = 0.5


def let(value: Column, use) -> Column:
    """use(value) with value computed once, not at every place inside a lambda that names it."""
    return F.transform(F.array(value), use)[0]


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words in windows of `window` words that are found twice or more in the text, the first included."""
    n = F.size(hashes) - window + 1
    grams = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1),
                                      lambda i: F.xxhash64(F.slice(hashes, i + 1, window)))).otherwise(F.array().cast("array<bigint>"))

    def covered(g):
        order = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        at = let(order, lambda s: F.array_sort(F.transform(F.filter(F.transform(s, lambda x, k: F.struct(
            x["i"].alias("i"), ((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])).alias("twice"))),
            lambda x: x["twice"]), lambda x: x["i"])))
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(window)), F.lit(window))),
                                             F.lit(0), lambda a, b: a + b))

    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, source, n_words, n_lines, word_chars, n_symbols, n_dup_lines, n_repeat_words, and per rule whether it
    failed. Null text has no words, hence fails the base rule; further columns of documents are ignored."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        repeated_words_of(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"))
    flat = counts.select("doc_id", "source", "w.n_words", "l.n_lines", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words")
    return flat.withColumns({f"{name}_failed": F.expr(rule) for name, rule in RULES.items()})


def repeated_words_of(words: Column) -> Column:
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: repeated_words(hashes))


def host_verdicts(texts: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Per host (source; null is a host of its own) and rule the shrunk rate of failures, and whether it is rejected."""
    hosts = materialise(texts.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"{name}_failed")).alias(name) for name in RULES]))
    moments = hosts.agg(*[f for name in RULES for f in (
        (F.sum(name) / F.sum("n")).alias(f"{name}_mean"), F.var_samp(F.col(name) / F.col("n")).alias(f"{name}_var"))]).first()
    rates = {}
    for name in RULES:
        mean, var = moments[f"{name}_mean"] or 0.0, moments[f"{name}_var"] or 0.0
        # Prior weight in texts; rates that vary no more than those of single texts weigh as much as one text.
        weight = max(1.0, mean * (1 - mean) / var - 1) if var > 0 else 1.0
        rates[f"{name}_rate"] = (F.col(name) + mean * weight) / (F.col("n") + weight)
    rejected = F.greatest(*[F.col(f"{name}_rate") for name in RULES]) > limit
    return hosts.withColumns(rates).select("source", "n", *rates, rejected.alias("rejected"))


def judged(documents: DataFrame, limit: float = LIMIT) -> DataFrame:
    """measured(), base_failed, and kept: neither the base rule failed nor the text's host is rejected."""
    texts = materialise(measured(documents))
    hosts = host_verdicts(texts, limit).select(F.col("source").alias("host"), "rejected")
    return (texts.join(hosts, texts.source.eqNullSafe(F.col("host")), "left")
            .withColumn("kept", ~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))).drop("host", "rejected"))
