"""Line dedup over sequences of line ids, with prefix doubling.

A run is a stretch of consecutive lines with words in one text (blank lines are not compared). A line is removed if it
lies in a run of at least `min_words` words that also starts at an earlier place; places are ordered by doc_id (null
first), then by position. The first copy of a maximal repeated run stays, all later copies go.

Every line gets an id; lines that occur once break runs. Prefix doubling names the runs of 1, 2, 4, ... lines from each
line on. Runs of any length n are compared, as suffixes are in a suffix array, by the two names of 2^k <= n lines that
cover them from either end. Only the shortest runs of min_words words have to be compared: seen from each line forwards
and backwards they cover every longer run, so the groups of equal ones (the intervals of the suffix array whose common
prefix is that long) reveal all of every maximal repeated run. Names are 128 bits wide.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from navgrid.llm.host_rules import SPACE, let
from navgrid.session import materialise

MIN_WORDS = 50


def without_repeated_runs(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """documents without the later copies of repeated runs of lines; n_lines, n_removed are added (replaced).

    documents needs doc_id and text; its other columns stay, n_chars becomes the new length where it exists. Null text
    stays null (one line, none removed), text that loses all its lines becomes empty. Rows with equal id and text count
    as one document and all come back; rows with equal ids and different texts are ordered by a hash of the text. An empty
    table gives no rows. Column names that start with two underscores are reserved.
    """
    plain = documents.drop("n_lines", "n_removed").withColumn("__copy", F.xxhash64("text"))
    gone = repeated_lines(plain.select("doc_id", "__copy", "text"), min_words)
    gone = gone.groupBy(F.col("doc_id").alias("__id"), F.col("__copy").alias("__of")).agg(F.collect_list("seq").alias("__gone"))
    joined = plain.join(gone, plain.doc_id.eqNullSafe(F.col("__id")) & (F.col("__copy") == F.col("__of")), "left")

    def kept(lines):
        worded = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: _worded(F.get(lines, i)))
        left = let(worded, lambda w: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1),
                                                    F.transform("__gone", lambda s: F.get(w, s))))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), kept))
    out = joined.withColumns({
        "n_lines": F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long"),
        "n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"), "__text": text})
    for name in plain.columns:
        if name == "text":
            out = out.withColumn("text", F.col("__text"))
        elif name == "n_chars":
            out = out.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("__text"))
                                 .cast(documents.schema["n_chars"].dataType))
    return out.select(*[c for c in plain.columns if c != "__copy"], "n_lines", "n_removed")


def _worded(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def repeated_lines(documents: DataFrame, min_words: int) -> DataFrame:
    """Lines that later copies of runs cover: doc_id, __copy, seq (place among the text's lines with words)."""
    worded = F.filter(F.split("text", "\n"), _worded)
    lines = materialise(documents.select("doc_id", "__copy", F.posexplode(worded).alias("seq", "line")).select(
        "doc_id", "__copy", "seq", F.size(F.array_remove(F.split("line", SPACE), "")).cast("long").alias("words"),
        F.xxhash64("line").alias("a"), F.xxhash64("line", F.lit(1)).alias("b")).distinct())
    twice = lines.groupBy("a", "b").count().where("count > 1").select("a", "b", F.lit(1).alias("again"))
    named = lines.join(twice, ["a", "b"], "left").withColumns({
        "again": F.coalesce("again", F.lit(0)), "a": F.when(F.col("again") == 1, F.col("a")), "b": F.when(F.col("again") == 1, F.col("b"))})
    text = Window.partitionBy("doc_id", "__copy")
    order = text.orderBy("seq")
    named = named.withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    named = named.withColumn("before", F.col("upto") - F.col("words"))
    levels = max(1, min_words.bit_length())
    named = named.withColumns({"a0": F.col("a"), "b0": F.col("b")})
    for k in range(1, levels):
        step = 1 << (k - 1)
        after = {x: F.lead(f"{x}{k - 1}", step).over(order) for x in "ab"}
        named = named.withColumns({f"next_{x}": c for x, c in after.items()})
        both = F.col(f"a{k - 1}").isNotNull() & F.col("next_a").isNotNull()
        named = named.withColumns({f"a{k}": F.when(both, F.xxhash64(f"a{k - 1}", "next_a", F.lit(k))),
                                   f"b{k}": F.when(both, F.xxhash64(f"b{k - 1}", "next_b", F.lit(-k)))})
    ahead = text.orderBy("before").rangeBetween(0, min_words - 1)
    behind = text.orderBy("upto").rangeBetween(1 - min_words, 0)
    runs = {}
    for side, frame in (("ahead", ahead), ("behind", behind)):
        total, n, repeated = F.sum("words").over(frame), F.count(F.lit(1)).over(frame), F.sum("again").over(frame)
        runs[side] = F.when((total >= min_words) & (n == repeated), n)
    named = named.withColumns(runs).where("again = 1")
    names = F.array(*[F.struct(F.col(f"a{k}").alias("a"), F.col(f"b{k}").alias("b")) for k in range(levels)])
    named = materialise(named.select("doc_id", "__copy", F.col("seq").cast("long").alias("seq"), "ahead", "behind", names.alias("names")))
    windows = (named.where("ahead is not null").select("doc_id", "__copy", F.col("seq").alias("start"), F.col("ahead").alias("n"))
               .union(named.where("behind is not null").select("doc_id", "__copy", F.expr("seq - behind + 1"), "behind")).distinct())
    level = F.length(F.bin("n")) - 1  # largest k with 2^k <= n
    windows = windows.withColumn("level", level.cast("int")).withColumn("second", F.expr("start + n - shiftleft(1L, level)"))
    for at, name in (("start", "x"), ("second", "y")):
        of = named.select(F.col("doc_id").alias("_d"), F.col("__copy").alias("_c"), F.col("seq").alias("_s"), F.col("names").alias(name))
        windows = (windows.join(of, windows.doc_id.eqNullSafe(F.col("_d")) & (F.col("__copy") == F.col("_c")) & (F.col(at) == F.col("_s")))
                   .drop("_d", "_c", "_s").withColumn(name, F.get(name, F.col("level"))))
    windows = materialise(windows.select("doc_id", "__copy", "start", "n", F.col("x.a").alias("xa"), F.col("x.b").alias("xb"),
                                         F.col("y.a").alias("ya"), F.col("y.b").alias("yb")))
    run = ["n", "xa", "xb", "ya", "yb"]
    place = F.struct("doc_id", "__copy", "start")
    first = windows.groupBy(*run).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    later = windows.join(first, run).where(~place.eqNullSafe(F.col("first")))
    return (later.select("doc_id", "__copy", F.explode(F.expr("sequence(start, start + n - 1)")).alias("seq"))
            .select("doc_id", "__copy", F.col("seq").cast("int").alias("seq")).distinct())
