"""Chat formatting of reply trees.

Messages name their parent. Self-joins that double their step find all ancestors of every leaf, branches (paths from the
root to a leaf) are ranked by the mean score of their messages, and each chosen branch becomes one conversation in a
template with turn marks. Control strings inside texts get a backslash after their first character (one more if they had
some), which is undone when reading back, so no text can end or start a turn.
"""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from navgrid.session import discard, materialise

START, STOP = "<|im_start|>", "<|im_end|>\n"
_CONTROL = r"(\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|</?SYS>>)"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, r"$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def branches(messages: DataFrame, keep: int | None = 1) -> DataFrame:
    """Chosen root-to-leaf paths of reply trees: tree, leaf, rank, score, id, place (0: root), one row per message.

    messages: tree, id (unique in the tree), parent, score; further columns are ignored. Null is a tree of its own. A message
    with a null or unknown parent is a root; messages on or below a cycle of parents belong to no branch. A null score counts as 0.
    `keep` branches of each tree stay (None: all), by mean score, then by the leaf's id.
    """
    return _branches(_keyed(messages), keep).withColumn("tree", F.col("tree.tree"))


def _keyed(messages: DataFrame) -> DataFrame:
    """With tree in a struct, which is equal to another one also where its field is null."""
    return messages.withColumn("tree", F.struct("tree"))


def _branches(messages: DataFrame, keep: int | None) -> DataFrame:
    """Rank first: in rounds that double the step every message gets the sum and the number of the scores above it, so a
    leaf's mean is known without its path. Only the chosen leaves are then expanded to paths, by the same steps."""
    nodes = materialise(messages.select("tree", "id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    known = nodes.select("tree", F.col("id").alias("parent"), F.col("id").alias("up"))
    state = materialise(nodes.join(known, ["tree", "parent"], "left").select("tree", "id", "up", F.col("score").alias("total"), F.lit(1).cast("long").alias("n")))
    leaves = nodes.select("tree", "id").join(state.select("tree", F.col("up").alias("id")), ["tree", "id"], "left_anti")
    going, over, steps = state.where("up is not null"), [state.where("up is null")], []
    for _ in range(max(1, math.ceil(math.log2(nodes.count() + 1)) + 1)):
        if going.limit(1).count() == 0:
            break
        steps.append(going)
        # Only messages with more above them are joined: a long branch costs its own rounds, not those of all others.
        every = reduce(DataFrame.unionByName, [*over, going])
        above = every.select("tree", F.col("id").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("n").alias("some"))
        further = materialise(going.join(above, ["tree", "up"]).select(
            "tree", "id", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("n") + F.col("some")).alias("n")))
        over.append(further.where("up is null"))
        going = further.where("up is not null")
    ended = reduce(DataFrame.unionByName, over).join(leaves, ["tree", "id"], "left_semi")  # a message on or below a cycle never ends
    ranked = ended.select("tree", F.col("id").alias("leaf"), (F.col("total") / F.col("n")).alias("score"), (F.col("n") - 1).alias("depth"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    ranked = materialise(ranked.where(F.col("rank") <= keep) if keep else ranked)
    paths = materialise(ranked.select("tree", "leaf", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("up")))
    for k, step in enumerate(steps):
        jump = step.select("tree", "id", F.col("up").alias("above"))
        above = paths.join(jump, ["tree", "id"]).select("tree", "leaf", F.col("above").alias("id"), (F.col("up") + (1 << k)).alias("up"))
        longer = materialise(paths.unionByName(above))
        discard(paths)
        paths = longer
    out = materialise(paths.join(ranked, ["tree", "leaf"]).select("tree", "leaf", "rank", "score", "id", (F.col("depth") - F.col("up")).alias("place")))
    discard(nodes, state, ranked, paths, *steps, *over)
    return out


def conversations(messages: DataFrame, keep: int | None = 1) -> DataFrame:
    """One row per chosen branch: tree, leaf, rank, score, formatted, mask.

    messages: as for branches(), with role and text (null: empty). mask are the ranges (start, end) of characters of
    `formatted` that carry loss: the texts of the assistant, in order. A tree without a branch gives no row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    messages = _keyed(messages)
    turn = messages.select("tree", "id", F.concat(F.lit(START), escape_role(role), F.lit("\n")).alias("head"),
                           F.concat(escape(text), F.lit(STOP)).alias("rest"), (role == LEARNED).alias("loss"))
    length = F.length("head") + F.length("rest")
    before = F.sum(length).over(Window.partitionBy("tree", "leaf").orderBy("place")) - length  # turns of one conversation
    start = before + F.length("head")
    span = F.when(F.col("loss"), F.struct(start.cast("long").alias("start"), (start + F.length("rest") - len(STOP)).cast("long").alias("end")))
    turns = _branches(messages, keep).join(turn, ["tree", "id"]).withColumn("span", span)
    whole = turns.groupBy("tree", "leaf").agg(
        F.first("rank").alias("rank"), F.first("score").alias("score"),
        F.array_sort(F.collect_list(F.struct("place", F.concat("head", "rest").alias("text"), "span"))).alias("turns"))
    return whole.select("tree.tree", "leaf", "rank", "score", F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("formatted"),
                        F.array_compact(F.transform("turns", lambda t: t["span"])).alias("mask"))


def read_back(formatted: Column) -> Column:
    """Turns of a formatted conversation: array of role and text."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda _, i: i > 0)

    def turn(part):
        role = F.substring_index(part, "\n", 1)
        text = F.substring(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(STOP))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def under_mask(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, cut out of the formatted conversation and unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"].cast("int") + 1, (m["end"] - m["start"]).cast("int")))), "")
