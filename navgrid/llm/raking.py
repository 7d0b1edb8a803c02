"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed in cells (source, language, topic). Raking multiplies the cells' weights in turn until the totals of
each of the three match their targets, where a cell that is taken whole stays at its tokens and the free ones make up
for it; documents are then drawn with their cell's weight over its tokens as probability. A target that asks for more
tokens than there are is met by taking documents more than once. A draw is a hash of the document, so it does not depend
on partitioning.
"""

import warnings

from pyspark.sql import Column, DataFrame, Observation, functions as F

from navgrid.llm.host_rules import SPACE
from navgrid.session import discard, materialise

DIMENSIONS = ("source", "lang", "topic")
TOPICS = (  # the first that has one of its marks in the lower-cased text
    ("licensed", ("license", "all rights reserved", "copyright")),
    ("contact", ("@", "http://", "https://")),
)
OTHER = "prose"


def topic_of(text: Column, topics=TOPICS) -> Column:
    low, out = F.lower(text), F.lit(OTHER)
    for name, marks in reversed(topics):
        found = F.lit(False)
        for mark in marks:
            found = found | F.contains(low, F.lit(mark))
        out = F.when(found, name).otherwise(out)
    return out


def tempered(cells: DataFrame, exponent: float) -> dict[str, DataFrame]:
    """Targets that flatten the corpus: each value's share of its dimension is its tokens to the power `exponent`."""
    out = {}
    for name in DIMENSIONS:
        power = cells.groupBy(name).agg(F.pow(F.sum("tokens"), F.lit(exponent)).alias("power"))
        total = power.agg(F.sum("power")).first()[0] or 1.0
        out[name] = power.select(name, (F.col("power") / total).alias("share"))
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 50, tolerance: float = 1e-6,
         budget: float | None = None) -> DataFrame:
    """cells with a column weight (total 1) whose totals by each dimension match the targets (value, share), and a column
    off: how much of the whole the totals missed their targets by, at most, before the last round. It is above
    `tolerance` only where the rounds ended first.

    cells: source, lang, topic (never null), tokens. Ends when no total is off by more than `tolerance` of the whole or
    after `rounds` rounds. Values without a target, or with a share of 0, get weight 0. Each round is written to the
    shared folder.

    With a budget (tokens) weights end at tokens / budget, what the cell has. Cells of a value whose target is more than
    all its tokens have no such bound; nor has any cell in further `rounds` rounds where the bounded ones miss the
    tolerance, so the targets come before the bounds.
    """
    most = F.lit(float("inf"))
    for name, target in targets.items():
        cells = cells.join(target.select(name, F.col("share").alias(f"{name}_share")), name, "left")
    if budget:
        most = F.col("tokens") / F.lit(float(budget))
        for name in targets:
            held = cells.groupBy(name).agg(F.sum("tokens").alias(f"{name}_tokens"))
            cells = cells.join(held, name)
            most = F.when(F.col(f"{name}_share") * budget > F.col(f"{name}_tokens"), float("inf")).otherwise(most)
    weighted = materialise(cells.select(*DIMENSIONS, "tokens", *[f"{name}_share" for name in targets],
                                        F.col("tokens").cast("double").alias("weight"), most.alias("most")))
    some, off = weighted.limit(1).count(), 0.0
    for bounded in (True, False) if budget else (False,):
        if not bounded:
            weighted = weighted.withColumns({"weight": F.least("weight", "most"), "most": F.lit(float("inf"))})
        for _ in range(rounds if some else 0):
            done, off = _round(weighted, list(targets))
            discard(weighted)
            weighted = done
            if off <= tolerance:
                break
        else:
            continue
        break
    return weighted.select(*DIMENSIONS, "tokens", F.least("weight", "most").alias("weight"), F.lit(float(off)).alias("off"))


def _round(weighted: DataFrame, names: list[str]) -> tuple[DataFrame, float]:
    """Each dimension fitted once, and how far its totals were off before.

    The weight in force is least(weight, most). A factor f solves sum(least(f * weight, most)) = share for cells that are
    at their bound now or not; as the sum is concave in f this never goes too far, and rounds bring it to the solution.
    """
    step, seen = weighted, Observation()
    free = F.col("weight") < F.col("most")
    for name in names:
        total = step.groupBy(name).agg(
            F.sum("weight").alias("all"), F.sum(F.when(free, F.col("weight"))).alias("free"),
            F.coalesce(F.sum(F.when(~free, F.col("most"))), F.lit(0.0)).alias("full"))
        share = F.coalesce(f"{name}_share", F.lit(0.0))
        factor = F.greatest(share / F.col("all"), F.when(F.col("free") > 0, (share - F.col("full")) / F.col("free")))
        step = step.join(total, name).withColumns({
            "weight": F.when(F.col("all") > 0, F.col("weight") * factor).otherwise(0.0),
            f"{name}_off": F.abs(share - F.coalesce("free", F.lit(0.0)) - F.col("full"))}).drop("all", "free", "full")
    errors = [f"{name}_off" for name in names]
    done = materialise(step.observe(seen, F.max(F.greatest(*errors)).alias("most")).drop(*errors))
    return done, seen.get["most"]


def sampled(documents: DataFrame, targets: dict[str, DataFrame] | None = None, exponent: float = 0.7, share: float = 0.5,
            seed: int = 5, rounds: int = 50) -> DataFrame:
    """documents with n_tokens, topic, probability, sampled (whether the document was drawn) and copies (how often the
    sample has it); same-named columns are replaced, all others and all rows stay.

    Where raking does not come within one in a thousand of the targets in its rounds, a warning says by how much it missed.

    documents needs doc_id, text, source and lang. The budget is `share` of all tokens (words). A cell that would need
    more tokens than it has is taken whole and others give what it lacks, see rake(); where they cannot, copies is above
    1 (its mean in the cell is the weight over the tokens), so n_tokens * copies has the target totals. Null source or lang is a value of its own ('-' in targets, others
    '+' and the value); null text has no tokens, and a document without tokens is never drawn.
    Rows of equal doc_id and text share their random number: equal rows are drawn together, rows that differ in source or lang
    each by the probability of their own cell. Column names that start with two underscores are reserved.
    """
    key = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-"))
    plain = documents.drop("n_tokens", "topic", "probability", "sampled", "copies")
    text = F.coalesce("text", F.lit(""))
    measured = plain.withColumns({
        "n_tokens": F.size(F.array_remove(F.split(text, SPACE), "")).cast("long"), "topic": topic_of(text),
        "__source": key("source"), "__lang": key("lang"),
        "__draw": F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)})
    cells = materialise(measured.groupBy(F.col("__source").alias("source"), F.col("__lang").alias("lang"), "topic")
                        .agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"))
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    weighted = rake(cells, targets or tempered(cells, exponent), rounds, budget=share * total)
    off = weighted.agg(F.max("off")).first()[0] or 0.0
    if off > 1e-3:
        warnings.warn(f"raking ended {off:.2%} off its targets after {rounds} rounds")
    odds = weighted.select(F.col("source").alias("__source"), F.col("lang").alias("__lang"), F.col("topic").alias("__topic"),
                           (F.col("weight") * (share * total) / F.col("tokens")).alias("__odds"))
    joined = measured.withColumn("__topic", F.col("topic")).join(odds, ["__source", "__lang", "__topic"], "left")
    times = F.when(F.col("n_tokens") > 0, F.coalesce("__odds", F.lit(0.0))).otherwise(0.0)
    copies = F.greatest(F.ceil(times - F.col("__draw")), F.lit(0)).cast("long")
    return (joined.withColumn("probability", F.least(F.lit(1.0), times)).withColumn("copies", copies)
            .withColumn("sampled", F.col("copies") > 0).select(*plain.columns, "n_tokens", "topic", "probability", "sampled", "copies"))
