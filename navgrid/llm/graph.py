"""Connected components of a graph given by its edges."""

from pyspark.sql import DataFrame, functions as F

from navgrid.session import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """Smallest node of the component of every node that has an edge. Columns of edges: a, b; of the result: node, root.

    Rounds of taking the smallest root among neighbours and then that root's own root (pointer jumping), until nothing
    changes. Each round is written to the shared folder, so a lost executor costs one round at most.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                       .where("a != b").distinct())
    state = materialise(both.groupBy("a").agg(F.min("b").alias("root"))
                        .select(F.col("a").alias("node"), F.least("a", "root").alias("root")))
    while True:
        near = (both.join(state.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("root").alias("near")))
        closer = state.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        above = state.select(F.col("node").alias("root"), F.col("root").alias("above"))
        moved = materialise(closer.join(above, "root").select(
            "node", F.least("root", "above").alias("root"), (F.least("root", "above") != F.col("was")).alias("moved")))
        discard(state)
        state = moved.select("node", "root")
        if moved.where("moved").limit(1).count() == 0:
            discard(both)
            return state
