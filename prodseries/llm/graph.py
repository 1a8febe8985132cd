"""Connected components of an undirected graph, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prodseries.llm.storage import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of edges (a, b) with the smallest node it can reach.

    Every round each node hooks onto its smallest neighbour, twice over, and the graph between what is left is built
    anew: at most half of the nodes of a component remain, a star is done in one round. Minima are taken before the
    shuffle, so a node with very many neighbours costs no task more; the joins are plain equi-joins that Spark may split.

    Nodes are of any type that Spark can order. An edge with a null end or two equal ends joins nothing, and a node that has only
    such edges gets no row; repeated edges and both directions count once; without edges the result is empty.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    pairs = stored(pairs, "pairs")
    labels = None
    while pairs.limit(1).count():
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("to"))
        hook = stored(hook, "hooks")
        twice = hook.join(hook.select(F.col("node").alias("to"), F.col("to").alias("root")), "to").select("node", F.col("root"))
        roots = stored(twice, "roots")
        ends = pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        ends = ends.join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        left = ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a < b").distinct()
        rest = stored(left, "pairs")
        if labels is None:
            labels = roots.select("node", F.col("root").alias("component"))
        else:
            old, step = labels, roots.select(F.col("node").alias("component"), "root")
            labels = stored(old.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
            dropped(old)
            dropped(roots)
        dropped(hook)
        dropped(pairs)
        pairs = rest
    if labels is None:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
