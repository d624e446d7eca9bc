"""Connected components by contraction, in joins: no edge list leaves the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.shared import forget, written


def components(links: DataFrame) -> DataFrame:
    """node, comp (the least node of its component) for every node of links (a, b), as a written table.

    Each round hooks every node to its least neighbour if that is less, follows the hooks to their ends by
    pointer doubling, and goes on with the links between the ends; the number of nodes at least halves.
    """
    links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    label = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to")), "hooks")
        while True:
            far = up.select(F.col("node").alias("to"), F.col("to").alias("to2"))
            nxt = written(up.select("node", "to").join(far, "to", "left").select("node", F.coalesce("to2", "to").alias("to"), (F.col("to2") < F.col("to")).alias("moved")), "hooks")
            forget(up)
            up = nxt
            if nxt.where("moved").isEmpty():
                break
        ends = up.select("node", "to")
        before = label
        if before is None:
            label = ends.withColumnRenamed("to", "comp")
        else:
            label = before.join(ends.select(F.col("node").alias("comp"), "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        label = written(label, "labels")
        a, b = (ends.select(F.col("node").alias(old), F.col("to").alias(new)) for old, new in (("a", "x"), ("b", "y")))
        left = written(links.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        for spent in (before, up, links):
            forget(spent)
        links = left
    if label is None:
        return written(links.select(F.col("a").alias("node"), F.col("b").alias("comp")), "labels")
    forget(links)
    return label
