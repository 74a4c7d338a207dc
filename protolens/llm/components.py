"""Connected components of an edge table, by rounds of contraction.

Each round maps every node to the smallest of itself and its neighbours, relabels the edges and drops
those that became loops.  All steps are aggregates and joins with partial sums before the shuffle; each
round's tables are written to the shared folder, so lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolens.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a long, b long); component is the smallest node reachable."""
    now = written(edges.select("a", "b").where("a <> b").distinct(), "cc-edges")
    label: DataFrame | None = None
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("to")), "cc-step")
        if label is None:
            label = step.select("node", F.col("to").alias("component"))
        else:
            label = (label.join(step.withColumnRenamed("node", "component"), "component", "left")
                     .select("node", F.coalesce("to", "component").alias("component")))
            label = written(label, "cc-label")
        now = (now.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
               .join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
               .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        now = written(now, "cc-edges")
    if label is None:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label
