"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import stored


def connected_components(edges: DataFrame, purpose: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (x, y); the component is its smallest node.

    In each round every node points to its smallest neighbour, pointers are followed twice, and edges are drawn anew
    between what they point to; edges inside one component vanish, so the table shrinks by at least half its nodes.
    All tables of a round are written below the shared checkpoint folder. Nothing but a row count reaches the driver.
    """
    link = F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")
    live = stored(edges.where("x <> y").select(*link).distinct(), f"{purpose}-edges")
    labels = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("p")), f"{purpose}-steps")
        for _ in range(2):
            over = step.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            step = step.join(over, "p").select("u", F.col("pp").alias("p"))
        step = stored(step, f"{purpose}-steps")
        if labels is None:
            labels = step.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            moved = step.select(F.col("u").alias("component"), "p")
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("p", "component").alias("component"))
            labels = stored(labels, f"{purpose}-labels")
        ends = live.join(step.select("u", F.col("p").alias("x")), "u").join(step.select(F.col("u").alias("v"), F.col("p").alias("y")), "v")
        live = stored(ends.where("x <> y").select(*link).distinct(), f"{purpose}-edges")
    return labels if labels is not None else edges.select(F.col("x").alias("node"), F.col("y").alias("component")).limit(0)
