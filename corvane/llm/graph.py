"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.llm.workspace import Workspace


def components(links: DataFrame, a: str, b: str, space: Workspace, name: str) -> DataFrame:
    """(node, component) of every node that has a link; a component is named by its smallest node.

    Each round gives a node the smallest name among its neighbours, then the name of that name, so names
    travel twice as far each round.  Rounds are written tables; minima are taken before rows are dealt out,
    so a node with very many links costs no single task.  Null ends make no link.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    both = space.keep(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), f"{name}-edges")
    names = space.keep(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("component")), f"{name}-0")
    turn = 0
    while True:
        near = both.join(names, both["y"] == names["node"]).groupBy("x").agg(F.min("component").alias("near"))
        step = names.join(near, names["node"] == near["x"], "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("name"))
        up = names.select(F.col("node").alias("up"), F.col("component").alias("above"))
        step = step.join(up, step["name"] == up["up"], "left").select("node", "old", F.least("name", "above").alias("component"))
        turn += 1
        step = space.keep(step, f"{name}-{turn}")
        moved = step.where("component <> old").limit(1).count()
        space.drop(f"{name}-{turn - 1}")
        names = step.select("node", "component")
        if not moved:
            space.drop(f"{name}-edges")
            return names
