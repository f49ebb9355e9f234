"""Connected components of a graph given as links, in rounds of plain aggregates.

Every node points to a node of its tree, at first to itself. A round looks at all links between
trees, hooks each tree's root to the smallest smaller root it is linked with, and halves the
ways to the roots until they are one step long. A root that does not hook takes in another one,
or is linked with a smaller one afterwards and hooks in the next round, so the number of linked
trees falls by half every two rounds, chains included. Joins are with stored tables of one row
per node, where adaptive execution divides a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_out


def _keep(df: DataFrame) -> DataFrame:
    return write_out(df, "components")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links(u, v)``; the component is its smallest node.

    A null end stands for no link; the node at the other end still counts. Loops and repeated
    links change nothing.
    """
    ends = F.array("u", "v")
    nodes = links.select(F.explode(ends).alias("node")).filter(F.col("node").isNotNull()).distinct()
    trees = _keep(nodes.select("node", F.col("node").alias("component")))
    between = links.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    between = _keep(between.select(F.least(*ends_of()).alias("u"), F.greatest(*ends_of()).alias("v")).distinct())
    while not between.isEmpty():
        # Links are between roots, and u < v.
        parents = _keep(between.groupBy(F.col("v").alias("root")).agg(F.min("u").alias("parent")))
        moved = True
        while moved:
            jumped = _keep(_jump(_jump(parents, parents).drop("moved"), parents))
            moved = not jumped.filter("moved").isEmpty()
            parents = jumped.drop("moved")
        renamed = parents.withColumnRenamed("root", "component")
        trees = trees.join(renamed, "component", "left")
        trees = _keep(trees.select("node", F.coalesce("parent", "component").alias("component")))
        for end in ("u", "v"):
            renamed = parents.select(F.col("root").alias(end), "parent")
            between = between.join(renamed, end, "left")
            between = between.withColumn(end, F.coalesce("parent", end)).drop("parent")
        between = between.filter("u <> v").select(F.least(*ends_of()).alias("u"), F.greatest(*ends_of()).alias("v"))
        between = _keep(between.distinct())
    return trees


def _jump(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows (root, parent) with the parent's parent where it has one, and whether it has."""
    above = parents.select(F.col("root").alias("parent"), F.col("parent").alias("above"))
    jumped = rows.join(above, "parent", "left")
    return jumped.select("root", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved"))


def ends_of():
    return F.col("u"), F.col("v")
