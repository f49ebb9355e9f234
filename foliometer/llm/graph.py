"""Connected components by distributed union-find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored


def _forest():
    """Replace the links of a batch by a forest of them: each node and its local root."""

    def work(batch):
        parent: dict[int, int] = {}

        def root(node):
            while (above := parent.setdefault(node, node)) != node:
                parent[node] = parent[above]
                node = above
            return node

        for a, b in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        nodes = np.fromiter(parent, np.int64, len(parent))
        roots = np.fromiter(map(root, list(parent)), np.int64, len(parent))
        keep = nodes != roots
        yield [pa.array(nodes[keep]), pa.array(roots[keep])]

    return work


def components(links: DataFrame) -> DataFrame:
    """Nodes of ``links`` (a long, b long) with the smallest node they reach.

    Returns (node, component) for every node that has a link to another node; nulls and
    links to oneself are passed over. Each batch is first reduced to a forest in its own
    task. Then rounds follow: every node hooks to the smallest root among its neighbours,
    and paths are halved by looking up the root of the root, until nothing changes. The
    tables of a round are stored, so both sides of each join are plain shuffles, of which
    adaptive execution splits hot nodes.
    """
    plain = links.select(F.col("a").cast("long"), F.col("b").cast("long"))
    plain = plain.filter("a <> b")
    forest = map_batches(plain, _forest, "a long, b long")
    # The forest of a batch depends on how rows were batched; stored, it stays the same.
    edges = stored(forest.unionByName(forest.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    roots = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    roots = stored(roots.select("node", F.least("node", "root").alias("root")), "roots")
    while True:
        near = edges.join(roots, edges.b == roots.node).groupBy("a").agg(F.min("root").alias("near"))
        hooked = roots.join(near, roots.node == near.a).select(
            "node", F.col("root").alias("was"), F.least("root", "near").alias("root")
        )
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
        after = hooked.join(above, "root").select(
            "node", "was", F.least("root", "top").alias("root")
        )
        after = stored(after, "roots")
        roots = after.select("node", "root")
        if after.filter("root <> was").isEmpty():
            return roots.withColumnRenamed("root", "component")
