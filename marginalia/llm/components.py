"""Connected components of a link table, by alternating star contraction.

Every round replaces each node's links by links to the least node it knows: first
to larger neighbours (large star), then among smaller ones (small star).  The
number of rounds grows with the logarithm of the longest path.  Nothing but a
change flag reaches the driver, and each round's links are written to the shared
folder, so a lost executor never repeats earlier rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: So many links (checked) are contracted in one task: 16 bytes each.
ONE_TASK = 1_500_000


def least_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links u-v, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def contract(batches):
    """The links of one partition, reduced to one link a node: a forest of stars."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    t = pa.Table.from_batches(tables)
    nodes, root = least_of(t["u"].to_numpy(), t["v"].to_numpy())
    keep = nodes != root
    yield pa.record_batch([pa.array(nodes[keep]), pa.array(root[keep])], names=["u", "v"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    both = links.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(links.select(F.col("v").alias("n"), F.col("u").alias("m"))) if large else links.select(F.greatest("u", "v").alias("n"), F.least("u", "v").alias("m"))
    least = both.groupBy("n").agg(F.min("m").alias("l")).select("n", F.least("n", "l").alias("l"))
    met = both.join(least, "n")
    if large:
        out = met.where(F.col("m") > F.col("n")).select(F.col("m").alias("u"), F.col("l").alias("v"))
    else:
        out = met.select(F.col("m").alias("u"), F.col("l").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("l").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, one_task: int = ONE_TASK, contracted: bool = False) -> DataFrame:
    """(node, component) for the nodes of ``links`` (u, v: long); the component is its least node.

    ``contracted``: each partition's links have been through ``contract`` already.  Null ends and links of a node to itself say nothing.  Repeated links are one.
    """
    spark = links.sparkSession
    now = C.staged(spark, links if contracted else C.map_arrow(links.where("u <> v").select("u", "v"), contract, "u long, v long"), "links")
    size = now.count()
    while size > one_task:  # partitions drawn together, each of bounded size, share many nodes and shrink
        new = C.staged(spark, C.map_arrow(now.coalesce(-(-size // one_task)), contract, "u long, v long"), "links")
        before, size = size, new.count()
        C.drop(spark, now)
        now = new
        if size > 0.7 * before:
            break
    if size <= one_task:
        stars = C.map_arrow(now.coalesce(1), contract, "u long, v long") if size else now
    else:
        while True:
            stars = C.staged(spark, _star(_star(now, True), False), "links")
            # settled: no node has two parents, and no parent has one
            unsettled = stars.groupBy("u").count().where("count > 1").select("u").unionByName(stars.select("u").join(stars.select(F.col("v").alias("u")), "u", "left_semi"))
            done = unsettled.isEmpty()
            C.drop(spark, now)
            now = stars
            if done:
                break
    leaves = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())
