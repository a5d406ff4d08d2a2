"""Connected components of an edge table by contraction.

In a round every node hooks to its smallest neighbour, pointer jumping makes the
trees flat, and edges are moved to the roots of their ends, where loops and repeats
fall away.  A node to which none hooked is larger than all its neighbours in the next
round, so two rounds at least halve the nodes.  An edge is looked up once an end and
round, and few are left after the first.  Every round is written to the shared folder,
and the driver sees only whether something is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import backed, scratch, written


def connected_components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``; root is the smallest node reachable.

    Loops, repeated and reversed edges are allowed; null ends are ignored.  Of earlier
    edges the result, given as ``known(node, root)``, stands for them: its nodes are
    in the new result, and those edges are not looked at again.
    """
    spark = edges.sparkSession
    pairs = edges.where("u is not null and v is not null and u <> v").select("u", "v")
    with scratch(spark) as keep:
        left = written(_distinct(pairs if known is None else _moved(pairs, known)), "cc-edges")
        levels: list[DataFrame] = []
        while not levels or not left.isEmpty():
            with scratch(spark) as keep_round:
                levels.append(_trees(left))
                left = written(_distinct(_moved(left, levels[-1])), "cc-edges")
                keep_round(levels[-1], left)
        roots = levels.pop()
        while levels:  # the roots of a level are nodes of the next one, if edges were left there
            roots = _through(levels.pop(), roots)
        if known is not None:
            roots = _through(known, roots).union(roots.join(known.select("node"), "node", "left_anti"))
        roots = written(roots, "cc-roots")
        keep(roots)
    return roots


def _distinct(pairs: DataFrame) -> DataFrame:
    """Each edge once, the smaller end first, without loops."""
    return pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _moved(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``pairs`` between the roots of their ends; an end without a label is its own root."""
    for c in ("u", "v"):
        own = labels.select(F.col("node").alias(f"_{c}"), F.col("root").alias("_root"))
        pairs = pairs.join(own, F.col(c) == F.col(f"_{c}"), "left").select(*[F.coalesce("_root", c).alias(c) if x == c else x for x in ("u", "v")])
    return pairs


def _through(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """``labels`` with each root replaced by that root's own in ``roots``, if it has one."""
    up = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return labels.join(up, F.col("root") == F.col("_node"), "left").select("node", F.coalesce("_root", "root").alias("root"))


def _trees(edges: DataFrame) -> DataFrame:
    """(node, root) of the trees in which every node hooks to its smallest neighbour, if that is smaller."""
    ends = edges.select("u", "v").union(edges.select("v", "u"))
    trees = written(ends.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "cc-hooks")
    while True:
        up = trees.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        jumped = written(trees.join(up, trees.root == up._node).select("node", F.col("root").alias("was"), F.col("_root").alias("root")), "cc-labels")
        trees = backed(jumped.select("node", "root"), jumped)
        if jumped.where("root <> was").isEmpty():
            return trees
