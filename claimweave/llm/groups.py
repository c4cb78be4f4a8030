"""Pairwise matches to groups: deterministic Boruvka hooking on string identifiers.

Every component selects its smallest outgoing edge, edges being ordered by their two
ends; a strict order, so hooks form trees whose only loops are the two components that
selected the same edge, of which the smaller becomes the root. Trees collapse by pointer
doubling; edges are relabelled with the roots and deduplicated until none remain. At
least half of the components vanish per round, so rounds follow log2 of the largest
group. Selection is a partial aggregate (a hub's edges are reduced before the shuffle),
everything else an equi-join with one row per component on one side. Each round's labels
are kept, and composed from the last round back to the first, so their total size is
that of the first round times two at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.plans.runtime import Scratch


def connected_groups(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``node, group_id`` of every node that a pair links to another one; group_id is the group's smallest node.

    Defined cases: pairs with a null end or equal ends link nothing; repeated pairs and
    pairs in both directions count once; extra columns are ignored; an empty table gives
    no rows.
    """
    scratch = Scratch(pairs.sparkSession, "groups")
    keep, sized = scratch.keep, scratch.sized
    edges = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = keep(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        arcs = edges.select(F.inline(F.array(
            F.struct(F.col("u").alias("node"), "u", "v"), F.struct(F.col("v").alias("node"), "u", "v")
        )))
        chosen = arcs.groupBy("node").agg(F.min(F.struct("u", "v")).alias("e"))
        hook = keep(chosen.select("node", F.when(F.col("e.u") == F.col("node"), F.col("e.v")).otherwise(F.col("e.u")).alias("up")))
        back = sized(hook).select(F.col("node").alias("up"), F.col("up").alias("up2"))
        mutual = (F.col("up2") == F.col("node")) & (F.col("node") < F.col("up"))
        tree = keep(sized(hook).join(back, "up").select("node", F.when(mutual, F.col("node")).otherwise(F.col("up")).alias("up")))
        scratch.drop(hook)
        while True:
            step = sized(tree).select(F.col("node").alias("up"), F.col("up").alias("up2"))
            new = keep(sized(tree).join(step, "up").select("node", F.col("up2").alias("up"), (F.col("up2") != F.col("up")).alias("moved")))
            scratch.drop(tree)
            tree = new
            if tree.where("moved").isEmpty():
                break
        levels.append(sized(tree).select("node", "up"))
        left = levels[-1].select(F.col("node").alias("u"), F.col("up").alias("ru"))
        right = levels[-1].select(F.col("node").alias("v"), F.col("up").alias("rv"))
        ends = sized(edges).join(left, "u").join(right, "v").where("ru <> rv")
        new = keep(ends.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())
        scratch.drop(edges)
        edges = new
    if not levels:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("group_id"))
    final = levels[-1]
    for level in reversed(levels[:-1]):
        onward = final.select(F.col("node").alias("up"), F.col("up").alias("top"))
        final = level.join(onward, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
    final = keep(final)
    final = sized(final)
    smallest = final.groupBy("up").agg(F.min("node").alias("group_id"))
    return final.join(smallest, "up").select("node", "group_id")
