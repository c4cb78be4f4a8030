"""Parent-child links to full hierarchies of any depth.

Method: heavy-path decomposition after cycle separation. Ancestor pointers are doubled;
each doubling also adds up the subtree sizes below (a node's size within 2**(k+1) levels
is its own within 2**k plus those of the nodes whose 2**k-th ancestor it is), so sizes
take log(depth) rounds. Nodes whose pointers never run out belong to a loop or hang
below one. Every inner node's largest child continues its chain; a node's chain and
position come from doubling along heavy edges. Chains form a tree of at most log2(n)
levels, so a path is a short list of chain prefixes, concatenated by doubling over
chains. A node's descendants are the nodes whose list holds its chain at its position or
further down; paths and descendants are read off blocks of chain positions.

All steps are equi-joins and partial aggregates on node keys; each round is written to
the shared folder, which cuts lineage. The number of rounds follows the logarithm of the
depth, not of the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.plans.runtime import Scratch


BLOCK = 1_024  # chain positions per row


@dataclass
class Hierarchy:
    """``nodes``: node, parent, root, depth, chain, pos, size, path (array of chain, upto).

    ``size`` counts the node and its descendants. In a loop or below one: root is the
    loop's smallest node, depth is -1, chain and path are null, size is null.
    """

    nodes: DataFrame

    def _steps(self) -> DataFrame:
        """``node, seg, block, members``: the chain segments above each node, members in order, at most ``BLOCK`` a row.

        Chains are cut into blocks of fixed length, and a node asks for the blocks its
        prefix reaches into, so the work follows the output and no row holds a whole chain.
        """
        t = self.nodes.where("depth >= 0")
        at = F.expr(f"pos div {BLOCK}").alias("block")
        held = t.groupBy("chain", at).agg(F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("m"))
        held = held.select("chain", "block", F.col("m.node").alias("m"))
        parts = t.select("node", F.posexplode("path").alias("seg", "s")).select("node", "seg", F.col("s.chain").alias("chain"), F.col("s.upto").alias("upto"))
        parts = parts.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"upto div {BLOCK}"))))
        return parts.join(held, ["chain", "block"]).select(
            "node", "seg", "block", F.slice("m", F.lit(1), F.least(F.col("upto") - F.col("block") * BLOCK + 1, F.lit(BLOCK)).cast("int")).alias("members")
        )

    def full_paths(self) -> DataFrame:
        """``node, path``: array of nodes from the root down to the node itself (tree nodes only)."""
        # a path has depth + 1 entries: the output row itself is that long
        got = self._steps().groupBy("node").agg(F.sort_array(F.collect_list(F.struct("seg", "block", "members"))).alias("p"))
        return got.select("node", F.flatten("p.members").alias("path"))

    def descendants(self, ancestors: DataFrame | None = None) -> DataFrame:
        """``ancestor, node`` pairs, the node itself excluded; ``ancestors`` (column ``node``) limits whose."""
        pairs = self._steps().select(F.explode("members").alias("ancestor"), "node").where("ancestor <> node")
        if ancestors is None:
            return pairs
        return pairs.join(ancestors.select(F.col("node").alias("ancestor")).distinct(), "ancestor", "left_semi")


def build_hierarchy(df: DataFrame, node: str, parent: str, order: str) -> Hierarchy:
    """Hierarchy of ``node`` -> ``parent`` links; of several rows for a node the lowest ``order`` counts.

    Defined cases: parents are trimmed; a null or blank parent, or one that has no row
    of its own, makes a root; a node that is its own parent is a loop of one; null nodes
    are left out; equal rows count once; rows of a node with equal order and different
    parents: the smallest parent, null last; extra columns are ignored; an empty table
    gives no rows.
    """
    scratch = Scratch(df.sparkSession, "hierarchy")
    keep = scratch.keep
    up = F.nullif(F.regexp_replace(F.col(parent), r"^\s+|\s+$", ""), F.lit(""))
    rows = df.where(F.col(node).isNotNull()).select(F.col(node).alias("node"), up.alias("parent"), F.col(order).alias("o"))
    pick = F.struct(F.col("o").isNull().alias("a"), "o", F.col("parent").isNull().alias("b"), "parent")
    first = rows.groupBy("node").agg(F.min(pick).alias("m")).select("node", F.col("m.parent").alias("parent"))
    exists = first.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
    nodes = keep(first.join(exists, "parent", "left").select("node", F.when(F.col("there"), F.col("parent")).alias("parent")))

    # ancestors at 2**k and sizes within 2**k levels
    live = None
    state, now = scratch.keep_counting(nodes.select("node", F.col("parent").alias("anc"), F.lit(1).cast("long").alias("size")), "anc is not null")
    while now and now != live:
        live = now
        gained = state.where("anc is not null").groupBy("anc").agg(F.sum("size").alias("more")).withColumnRenamed("anc", "node")
        step = state.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"))
        new, now = scratch.keep_counting(
            state.join(step, "anc", "left").select("node", F.col("anc2").alias("anc"), "size")
            .join(gained, "node", "left").select("node", "anc", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")),
            "anc is not null",
        )
        scratch.drop(state)
        state = new
    loops = _loops(scratch, nodes, state.where("anc is not null")) if live and now else None
    tree = keep(nodes.join(state.where("anc is null").select("node", "size"), "node"))
    scratch.drop(state)

    # chains: each node's largest child (ties: the smallest) continues its chain
    best = tree.where("parent is not null").groupBy("parent").agg(F.min(F.struct((-F.col("size")).alias("s"), "node")).alias("m"))
    heavy = best.select(F.col("m.node").alias("node"), F.lit(True).alias("heavy"))
    chain = keep(
        tree.join(heavy, "node", "left").select(
            "node", F.when(F.col("heavy"), F.col("parent")).otherwise(F.col("node")).alias("chain"),
            F.when(F.col("heavy"), 1).otherwise(0).cast("long").alias("pos"),
        )
    )
    while True:
        step = chain.select(F.col("node").alias("chain"), F.col("chain").alias("chain2"), F.col("pos").alias("pos2"))
        moved = chain.join(step, "chain").select("node", F.col("chain2").alias("chain"), (F.col("pos") + F.col("pos2")).alias("pos"), (F.col("pos2") > 0).alias("moved"))
        new, n = scratch.keep_counting(moved, "moved")
        scratch.drop(chain)
        chain = new
        if not n:
            break

    # chains hang on chains: concatenate prefixes by doubling
    heads = tree.join(chain.where("node = chain").select("node"), "node", "left_semi").select(F.col("node").alias("chain"), F.col("parent").alias("at"))
    hang = chain.select(F.col("node").alias("at"), F.col("chain").alias("up"), F.col("pos").alias("upto"))
    prefix = F.when(F.col("up").isNotNull(), F.array(F.struct(F.col("up").alias("chain"), "upto"))).otherwise(
        F.expr("cast(array() as array<struct<chain:string,upto:bigint>>)")
    )
    tops, n = scratch.keep_counting(
        heads.join(hang, "at", "left").select("chain", "up", F.coalesce(F.col("upto") + 1, F.lit(0)).alias("base"), prefix.alias("path")), "up is not null"
    )
    while n:
        step = tops.select(F.col("chain").alias("up"), F.col("up").alias("up2"), F.col("base").alias("base2"), F.col("path").alias("path2"))
        new, n = scratch.keep_counting(
            tops.join(step, "up", "left").select(
                "chain", F.col("up2").alias("up"), (F.col("base") + F.coalesce("base2", F.lit(0))).alias("base"),
                F.when(F.col("path2").isNull(), F.col("path")).otherwise(F.concat("path2", "path")).alias("path"),
            ),
            "up is not null",
        )
        scratch.drop(tops)
        tops = new
    own = F.array(F.struct("chain", F.col("pos").alias("upto")))
    placed = chain.join(tops, "chain").select(
        "node", F.coalesce(F.get("path", F.lit(0))["chain"], F.col("chain")).alias("root"),
        (F.col("base") + F.col("pos")).cast("int").alias("depth"), "chain", "pos", F.concat("path", own).alias("path"),
    )
    out = placed.join(tree, "node").select("node", "parent", "root", "depth", "chain", "pos", "size", "path")
    if loops is not None:
        kinds = dict(out.dtypes)
        rest = loops.join(nodes, "node").select(
            "node", "parent", "root", F.lit(-1).alias("depth"),
            *[F.lit(None).cast(kinds[c]).alias(c) for c in ("chain", "pos", "size", "path")],
        )
        out = out.unionByName(rest)
    return Hierarchy(keep(out))


def _loops(scratch: Scratch, nodes: DataFrame, rest: DataFrame) -> DataFrame:
    """``node, root`` of the nodes whose ancestors never end: root is the smallest node of their loop."""
    state, seen = scratch.keep(rest.select("node", "anc")), None
    while True:  # far enough up, pointers only reach the loops themselves, and all of them
        image = state.select("anc").distinct().count()
        if image == seen:
            break
        seen = image
        step = state.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"))
        state = scratch.keep(state.join(step, "anc").select("node", F.col("anc2").alias("anc")))
    ring = state.select(F.col("anc").alias("node")).distinct()
    ring = scratch.keep(nodes.join(ring, "node", "left_semi").select("node", F.col("parent").alias("next"), F.least("node", "parent").alias("low")))
    reach = 2
    while reach < 2 * seen:
        step = ring.select(F.col("node").alias("next"), F.col("next").alias("next2"), F.col("low").alias("low2"))
        ring = scratch.keep(ring.join(step, "next").select("node", F.col("next2").alias("next"), F.least("low", "low2").alias("low")))
        reach *= 2
    return state.join(ring.select(F.col("node").alias("anc"), F.col("low").alias("root")), "anc").select("node", "root")
