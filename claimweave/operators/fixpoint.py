"""Reachability over edges: the engine's recursive operators.

Semi-naive: only nodes first reached in the last round are joined again, reached pairs
are removed by an anti join, and each round is written to the shared folder. Every round
is an equi-join; a node with very many edges is split by adaptive skew handling like any
other join key. Cycles end because nothing new is reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.plans.runtime import Scratch


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, include_seeds: bool = True) -> DataFrame:
    """``seed, node, depth``: nodes reachable from each seed along ``src -> dst``, smallest depth each.

    ``seeds`` has a column ``node``. Null ends are ignored; repeated edges change nothing;
    a seed without edges reaches itself. ``include_seeds`` false drops depth 0; a seed on
    a cycle is then still not reported.
    """
    scratch = Scratch(edges.sparkSession, "reach")
    e = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    start = seeds.where("node is not null").select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth")).distinct()
    parts = [scratch.keep(start)]
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = parts[-1].join(e, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        seen = parts[0].select("seed", "node")
        for p in parts[1:]:
            seen = seen.unionByName(p.select("seed", "node"))
        new = scratch.keep(step.join(seen, ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        parts.append(new)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if include_seeds else out.where("depth > 0")


def transitive_closure(edges: DataFrame) -> DataFrame:
    """Distinct ``src, dst`` pairs joined by one edge or more; pairs on cycles include a node with itself."""
    scratch = Scratch(edges.sparkSession, "closure")
    e = scratch.keep(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    all_pairs, new = e, e
    while True:
        step = new.alias("n").join(e.alias("e"), F.expr("n.dst = e.src")).select("n.src", "e.dst").distinct()
        new = scratch.keep(step.join(all_pairs, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return all_pairs
        all_pairs = scratch.keep(all_pairs.unionByName(new))
