"""Contexts and scopes: which contexts a query sees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.operators.fixpoint import reach


def resolve_scope(
    contexts: DataFrame, include: list[str] | DataFrame | None = None, exclude: list[str] | None = None, descendants: bool = True,
    ancestors: bool = False, kinds: list[str] | None = None, exclude_kinds: list[str] | None = None,
) -> DataFrame:
    """``context`` of every context in scope. ``contexts``: iri, kind, parent.

    No include means all contexts. Include seeds are closed over descendants and
    ancestors as asked, the excluded contexts themselves are removed (not what lies below
    them), kind filters come last; seeds that don't exist drop out. Loops among parents end the closure.
    """
    nodes = contexts.select(F.col("iri").alias("node"), "kind").distinct()

    def closed(seeds: list[str] | DataFrame) -> DataFrame:
        if isinstance(seeds, DataFrame):
            frame = nodes.join(seeds.select("node").distinct(), "node", "left_semi").select("node")
        else:
            frame = nodes.where(F.col("node").isin(seeds)).select("node")
        out = frame
        if descendants:
            out = out.unionByName(reach(contexts.select(F.col("parent").alias("src"), F.col("iri").alias("dst")), frame).select("node"))
        if ancestors:
            out = out.unionByName(reach(contexts.select(F.col("iri").alias("src"), F.col("parent").alias("dst")), frame).select("node"))
        return out.distinct()

    got = nodes if not isinstance(include, DataFrame) and not include else nodes.join(closed(include), "node", "left_semi")
    if exclude:
        got = got.where(~F.col("node").isin(exclude))
    if kinds:
        got = got.where(F.col("kind").isin(kinds))
    if exclude_kinds:
        got = got.where(~F.coalesce(F.col("kind").isin(exclude_kinds), F.lit(False)))
    return got.select(F.col("node").alias("context")).distinct()


def scope_under_hypothesis(hypothesis: str) -> dict:
    return {"include": [hypothesis], "descendants": True, "ancestors": True}


def scope_as_of(snapshot: str) -> dict:
    return {"include": [snapshot], "descendants": False, "ancestors": True}


def resolve_named(contexts: DataFrame, presets: dict[str, dict], preset: str | None = None, inline: dict | None = None) -> DataFrame:
    """Scope by preset name or inline, not both; an unknown name is an error."""
    if preset and inline:
        raise ValueError("a preset and an inline scope exclude each other")
    if preset and preset not in presets:
        raise KeyError(preset)
    return resolve_scope(contexts, **(presets[preset] if preset else inline or {}))


def contexts_with_env(contexts: DataFrame, env: DataFrame, required: dict[str, str]) -> DataFrame:
    """Contexts whose environment holds every required key and value; no requirement means all."""
    if not required:
        return contexts.select(F.col("iri").alias("context")).distinct()
    hit = F.lit(False)
    for k, v in required.items():
        hit = hit | ((F.col("key") == k) & (F.col("value") == v))
    n = F.count_distinct("key")
    return env.where(hit).groupBy("context").agg(n.alias("n")).where(F.col("n") == len(required)).select("context")


def context_ancestors(parents: DataFrame, contexts: DataFrame, seeds: DataFrame, max_depth: int = 16) -> DataFrame:
    """``seed, node, depth`` over typed extra parents and the single parent together."""
    edges = parents.select(F.col("context").alias("src"), F.col("parent_context").alias("dst")).unionByName(
        contexts.select(F.col("iri").alias("src"), F.col("parent").alias("dst"))
    )
    return reach(edges, seeds, max_depth, include_seeds=False)


def statement_contexts(claims: DataFrame, extra: DataFrame) -> DataFrame:
    """``statement_id, context, role`` of primary and secondary memberships."""
    main = claims.select("statement_id", "context", F.lit("primary").alias("role"))
    return main.unionByName(extra.select("statement_id", "context", "role"))
