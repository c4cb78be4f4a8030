"""Evidence, arguments, reactions, reviews and overlays over claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ATTACKS = ["rebuts", "undercuts"]


def contradiction_frontier(arguments: DataFrame, context: str | None = None) -> DataFrame:
    """``statement_id, attack_count, support_count, net_pressure`` of attacked targets (open edges)."""
    rows = arguments.where("tx_hi is null") if "tx_hi" in arguments.columns else arguments
    if context is not None:
        rows = rows.where(F.col("context") == context)
    attack, support = F.count_if(F.col("relation").isin(ATTACKS)), F.count_if(F.col("relation") == "supports")
    out = rows.groupBy(F.col("target").alias("statement_id")).agg(attack.alias("attack_count"), support.alias("support_count"))
    return out.where("attack_count > 0").withColumn("net_pressure", F.col("support_count") - F.col("attack_count"))


def arguments_for(arguments: DataFrame) -> DataFrame:
    """Open edges by the statement they touch: ``statement_id, argument_id, role, relation``."""
    ends = F.array(F.struct(F.col("source").alias("statement_id"), F.lit("source").alias("role")), F.struct(F.col("target").alias("statement_id"), F.lit("target").alias("role")))
    rows = arguments.where("tx_hi is null") if "tx_hi" in arguments.columns else arguments
    return rows.select("argument_id", "relation", F.explode(ends).alias("e")).select("e.statement_id", "argument_id", "e.role", "relation")


def endorsement_weights(reactions: DataFrame) -> DataFrame:
    """``target, weight, n``: endorsements minus rejections; polarity of the reaction rows plays no part."""
    score = F.when(F.col("kind") == "endorses", 1).when(F.col("kind") == "rejects", -1).otherwise(0)
    return reactions.where(F.col("kind").isin("endorses", "rejects")).groupBy("target").agg(F.sum(score).alias("weight"), F.count("*").alias("n"))


def confidence_lens(lanes: DataFrame, lens: str = "machine") -> DataFrame:
    """``statement_id, value``: one lane with the machine value as fallback; ``multi`` is the mean of the lanes present."""
    m = F.col("confidence")
    if lens == "multi":
        have = F.filter(F.array("confidence", "calibrated", "human", "reliability"), lambda x: x.isNotNull())
        value = F.aggregate(have, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(have), F.lit(0))
    else:
        lane = {"calibrated": "calibrated", "human": "human", "source_weighted": "reliability"}.get(lens)
        value = F.coalesce(F.col(lane), m) if lane else m
    return lanes.select("statement_id", value.alias("value"))


def obligation_summary(obligations: DataFrame) -> DataFrame:
    return obligations.groupBy("obligation_type", "status").agg(F.count("*").alias("cnt"))


def review_queue(reviews: DataFrame) -> DataFrame:
    """Per target: last decision (ties: the larger review id), its time, number of reviews."""
    return reviews.groupBy("target_id").agg(
        F.max_by("decision", F.struct("created_at", "review_id")).alias("last_decision"), F.max("created_at").alias("last_review_at"), F.count("*").alias("review_count")
    )


def lifecycle_stages(claims: DataFrame, stages: dict[str, DataFrame], absent: dict[str, DataFrame] | None = None) -> DataFrame:
    """``context, stage, reached_count, total_count, coverage`` in one pass.

    ``stages``: name to a frame with ``statement_id`` of the claims that reached it;
    ``absent``: likewise for stages reached by not being listed. Each list is reduced to
    distinct ids and joined once; nothing is looked up per row.
    """
    out = claims.select("statement_id", "context")
    for negate, group in ((False, stages), (True, absent or {})):
        for name, ids in group.items():
            mark = ids.select("statement_id").distinct().withColumn(f"_{name}", F.lit(True))
            out = out.join(mark, "statement_id", "left").withColumn(f"_{name}", F.col(f"_{name}").isNull() if negate else F.col(f"_{name}").isNotNull())
    names = [*stages, *(absent or {})]
    rows = F.array(*[F.struct(F.lit(n).alias("stage"), F.col(f"_{n}").alias("reached")) for n in names])
    got = out.select("context", F.inline(rows)).groupBy("context", "stage").agg(F.count_if("reached").alias("reached_count"), F.count("*").alias("total_count"))
    return got.withColumn("coverage", F.format_string("%.1f%%", 100.0 * F.col("reached_count") / F.col("total_count")))


def spans_overlapping(spans: DataFrame, queries: DataFrame, cell: int = 1_000) -> DataFrame:
    """``query_id, span_id`` of spans overlapping query ranges of the same revision (half-open).

    Spans and queries meet on the cells of ``cell`` offsets that they touch, an equi-join;
    a pair is kept in the first cell both touch, so it comes out once.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor((F.greatest(F.col(b), F.col(a) + 1) - 1) / cell)))
    s = spans.select("span_id", "revision_id", "start_offset", "end_offset", cells("start_offset", "end_offset").alias("cell"))
    q = queries.select("query_id", "revision_id", F.col("start_offset").alias("qs"), F.col("end_offset").alias("qe"), cells("start_offset", "end_offset").alias("cell"))
    met = s.join(q, ["revision_id", "cell"]).where("start_offset < qe and end_offset > qs")
    return met.where(F.col("cell") == F.floor(F.greatest("start_offset", "qs") / cell)).select("query_id", "span_id")


def revision_lineage(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Ancestors of revisions through their derived-from arrays: ``seed, node, depth``."""
    from claimweave.operators.fixpoint import reach

    exploded = edges.select(F.col("revision_id").alias("src"), F.explode("derived_from").alias("dst"))
    return reach(exploded, seeds)


def shape_functional(claims: DataFrame) -> DataFrame:
    """Subjects with more than one value of a predicate among open asserted rows."""
    rows = claims.where("tx_hi is null and polarity = 'asserted'")
    return rows.groupBy("subject", "predicate").agg(F.count_distinct(F.coalesce("object_iri", "object_lit")).alias("n_values")).where("n_values > 1")


def shape_datatype(claims: DataFrame, predicate_types: DataFrame) -> DataFrame:
    """Verdict per literal of a typed predicate: pass if its dt is the declared one, else warn."""
    typed = claims.where("tx_hi is null").join(predicate_types.select("predicate", "datatype"), "predicate")
    dt = F.get_json_object("object_lit", "$.dt")
    return typed.select("statement_id", F.when(dt == F.col("datatype"), "pass").otherwise("warn").alias("verdict"))


def shape_numeric(claims: DataFrame) -> DataFrame:
    """Verdict of literals marked numeric: pass if the value casts to a number, else warn."""
    dt, v = F.get_json_object("object_lit", "$.dt"), F.get_json_object("object_lit", "$.v")
    rows = claims.where("tx_hi is null").where(dt.isin("xsd:integer", "xsd:decimal", "xsd:double"))
    return rows.select("statement_id", F.when(v.try_cast("double").isNotNull(), "pass").otherwise("warn").alias("verdict"))


def emit_inverse(claims: DataFrame, predicate: str, inverse: str) -> DataFrame:
    """Derived (object, inverse, subject) rows that no open row states yet; inverse = predicate gives the symmetric closure."""
    open_ = claims.where("tx_hi is null and polarity = 'asserted' and object_iri is not null")
    turned = open_.where(F.col("predicate") == predicate).select(F.col("object_iri").alias("subject"), F.lit(inverse).alias("predicate"), F.col("subject").alias("object_iri")).distinct()
    return turned.join(open_.select("subject", "predicate", "object_iri").distinct(), ["subject", "predicate", "object_iri"], "left_anti")
