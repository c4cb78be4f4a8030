"""Claim-model views over the given tables, for registered queries; SQL counterparts beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.operators.claims import COLUMNS
from claimweave.plans.runtime import table

CLAIMS_SQL = "claims AS (SELECT DISTINCT statement_id, subject, predicate, object_iri, object_lit, context, polarity, maturity, valid_lo, valid_hi, tx_lo, tx_hi FROM history)"
CONTEXTS_SQL = "ctx AS (SELECT iri, arg_min(kind, req_id) AS kind, arg_min(nullif(trim(coalesce(parent, '')), ''), req_id) AS parent FROM contexts WHERE iri IS NOT NULL GROUP BY iri)"
ALIGN_SQL = "al AS (SELECT DISTINCT trim(source) AS source, trim(target) AS target, replace(replace(lower(trim(relation)), '-', '_'), ' ', '_') AS relation, confidence FROM alignments WHERE source IS NOT NULL AND target IS NOT NULL AND trim(source) <> '' AND trim(target) <> '' AND trim(source) <> trim(target))"
ARGS_SQL = (
    "args AS (SELECT statement_id || '>' || target AS argument_id, statement_id AS source, target, CASE ascii(statement_id) % 5 WHEN 0 THEN 'supports' "
    "WHEN 1 THEN 'rebuts' WHEN 2 THEN 'undercuts' WHEN 3 THEN 'qualifies' ELSE 'endorses' END AS relation, context "
    "FROM (SELECT DISTINCT statement_id, context, unnest(lineage) AS target FROM history) WHERE target <> statement_id)"
)


def claims(spark: SparkSession, folder: str) -> DataFrame:
    """History rows as claims, repeated rows once."""
    return table(spark, folder, "history").select(*COLUMNS).distinct()


def contexts(spark: SparkSession, folder: str) -> DataFrame:
    parent = F.nullif(F.trim(F.coalesce("parent", F.lit(""))), F.lit(""))
    rows = table(spark, folder, "contexts").where("iri is not null")
    first = rows.groupBy("iri").agg(F.min_by(F.struct("kind", parent.alias("parent")), "req_id").alias("v"))
    return first.select("iri", "v.kind", "v.parent")


def alignments(spark: SparkSession, folder: str) -> DataFrame:
    name = F.translate(F.lower(F.trim("relation")), "- ", "__")
    rows = table(spark, folder, "alignments").select(F.trim("source").alias("source"), F.trim("target").alias("target"), name.alias("relation"), "confidence")
    return rows.where("source <> '' and target <> '' and source <> target").distinct().withColumn("tx_hi", F.lit(None).cast("timestamp"))


def predicates(spark: SparkSession, folder: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, folder, "predicate_types").select(
        F.col("predicate").alias("iri"), F.lit("active").alias("status"), none.alias("canonical_of"), none.alias("inverse_of")
    ).distinct()


def arguments(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "history").select("statement_id", "context", F.explode("lineage").alias("target")).distinct().where("target <> statement_id")
    kind = F.ascii("statement_id") % 5
    relation = F.when(kind == 0, "supports").when(kind == 1, "rebuts").when(kind == 2, "undercuts").when(kind == 3, "qualifies").otherwise("endorses")
    return rows.select(F.concat_ws(">", "statement_id", "target").alias("argument_id"), F.col("statement_id").alias("source"), "target", relation.alias("relation"), "context")


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("doc_id")
    decision = F.when(n % 7 == 0, "mark_sensitive").when(n % 3 == 0, "reject").otherwise("accept")
    return table(spark, folder, "documents").select("doc_id", "source", "created_at").distinct().select(
        n.alias("review_id"), F.coalesce("source", F.lit("none")).alias("target_id"), decision.alias("decision"), (n % 9).alias("reviewer_id"),
        F.col("source").alias("review_context"), "created_at",
    )


REVIEWS_SQL = (
    "rv AS (SELECT doc_id AS review_id, coalesce(source, 'none') AS target_id, CASE WHEN doc_id % 7 = 0 THEN 'mark_sensitive' WHEN doc_id % 3 = 0 THEN 'reject' "
    "ELSE 'accept' END AS decision, doc_id % 9 AS reviewer_id, source AS review_context, created_at FROM (SELECT DISTINCT doc_id, source, created_at FROM documents))"
)


def capsules(spark: SparkSession, folder: str) -> DataFrame:
    """One policy per source: action i is allowed when (source number + i) mod 3 is not 0; every fifth is revoked."""
    from claimweave.operators.policy import ACTIONS

    number = F.substring("id", 6, 2).cast("int")
    allowed = F.map_from_arrays(F.array(*map(F.lit, ACTIONS)), F.array(*[(number + i) % 3 != 0 for i in range(len(ACTIONS))]))
    return table(spark, folder, "sources").select(
        F.col("id").alias("policy_iri"), F.when(number % 5 == 4, "revoked").otherwise("active").alias("status"), F.lit(None).cast("timestamp").alias("expiry"), allowed.alias("allowed")
    )
