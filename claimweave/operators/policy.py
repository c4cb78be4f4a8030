"""Access policies: effective actions, attestations, authorisation, evidence-based denial."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Action keys of a policy capsule.
ACTIONS = (
    "read_metadata read_content quote view_anchor_location derive_claims derive_embeddings translate summarize export_claims "
    "export_sources export_anchors train_model publish_release share_with_third_party federated_query"
).split()
DEFAULT_ALLOWED = ["read_metadata"]  # of a target without any assignment


def effective_actions(assignments: DataFrame, capsules: DataFrame, now=None) -> DataFrame:
    """``target_kind, target_id, action, allowed`` for assigned targets, one row per action.

    Every active, unexpired capsule must allow the action; a missing key denies; a target
    whose capsules are all inactive is denied everything. ``capsules``: policy_iri, status,
    expiry, allowed (map of booleans).
    """
    clock = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    live = capsules.where("status = 'active'").where(F.col("expiry").isNull() | (F.col("expiry") > clock))
    joined = assignments.select("target_kind", "target_id", "policy_iri").distinct().join(live.select("policy_iri", "allowed"), "policy_iri", "left")
    votes = F.array(*[F.struct(F.lit(a).alias("action"), F.when(F.col("allowed").isNotNull(), F.coalesce(F.try_element_at("allowed", F.lit(a)), F.lit(False))).alias("ok")) for a in ACTIONS])
    rows = joined.select("target_kind", "target_id", F.inline(votes))
    return rows.groupBy("target_kind", "target_id", "action").agg(F.coalesce(F.bool_and("ok"), F.lit(False)).alias("allowed"))


def holder_can(attestations: DataFrame, now=None) -> DataFrame:
    """``holder, policy_iri, action`` of live attestations; the action ``all`` stands for every one."""
    clock = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    live = attestations.where("revoked_at is null").where(F.col("expires_at").isNull() | (F.col("expires_at") > clock))
    return live.select("holder", "policy_iri", F.explode("actions").alias("action")).distinct()


def authorise(requests: DataFrame, assignments: DataFrame, capsules: DataFrame, attestations: DataFrame, now=None) -> DataFrame:
    """Adds ``authorised`` to requests (holder, target_kind, target_id, action).

    True if the target's effective actions allow it, or the holder has a live attestation
    on any policy assigned to the target; a target without assignment is refused.
    """
    allowed = effective_actions(assignments, capsules, now).where("allowed").drop("allowed").withColumn("_eff", F.lit(True))
    can = holder_can(attestations, now)
    wide = can.where("action <> 'all'").unionByName(can.where("action = 'all'").select("holder", "policy_iri", F.explode(F.array(*map(F.lit, ACTIONS))).alias("action")))
    held = wide.join(assignments.select("target_kind", "target_id", "policy_iri").distinct(), "policy_iri").select("holder", "target_kind", "target_id", "action").distinct().withColumn("_held", F.lit(True))
    out = requests.join(allowed, ["target_kind", "target_id", "action"], "left").join(held, ["holder", "target_kind", "target_id", "action"], "left")
    return out.withColumn("authorised", F.coalesce("_eff", "_held", F.lit(False))).drop("_eff", "_held")


def denied_statements(links: DataFrame, documents: DataFrame, capsules: DataFrame, action: str) -> DataFrame:
    """``statement_id`` with an open evidence link to a document whose active policy does not allow the action."""
    if action not in ACTIONS:
        raise ValueError(action)
    bad = capsules.where("status = 'active'").where(~F.coalesce(F.try_element_at("allowed", F.lit(action)), F.lit(False))).select("policy_iri")
    docs = documents.join(bad, "policy_iri", "left_semi").select("doc_id")
    return links.where("tx_hi is null").join(docs, "doc_id", "left_semi").select("statement_id").distinct()


def policy_allows(claims: DataFrame, links: DataFrame, documents: DataFrame, capsules: DataFrame, action: str) -> DataFrame:
    """Claims that no linked document's policy denies; claims without link or policy stay."""
    return claims.join(denied_statements(links, documents, capsules, action), "statement_id", "left_anti")
