"""Fixed vocabularies of the claim model and checks against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The code lists of the claim model, in their order.
VOCABULARIES = {
    "argument_relation": "supports rebuts undercuts qualifies explains alternative_analysis_of same_evidence_different_analysis same_claim_different_schema supersedes",
    "alignment_relation": "exact_match close_match broad_match narrow_match inverse_of decomposes_to has_value_mapping incompatible_with derived_from local_specialization not_equivalent",
    "polarity": "asserted negated unknown absent conflicting",
    "modality": "descriptive prescriptive reconstructed inferred elicited corpus_observed typological_summary experimental_result clinical_observation legal_holding archival_metadata oral_history community_protocol model_output other",
    "context_kind": "source source_version dataset_release project hypothesis identity_lens schema_lens review_lens community_policy_scope language_or_variety corpus experiment jurisdiction clinical_cohort historical_period user_workspace release_view derived snapshot user custom",
    "obligation_kind": "needs_evidence needs_policy needs_review needs_identity_resolution needs_alignment_review needs_anchor_repair needs_contradiction_review needs_formal_validation needs_community_authority",
}
MATURITY_LADDER = [(0, "E0", "Raw"), (1, "E1", "Candidate"), (2, "E2", "Evidence-supported"), (3, "E3", "Reviewed"), (5, "E4", "Corroborated"), (4, "E5", "Certified")]
# Keys that a locator of each kind must have.
ANCHOR_KEYS = {
    "whole_source": "", "char_span": "start end", "page_box": "page x y w h", "image_box": "x y w h", "media_time": "start_ms end_ms", "table_cell": "row_id column",
    "csv_row": "row_index columns", "json_pointer": "pointer", "xml_xpath": "xpath", "html_css": "selector", "token_range": "sentence_id start end", "annotation_id": "annotation_id",
}


def vocabulary(spark: SparkSession, name: str) -> DataFrame:
    """``value, place`` of one code list."""
    return spark.createDataFrame([(v, i) for i, v in enumerate(VOCABULARIES[name].split())], "value string, place int")


def maturity_ladder(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*row, i) for i, row in enumerate(MATURITY_LADDER)], "stored int, level string, name string, place int")


def is_member(value: Column, name: str) -> Column:
    return F.coalesce(value.isin(VOCABULARIES[name].split()), F.lit(False))


def maturity_name(stored: Column) -> Column:
    """Stored number to the name of its rung, null off the ladder."""
    out = F.lit(None).cast("string")
    for number, _, name in MATURITY_LADDER:
        out = F.when(stored == number, name).otherwise(out)
    return out


def valid_locator(kind: Column, locator: Column) -> Column:
    """Whether a JSON locator has the keys its kind needs; null for an unknown kind."""
    keys, out = F.coalesce(F.json_object_keys(locator), F.array().cast("array<string>")), F.lit(None).cast("boolean")
    for name, needed in ANCHOR_KEYS.items():
        needs = F.array(*map(F.lit, needed.split())).cast("array<string>")
        out = F.when(kind == name, F.size(F.array_except(needs, keys)) == 0).otherwise(out)
    return out
