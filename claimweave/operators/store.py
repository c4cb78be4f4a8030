"""Append-only tables with versions: the write path's register and overlay operators.

A table is a log of rows with a sequence column. Nothing is updated in place: an upsert
appends a version, a close or delete appends a marker, and read views fold the log. All
folds are one partial aggregate on the key (``max_by`` with map-side combine), so a key
with very many versions costs no single task more than its own final row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, key: list[str], seq: str = "seq", deleted: str | None = None) -> DataFrame:
    """Newest version per key; with ``deleted`` (boolean column), keys whose newest version is a tombstone vanish."""
    rest = [c for c in log.columns if c not in key]
    out = log.groupBy(*key).agg(F.max_by(F.struct(*rest), seq).alias("_v")).select(*key, *[F.col(f"_v.{c}").alias(c) for c in rest])
    return out.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else out


def latest_coalesced(log: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """Per key and column the newest value that is not null (partial updates keep earlier values)."""
    rest = [c for c in log.columns if c not in (*key, seq)]
    newest = [F.max_by(F.when(F.col(c).isNotNull(), F.struct(F.col(c))), F.when(F.col(c).isNotNull(), F.col(seq)))[c].alias(c) for c in rest]
    return log.groupBy(*key).agg(*newest, F.max(seq).alias(seq))


def first_wins(log: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """Oldest version per key: get-or-create tables."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.min_by(F.struct(*rest), seq).alias("_v")).select(*key, *[F.col(f"_v.{c}").alias(c) for c in rest])


def append_new(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is not there yet, one per key."""
    return incoming.dropDuplicates(key).join(existing.select(*key).distinct(), key, "left_anti")


def closed(rows: DataFrame, closings: DataFrame, key: str, at: str = "closed_at", hi: str = "tx_hi") -> DataFrame:
    """Rows with ``hi`` set to the earliest closing of their key, where they were still open."""
    first = closings.groupBy(key).agg(F.min(at).alias("_close"))
    return rows.join(first, key, "left").withColumn(hi, F.coalesce(F.col(hi), F.col("_close"))).drop("_close")


@dataclass(frozen=True)
class Register:
    """What one of the engine's register tables accepts and how it is folded.

    ``mode``: ``append``, ``first`` (get or create), ``upsert``, ``coalesce`` (partial
    upsert) or ``close`` (append that can be closed later). ``required`` columns must not
    be null or blank; ``checks`` are SQL conditions every row must meet.
    """

    name: str
    key: tuple[str, ...]
    mode: str
    required: tuple[str, ...] = ()
    checks: tuple[str, ...] = ()
    columns: tuple[str, ...] = field(default=())

    def valid(self) -> Column:
        out = F.lit(True)
        for c in self.required:
            out = out & F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
        for c in self.checks:
            out = out & F.coalesce(F.expr(c), F.lit(False))
        return out

    def split(self, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(accepted, rejected) rows: a bad row is set aside, it doesn't fail the batch."""
        ok = self.valid()
        return incoming.where(ok), incoming.where(~ok)

    def read(self, log: DataFrame, seq: str = "seq") -> DataFrame:
        if self.mode == "upsert":
            return latest(log, list(self.key), seq)
        if self.mode == "coalesce":
            return latest_coalesced(log, list(self.key), seq)
        if self.mode == "first":
            return first_wins(log, list(self.key), seq)
        return log


def _r(name: str, key: str, mode: str, required: str = "", *checks: str) -> Register:
    return Register(name, tuple(key.split()), mode, tuple(required.split()), checks)


_UNIT = "confidence is null or confidence between 0 and 1"
REGISTERS = {
    r.name: r
    for r in (
        _r("context", "iri", "first", "iri", "mode in ('permissive', 'curated')"),
        _r("preset", "name", "upsert", "name scope"),
        _r("context_env", "context key", "upsert", "context key"),
        _r("context_parent", "context parent_context", "first", "context parent_context", "context <> parent_context"),
        _r("statement_context", "statement_id context role", "first", "statement_id context role"),
        _r("predicate", "iri", "coalesce", "iri", "canonical_of is null or canonical_of <> iri"),
        _r("predicate_alias", "alias valid_lo", "first", "alias canonical", "alias <> canonical"),
        _r("alignment", "alignment_id", "close", "source target relation", "source <> target", _UNIT),
        _r("alignment_run", "run_id", "upsert", "run_id"),
        _r("value_mapping", "alignment_id left_value right_value", "upsert", "alignment_id left_value right_value", _UNIT),
        _r("descriptor", "iri", "coalesce", "iri label"),
        _r("predicate_candidate", "iri", "coalesce", "iri label definition subject_type object_type domain"),
        _r("document", "iri", "coalesce", "iri"),
        _r("source", "iri", "coalesce", "iri source_kind policy_id"),
        _r("span", "span_id", "append", "revision_id", "start_offset <= end_offset"),
        _r("annotation_space", "iri", "first", "iri"),
        _r("annotation", "annotation_id", "append", "span_id space_id feature", _UNIT),
        _r("annotation_edge", "edge_id", "append", "source target relation", "source <> target"),
        _r("extraction_run", "run_id", "upsert", "run_id"),
        _r("extraction_chunk", "run_id chunk_index", "upsert", "run_id chunk_index"),
        _r("evidence_link", "link_id", "close", "statement_id link_type", _UNIT),
        _r("section", "section_id", "append", "revision_id title"),
        _r("doc_table", "table_id", "append", "revision_id label"),
        _r("table_cell", "table_id row_idx col_idx", "upsert", "table_id row_idx col_idx"),
        _r("mention", "mention_id", "append", "span_id mention_type", _UNIT),
        _r("coref_cluster", "cluster_id", "append", "revision_id"),
        _r("temporal_expression", "expression_id", "append", "span_id raw_text"),
        _r("content_region", "region_id", "append", "revision_id region_type"),
        _r("reference", "reference_id", "append", "citing_doc"),
        _r("blob", "sha256", "coalesce", "sha256 byte_size", "byte_size >= 0", "length(sha256) = 64"),
        _r("agent", "iri", "first", "iri"),
        _r("agent_context", "agent_id context", "upsert", "agent_id context"),
        _r("argument", "argument_id", "close", "source target relation", "source <> target", "strength is null or strength between 0 and 1"),
        _r("obligation", "obligation_id", "upsert", "statement_id obligation_type"),
        _r("review", "review_id", "append", "target_type target_id decision reviewer_id rationale", _UNIT),
        _r("shape", "iri", "coalesce", "iri kind body"),
        _r("shape_annotation", "statement_id shape_iri", "close", "statement_id shape_iri verdict", "verdict in ('pass', 'warn', 'violate')"),
        _r("rule", "iri", "coalesce", "iri kind body"),
        _r("certificate", "statement_id", "upsert", "statement_id kind"),
        _r("event", "event_id", "append", "target_kind target_id event_type"),
        _r("modality", "statement_id", "upsert", "statement_id modality"),
        _r("extraction_level", "statement_id", "upsert", "statement_id level"),
        _r("confidence", "statement_id", "coalesce", "statement_id", _UNIT),
        _r("hypothesis_only", "statement_id", "first", "statement_id"),
        _r("claim_kind", "statement_id", "upsert", "statement_id claim_kind"),
        _r("claim_frame", "frame_id", "upsert", "frame_type primary_context"),
        _r("frame_role", "role_id", "append", "frame_id role value_kind"),
        _r("entity_symbol", "iri_hash", "first", "iri"),
        _r("entity_mention", "mention_id", "append", "symbol_id surface_text"),
        _r("identity_edge", "edge_id", "close", "left right relation", "left < right", "confidence between 0 and 1"),
        _r("identity_hypothesis", "name", "upsert", "name"),
        _r("identity_proposal", "proposal_id", "upsert", "kind", "size(entity_refs) >= 2"),
        _r("entity_label", "symbol_id label", "upsert", "symbol_id label"),
        _r("external_id", "symbol_id registry external_id", "first", "symbol_id registry external_id"),
        _r("vector", "subject_type subject_id model_id", "upsert", "subject_type subject_id model_id", "size(embedding) > 0"),
        _r("literal", "canonical_hash", "first", "datatype"),
        _r("temporal_relation", "relation_id", "append", "left_event right_event", "allen_bitset between 1 and 8191"),
        _r("access_assignment", "target_kind target_id policy_iri", "upsert", "target_kind target_id policy_iri"),
        _r("attestation", "attestation_id", "upsert", "holder issuer policy_iri rationale"),
        _r("release", "release_id", "upsert", "release_id"),
        _r("retrofit", "statement_id", "upsert", "statement_id retrofit_reason"),
    )
}


def write(name: str, incoming: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rejected rows) for one of the registers; get-or-create registers drop keys already there."""
    register = REGISTERS[name]
    good, bad = register.split(incoming)
    if register.mode == "first":
        good = append_new(existing, good, list(register.key)) if existing is not None else good.dropDuplicates(list(register.key))
    return good, bad
