"""Evidence substrate, reactions, obligations, shapes, frames and identity over claims.

Every operator takes and returns DataFrames and works on all rows at once: what the
model calls a lookup is a join with the ids asked for, so one id and a billion take the
same plan. Open rows are those whose ``tx_hi`` is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.operators.fixpoint import reach
from claimweave.operators.store import latest

REACTIONS = ["endorses", "rejects", "cites", "supersedes"]


def open_rows(rows: DataFrame) -> DataFrame:
    return rows.where("tx_hi is null")


def of(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is among ``ids`` (one column)."""
    return rows.join(ids.toDF(column).distinct(), column, "left_semi")


# documents and their parts


def add_revisions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows to append, numbered on from each document's last revision; a body that a document already has adds none.

    ``existing``: document_id, revision_number, content_hash; ``incoming``: document_id,
    body, arrival (order). Numbers come from counting earlier new bodies, not from a window over the table.
    """
    new = incoming.withColumn("content_hash", F.sha2("body", 256)).groupBy("document_id", "content_hash").agg(F.min("arrival").alias("arrival"))
    new = new.join(existing.select("document_id", "content_hash"), ["document_id", "content_hash"], "left_anti")
    top = existing.groupBy("document_id").agg(F.max("revision_number").alias("top"))
    order = new.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("arrival", "content_hash"))).alias("r"))  # revisions of one document
    out = order.join(top, "document_id", "left").select("document_id", "top", F.posexplode("r").alias("i", "r"))
    return out.select("document_id", (F.coalesce("top", F.lit(0)) + F.col("i") + 1).cast("long").alias("revision_number"), "r.content_hash")


def latest_revisions(revisions: DataFrame) -> DataFrame:
    """``document_id, revision_number, content_hash`` of each document's highest revision (ties: the greater hash)."""
    return revisions.groupBy("document_id").agg(F.max(F.struct("revision_number", "content_hash")).alias("v")).select("document_id", "v.*")


def annotations_for(annotations: DataFrame, spans: DataFrame, space: str | None = None, feature: str | None = None) -> DataFrame:
    out = of(annotations, spans, "span_id")
    out = out.where(F.col("space_id") == space) if space is not None else out
    return out.where(F.col("feature") == feature) if feature is not None else out


def edges_from(edges: DataFrame, annotations: DataFrame) -> DataFrame:
    return of(edges, annotations, "source").select("edge_id", "source", "target", "relation")


def edges_to(edges: DataFrame, annotations: DataFrame) -> DataFrame:
    return of(edges, annotations, "target").select("edge_id", "source", "target", "relation")


def evidence_for(links: DataFrame, statements: DataFrame) -> DataFrame:
    """Open evidence links of the statements."""
    return of(open_rows(links), statements, "statement_id")


def retract_links(links: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """The links with those of ``ids`` closed, where they were open."""
    marked = links.join(ids.toDF("link_id").distinct().withColumn("_gone", F.lit(True)), "link_id", "left")
    return marked.withColumn("tx_hi", F.coalesce("tx_hi", F.when(F.col("_gone"), at))).drop("_gone")


def mentions_in_revision(mentions: DataFrame, spans: DataFrame, revisions: DataFrame, mention_type: str | None = None) -> DataFrame:
    rows = mentions if mention_type is None else mentions.where(F.col("mention_type") == mention_type)
    return rows.join(of(spans, revisions, "revision_id").select("span_id", "revision_id"), "span_id")


def table_cells(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Newest version of each cell of the tables, sorted by row and column."""
    return latest(of(cells, tables, "table_id"), ["table_id", "row_idx", "col_idx"]).orderBy("table_id", "row_idx", "col_idx")


def extraction_chunks(chunks: DataFrame, runs: DataFrame) -> DataFrame:
    return latest(of(chunks, runs, "run_id"), ["run_id", "chunk_index"]).orderBy("run_id", "chunk_index")


def expressions_in_range(expressions: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Temporal expressions that overlap a range; null ends are open on either side."""
    a, b = F.col("resolved_from"), F.col("resolved_to")
    return expressions.where((a.isNull() | hi.isNull() | (a <= hi)) & (b.isNull() | lo.isNull() | (b >= lo)))


def references_for(references: DataFrame, documents: DataFrame) -> DataFrame:
    return of(references, documents, "citing_doc").orderBy("citing_doc", "label")


def reference_supports(references: DataFrame, wanted: DataFrame) -> DataFrame:
    """``cited_in`` links for (reference_id, statement_id) pairs whose cited document is known."""
    rows = wanted.join(references.where("cited_doc is not null").select("reference_id", "cited_doc"), "reference_id")
    return rows.select("statement_id", F.lit("cited_in").alias("link_type"), F.col("cited_doc").alias("target_document")).distinct()


def blob_references(revisions: DataFrame) -> DataFrame:
    return revisions.where("content_hash is not null").groupBy("content_hash").agg(F.count("*").alias("n"))


def agent_contexts(bindings: DataFrame, agents: DataFrame) -> DataFrame:
    """``agent_id, context, role``: the newest binding of each agent and context."""
    return latest(of(bindings, agents, "agent_id"), ["agent_id", "context"]).select("agent_id", "context", "role")


def context_agents(bindings: DataFrame, agents: DataFrame, contexts: DataFrame) -> DataFrame:
    return latest(of(bindings, contexts, "context"), ["agent_id", "context"]).join(agents, "agent_id").select("context", "agent_id", "iri", "agent_type", "role")


# reactions and meaning


def react(claims: DataFrame, reactions: DataFrame) -> DataFrame:
    """Claims to append for reactions ``source_stmt, kind, object_iri, context``; sources that don't exist and bad kinds give none.

    Rejections are stored negated, the rest asserted, all at maturity 1; citing and
    superseding need an object.
    """
    good = F.col("kind").isin(REACTIONS) & (F.col("object_iri").isNotNull() | F.col("kind").isin("endorses", "rejects"))
    rows = reactions.where(good).join(claims.select(F.col("statement_id").alias("source_stmt")).distinct(), "source_stmt", "left_semi")
    return rows.select(
        F.concat(F.lit("claim:stmt/"), "source_stmt").alias("subject"), F.concat(F.lit("claim:"), "kind").alias("predicate"),
        F.coalesce("object_iri", F.concat(F.lit("claim:stmt/"), "source_stmt")).alias("object_iri"), "context",
        F.when(F.col("kind") == "rejects", "negated").otherwise("asserted").alias("polarity"), F.lit(1).alias("maturity"),
    ).distinct()


def reactions_for(reactions: DataFrame, statements: DataFrame) -> DataFrame:
    return of(open_rows(reactions), statements, "target")


def align_meaning(pairs: DataFrame) -> DataFrame:
    """``src, dst`` in both directions for pairs ``a, b`` of different statements."""
    rows = pairs.where("a <> b").select("a", "b").distinct()
    return rows.toDF("src", "dst").unionByName(rows.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct()


def meaning_cluster(edges: DataFrame, statements: DataFrame) -> DataFrame:
    """``seed, node``: statements of the same meaning, directly or not, the start included."""
    return reach(edges, statements.toDF("node")).select("seed", "node")


# obligations, arguments, reviews, claim cards


def open_obligations(log: DataFrame, kind: str | None = None, context: str | None = None) -> DataFrame:
    """Newest state of each obligation, if open; most urgent first."""
    rows = latest(log, ["obligation_id"]).where("status = 'open'")
    rows = rows.where(F.col("obligation_type") == kind) if kind else rows
    rows = rows.where(F.col("context") == context) if context else rows
    return rows.orderBy(F.desc("priority"), "created_at", "obligation_id")


def resolve_obligations(log: DataFrame, ids: DataFrame, seq: Column) -> DataFrame:
    """Versions to append that mark the given open obligations resolved."""
    return of(open_obligations(log), ids, "obligation_id").withColumns({"status": F.lit("resolved"), "seq": seq}).select(*log.columns)


def assign_obligations(log: DataFrame, assignments: DataFrame, seq: Column) -> DataFrame:
    """Versions to append with the agents of ``obligation_id, agent``."""
    rows = open_obligations(log).join(assignments.select("obligation_id", "agent"), "obligation_id")
    return rows.withColumns({"assigned_agent": F.col("agent"), "seq": seq}).select(*log.columns)


def latest_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("target_id").agg(F.max_by("review_id", F.struct("created_at", "review_id")).alias("review_id"))


def claim_cards(claims: DataFrame, links: DataFrame, arguments: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per claim: what stands behind it and against it, as counts and the sorted kinds of evidence.

    Each table is reduced per claim before it is joined, so no claim with very many links is collected whole.
    """
    e = open_rows(links).groupBy("statement_id").agg(F.count("*").alias("evidence"), F.sort_array(F.collect_set("link_type")).alias("kinds"))  # a few kinds exist
    a = arguments.groupBy(F.col("target").alias("statement_id")).agg(
        F.count_if(F.col("relation").isin("rebuts", "undercuts")).alias("attacks"), F.count_if(F.col("relation") == "supports").alias("supports")
    )
    r = reviews.groupBy(F.col("target_id").alias("statement_id")).agg(F.count("*").alias("reviews"))
    out = claims
    for part in (e, a, r):
        out = out.join(part, "statement_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("statement_id", "subject", "predicate", n("evidence"), F.array_join("kinds", ",").alias("kinds"), n("attacks"), n("supports"), n("reviews"))


# shapes, rules, events, statistics


def has_verdict(annotations: DataFrame, verdict: str, shape: str | None = None) -> DataFrame:
    rows = open_rows(annotations).where(F.col("verdict") == verdict)
    return (rows.where(F.col("shape_iri") == shape) if shape else rows).select("statement_id").distinct()


def stats_shape(reports: DataFrame) -> DataFrame:
    return reports.groupBy("shape_iri").agg(F.count("*").alias("runs"), F.sum("focus_count").alias("focus"), F.sum("violation_count").alias("violations"), F.max("evaluated_at").alias("last"))


def stats_rule(reports: DataFrame) -> DataFrame:
    return reports.groupBy("rule_iri").agg(F.count("*").alias("runs"), F.sum("emitted_count").alias("emitted"), F.avg("duration_ms").alias("avg_ms"), F.max("evaluated_at").alias("last"))


def stats_audit(events: DataFrame) -> DataFrame:
    return events.groupBy("action").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))


def event_history(events: DataFrame, targets: DataFrame) -> DataFrame:
    """Events of the targets, newest first."""
    return of(events, targets, "target_id").orderBy("target_id", F.desc("occurred_at"), F.desc("event_id"))


def contested(scores: DataFrame, key: str) -> DataFrame:
    """Per predicate or subject: sum, peak and mean conflict score over rows with two polarities or more."""
    rows = scores.where("distinct_polarities >= 2")
    return rows.groupBy(key).agg(F.sum("score").alias("total"), F.max("score").alias("peak"), F.avg("score").alias("mean"), F.count("*").alias("windows"))


# overlays and frames


def polarity_conflicts(effective: DataFrame) -> DataFrame:
    """``context, n``: open claims whose polarity collides with another's, from ``effective_polarity``."""
    return effective.where("effective = 'conflicting'").groupBy("context").agg(F.count("*").alias("n"))


def low_confidence(claims: DataFrame, lanes: DataFrame, threshold: float = 0.5) -> DataFrame:
    rows = open_rows(claims).select("statement_id", "subject", "predicate")
    return rows.join(lanes.where(F.col("confidence") < threshold).select("statement_id", "confidence"), "statement_id").orderBy("confidence", "statement_id")


def overlay(log: DataFrame, claims: DataFrame, column: str) -> DataFrame:
    """Newest value of a sparse overlay (modality, level, kind) per claim that has one."""
    return of(latest(log, ["statement_id"]), claims, "statement_id").select("statement_id", column)


def without_flag(claims: DataFrame, flags: DataFrame) -> DataFrame:
    """Claims that are not marked as hypotheses only."""
    return claims.join(flags.select("statement_id").distinct(), "statement_id", "left_anti")


def frame_roles(roles: DataFrame, frames: DataFrame) -> DataFrame:
    return of(roles, frames, "frame_id").orderBy("frame_id", F.coalesce("rank", F.lit(9999)), "role_id")


def frames_with_role(frames: DataFrame, roles: DataFrame, role: str, value: str) -> DataFrame:
    """``frame_id, frame_type, role_id`` of active frames whose role has the value."""
    hit = roles.where((F.col("role") == role) & (F.col("value_ref") == value)).select("frame_id", "role_id")
    return frames.where("status = 'active'").join(hit, "frame_id").select("frame_id", "frame_type", "role_id")


def frames_complete(frames: DataFrame, roles: DataFrame, types: DataFrame) -> DataFrame:
    """``frame_id, complete``: whether a frame has every required role of its type; false for unknown types."""
    given = roles.groupBy("frame_id").agg(F.collect_set("role").alias("given"))  # roles are a few names
    rows = frames.join(given, "frame_id", "left").join(types.select("frame_type", "required"), "frame_type", "left")
    missing = F.size(F.array_except("required", F.coalesce("given", F.array().cast("array<string>"))))
    return rows.select("frame_id", F.coalesce(missing == 0, F.lit(False)).alias("complete"))


# identity


def identity_edges_for(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """``symbol, other, relation, confidence`` of open identity edges, seen from either end."""
    rows = open_rows(edges)
    both = rows.select(F.col("left").alias("symbol"), F.col("right").alias("other"), "relation", "confidence").unionByName(
        rows.select(F.col("right").alias("symbol"), F.col("left").alias("other"), "relation", "confidence")
    )
    return of(both, symbols, "symbol")


def resolve_referent(members: DataFrame) -> DataFrame:
    """``hypothesis_id, symbol_id, referent_id``: the referent of highest posterior (ties: the smallest)."""
    best = F.min(F.struct((-F.col("posterior")).alias("p"), "referent_id"))
    return members.groupBy("hypothesis_id", "symbol_id").agg(best.alias("b")).select("hypothesis_id", "symbol_id", "b.referent_id")


def referent_symbols(members: DataFrame, hypothesis: str) -> DataFrame:
    return members.where(F.col("hypothesis_id") == hypothesis).orderBy("referent_id", F.desc("posterior"), "symbol_id")


def symbols_by_external_id(ids: DataFrame, wanted: DataFrame) -> DataFrame:
    """``registry, external_id, symbol_id`` for the wanted pairs (ties: the smallest symbol)."""
    rows = ids.join(wanted.select("registry", "external_id").distinct(), ["registry", "external_id"], "left_semi")
    return rows.groupBy("registry", "external_id").agg(F.min("symbol_id").alias("symbol_id"))


def entity_signatures(claims: DataFrame, label_predicates: list[str]) -> DataFrame:
    """``subject, types, labels, n``: per subject the number of types and of distinct labels, and open claims."""
    rows = open_rows(claims)
    kind = F.when((F.col("predicate") == "rdf:type") & F.col("object_iri").isNotNull(), F.col("object_iri"))
    label = F.when(F.col("predicate").isin(label_predicates), F.get_json_object("object_lit", "$.v"))
    return rows.groupBy("subject").agg(F.count_distinct(kind).alias("types"), F.count_distinct(label).alias("labels"), F.count("*").alias("n"))


def is_subclass(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``child, parent, holds``: whether parent is child or one of its ancestors."""
    up = reach(edges, pairs.select(F.col("child").alias("node")).distinct()).select(F.col("seed").alias("child"), F.col("node").alias("parent"), F.lit(True).alias("holds"))
    return pairs.join(up, ["child", "parent"], "left").select("child", "parent", F.coalesce("holds", F.lit(False)).alias("holds"))


# predicates and aliases


def chained_aliases(aliases: DataFrame) -> DataFrame:
    """Aliases whose canonical name is an alias itself: rows that a register must refuse."""
    return aliases.join(aliases.select(F.col("alias").alias("canonical")).distinct(), "canonical", "left_semi").select("alias", "canonical")


def predicates_approved(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """``iri, approved``: by the newest version of the register; false where there is none."""
    now = latest(log, ["iri"]).select("iri", (F.col("status") == "approved").alias("a"))
    return wanted.toDF("iri").distinct().join(now, "iri", "left").select("iri", F.coalesce("a", F.lit(False)).alias("approved"))


def has_constraint(constraints: DataFrame, wanted: DataFrame) -> DataFrame:
    """``predicate, kind, holds`` for the wanted pairs, by open constraints."""
    there = open_rows(constraints).select("predicate", "kind").distinct().withColumn("h", F.lit(True))
    return wanted.join(there, ["predicate", "kind"], "left").select("predicate", "kind", F.coalesce("h", F.lit(False)).alias("holds"))


# browsing


def subject_history(claims: DataFrame, subjects: DataFrame) -> DataFrame:
    """All claims of the subjects, closed ones too, oldest first."""
    return of(claims, subjects, "subject").orderBy("subject", "tx_lo", "statement_id")


def recent_subjects(claims: DataFrame) -> DataFrame:
    """``subject, last_at, n``: open subjects by their newest claim."""
    return open_rows(claims).groupBy("subject").agg(F.max("tx_lo").alias("last_at"), F.count("*").alias("n"))


def graph_stats(claims: DataFrame) -> DataFrame:
    rows = open_rows(claims)
    return rows.agg(
        F.count("*").alias("claims"), F.count_distinct("subject").alias("subjects"), F.count_distinct("predicate").alias("predicates"),
        F.count_distinct("context").alias("contexts"), F.count_distinct("object_iri").alias("objects"), F.count_if(F.col("object_lit").isNotNull()).alias("literals"),
    )


def name_variants(claims: DataFrame, predicates: list[str]) -> DataFrame:
    """``subject, name, n_contexts, n``: spellings of each subject's name and how often each stands."""
    name = F.coalesce("object_iri", F.get_json_object("object_lit", "$.v")).alias("name")
    rows = open_rows(claims).where(F.col("predicate").isin(predicates)).select("subject", name, "context")
    return rows.groupBy("subject", "name").agg(F.count_distinct("context").alias("n_contexts"), F.count("*").alias("n"))


def evidence_gaps(claims: DataFrame, expected: dict[str, list[str]]) -> DataFrame:
    """``subject, missing``: expected categories of which a subject has no predicate."""
    have = open_rows(claims).groupBy("subject").agg(*[F.max(F.col("predicate").isin(names)).alias(f"_{c}") for c, names in expected.items()])
    gaps = F.filter(F.array(*[F.when(~F.col(f"_{c}"), F.lit(c)) for c in expected]), lambda x: x.isNotNull())
    return have.select("subject", F.explode(gaps).alias("missing"))


def entity_timeline(claims: DataFrame, predicates: list[str]) -> DataFrame:
    """Open claims that place a subject in time, by start of validity or dated literal."""
    value = F.get_json_object("object_lit", "$.v")
    dated = F.get_json_object("object_lit", "$.dt").isin("xsd:date", "xsd:gYear", "xsd:dateTime")
    day = F.coalesce(F.col("valid_lo").cast("string"), F.when(dated | value.rlike(r"^\d{4}"), F.substring(value, 1, 10)))
    return open_rows(claims).where(F.col("predicate").isin(predicates) | F.coalesce(dated, F.lit(False))).select("statement_id", "subject", "predicate", day.alias("day"))


def migrations(claims: DataFrame, predicates: list[str]) -> DataFrame:
    """``subject, place, since``: where subjects were, by start of validity."""
    place = F.coalesce("object_iri", F.get_json_object("object_lit", "$.v"))
    return open_rows(claims).where(F.col("predicate").isin(predicates)).select("subject", place.alias("place"), F.col("valid_lo").alias("since"))
