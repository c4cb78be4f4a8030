"""Registered queries of the evidence substrate, reactions, obligations, frames, identity and browsing.

Inputs are views written once in SQL that both engines understand (``FIX``); each query
runs an operator over them and stands beside its own SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import scalars as s
from claimweave.functions import vocabulary as voc
from claimweave.operators import claims as cl, scope, store
from claimweave.operators import substrate as sub
from claimweave.plans.runtime import table

FIX = {
    "hist": "SELECT DISTINCT statement_id, subject, predicate, object_iri, object_lit, context, polarity, maturity, valid_lo, valid_hi, tx_lo, tx_hi FROM {history}",
    "doc": "SELECT DISTINCT doc_id, coalesce(source, 'none') AS source, created_at, n_chars FROM {documents} WHERE doc_id IS NOT NULL",
    "num": "SELECT doc_id, min(source) AS source, min(created_at) AS created_at, max(n_chars) AS n_chars FROM {doc} GROUP BY doc_id",
    "rev": "SELECT DISTINCT concat('doc/', coalesce(source, 'none')) AS document_id, doc_id AS revision_number, md5(text) AS content_hash FROM {documents} WHERE text IS NOT NULL",
    "span": "SELECT concat('span/', doc_id) AS span_id, concat('rev/', doc_id % 300) AS revision_id FROM {num}",
    "ann": "SELECT concat('ann/', doc_id) AS annotation_id, concat('span/', doc_id % 400) AS span_id, concat('space/', doc_id % 3) AS space_id, CASE WHEN doc_id % 2 = 0 THEN 'pos' ELSE 'ner' END AS feature, doc_id % 5 AS value FROM {num}",
    "edge": "SELECT concat('edge/', doc_id) AS edge_id, concat('ann/', doc_id) AS source, concat('ann/', doc_id % 100) AS target, 'dep' AS relation FROM {num} WHERE doc_id >= 100",
    "link": "SELECT concat('link/', statement_id) AS link_id, statement_id, CASE ascii(substr(statement_id, 3, 1)) % 3 WHEN 0 THEN 'extracted_from' WHEN 1 THEN 'cited_in' ELSE 'quoted_in' END AS link_type, concat('doc/', context) AS target_document, tx_hi FROM {hist}",
    "sure": "SELECT DISTINCT statement_id FROM {hist} WHERE maturity >= 2",
    "ment": "SELECT concat('men/', doc_id) AS mention_id, concat('span/', doc_id) AS span_id, CASE WHEN doc_id % 2 = 0 THEN 'person' ELSE 'place' END AS mention_type, concat('ex:person/', doc_id % 50) AS entity_iri FROM {num}",
    "cell": "SELECT concat('tab/', doc_id % 20) AS table_id, doc_id % 7 AS row_idx, doc_id % 5 AS col_idx, concat('v', doc_id) AS value, doc_id AS seq FROM {num}",
    "chunk": "SELECT concat('run/', doc_id % 30) AS run_id, doc_id % 11 AS chunk_index, CASE WHEN doc_id % 4 = 0 THEN 'failed' ELSE 'done' END AS status, doc_id AS seq FROM {num}",
    "refs": "SELECT concat('ref/', doc_id) AS reference_id, concat('doc/', source) AS citing_doc, concat('label ', doc_id) AS label, CASE WHEN doc_id % 3 = 0 THEN concat('doc/', doc_id % 60) END AS cited_doc FROM {num}",
    "bind": "SELECT concat('agent/', doc_id % 40) AS agent_id, source AS context, CASE doc_id % 3 WHEN 0 THEN 'owner' WHEN 1 THEN 'reader' ELSE 'editor' END AS role, doc_id AS seq FROM {num}",
    "agent": "SELECT DISTINCT concat('agent/', doc_id % 40) AS agent_id, concat('ex:agent/', doc_id % 40) AS iri, CASE WHEN doc_id % 2 = 0 THEN 'model' ELSE 'person' END AS agent_type FROM {num}",
    "rx": "SELECT statement_id AS source_stmt, CASE ascii(substr(statement_id, 3, 1)) % 5 WHEN 0 THEN 'endorses' WHEN 1 THEN 'rejects' WHEN 2 THEN 'cites' WHEN 3 THEN 'supersedes' ELSE 'likes' END AS kind, object_iri, context FROM {hist}",
    "react_row": "SELECT concat('rx/', statement_id) AS reaction_id, statement_id AS target, CASE WHEN maturity >= 2 THEN 'endorses' ELSE 'rejects' END AS kind, context, polarity, tx_hi FROM {hist}",
    "meant": "SELECT min(statement_id) AS a, max(statement_id) AS b FROM {hist} GROUP BY subject, predicate, object_iri UNION ALL SELECT min(statement_id), max(statement_id) FROM {hist} GROUP BY subject, context",
    "oblig": "SELECT concat('ob/', doc_id % 700) AS obligation_id, concat('st/', doc_id % 90) AS statement_id, CASE doc_id % 3 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'needs_policy' ELSE 'needs_evidence' END AS obligation_type, CASE WHEN doc_id % 7 = 0 THEN 'resolved' ELSE 'open' END AS status, doc_id % 10 AS priority, source AS context, created_at, concat('agent/', doc_id % 4) AS assigned_agent, doc_id AS seq FROM {num}",
    "shape": "SELECT statement_id, CASE WHEN maturity >= 3 THEN 'pass' WHEN maturity = 2 THEN 'warn' ELSE 'violate' END AS verdict, concat('shape/', maturity) AS shape_iri, tx_hi FROM {hist}",
    "srep": "SELECT concat('shape/', doc_id % 25) AS shape_iri, n_chars AS focus_count, doc_id % 4 AS violation_count, CAST(created_at AS DATE) AS evaluated_at FROM {num}",
    "rrep": "SELECT concat('rule/', doc_id % 60) AS rule_iri, doc_id % 13 AS emitted_count, CASE WHEN doc_id % 9 > 0 THEN CAST(n_chars AS DOUBLE) END AS duration_ms, CAST(created_at AS DATE) AS evaluated_at FROM {num}",
    "audit": "SELECT event_id, concat(event_type, user_id) AS action, concat('user/', user_id) AS target_id, CAST(ts AS DATE) AS day, ts AS occurred_at FROM {events}",
    "score": "SELECT subject, predicate, count(DISTINCT polarity) AS distinct_polarities, count(*) AS score FROM {hist} GROUP BY subject, predicate",
    "lane": "SELECT statement_id, (ascii(substr(statement_id, 3, 1)) % 10) / CAST(10 AS DOUBLE) AS confidence FROM {hist} WHERE ascii(substr(statement_id, 3, 1)) % 4 > 0",
    "modal": "SELECT concat('st/', doc_id % 2000) AS statement_id, CASE doc_id % 3 WHEN 0 THEN 'inferred' WHEN 1 THEN 'elicited' ELSE 'other' END AS modality, doc_id AS seq FROM {num}",
    "frame": "SELECT subject AS frame_id, CASE ascii(substr(subject, 4, 1)) % 3 WHEN 0 THEN 'residence' WHEN 1 THEN 'ownership' ELSE 'unlisted' END AS frame_type, CASE WHEN max(maturity) >= 2 THEN 'active' ELSE 'draft' END AS status FROM {hist} WHERE subject IS NOT NULL GROUP BY subject",
    "role": "SELECT statement_id AS role_id, subject AS frame_id, predicate AS role, object_iri AS value_ref, CASE WHEN maturity > 1 THEN maturity END AS rank FROM {hist} WHERE subject IS NOT NULL",
    "ident": "SELECT min(id) AS left_id, max(id) AS right_id FROM {entities} WHERE label IS NOT NULL GROUP BY lower(label) HAVING min(id) < max(id)",
    "member": "SELECT DISTINCT concat('h/', doc_id % 3) AS hypothesis_id, doc_id % 200 AS symbol_id, doc_id % 50 AS referent_id, (doc_id % 17) / CAST(17 AS DOUBLE) AS posterior FROM {num}",
    "ext": "SELECT source AS registry, concat('x', doc_id % 100) AS external_id, doc_id AS symbol_id FROM {num}",
    "alias": "SELECT DISTINCT trim(source) AS alias, trim(target) AS canonical FROM {alignments} WHERE trim(source) <> '' AND trim(target) <> '' AND trim(source) <> trim(target)",
    "plog": "SELECT predicate AS iri, CASE WHEN batch_id % 3 = 0 THEN 'approved' ELSE 'minted' END AS status, max(batch_id) AS seq FROM {predicate_rows} WHERE predicate IS NOT NULL GROUP BY predicate, batch_id",
    "cons": "SELECT DISTINCT predicate, CASE WHEN many_values THEN 'multi' ELSE 'functional' END AS kind FROM {predicate_types}",
    "tree": "SELECT iri, min(trim(parent)) AS parent FROM {contexts} WHERE iri IS NOT NULL AND trim(parent) <> '' GROUP BY iri",
    "env": "SELECT context_iri AS context, 'lang' AS key, lang AS value, 1 AS seq, false AS gone FROM {sources} UNION ALL SELECT context_iri, 'zone', tz, 1, false FROM {sources} WHERE tz IS NOT NULL UNION ALL SELECT context_iri, 'lang', 'en', 2, false FROM {sources} WHERE kind = 'archive' UNION ALL SELECT context_iri, 'zone', NULL, 3, true FROM {sources} WHERE date_order = 'mdy'",
    "memb": "SELECT statement_id, context, 'cited' AS role, maturity AS seq, maturity % 2 = 1 AS gone FROM {hist}",
    "want": "SELECT DISTINCT predicate, 'functional' AS kind FROM {predicate_types}",
    "stated": "SELECT DISTINCT stmt_id AS statement_id, subject, predicate, object_iri, object_lit, concat('ctx:', ascii(substr(subject, 5, 1)) % 7) AS context, polarity, CAST(NULL AS TIMESTAMP) AS tx_hi FROM {statements} WHERE subject IS NOT NULL AND predicate IS NOT NULL AND context IS NOT NULL AND polarity IS NOT NULL",
}
TABLES = "history documents events entities alignments predicate_rows predicate_types contexts sources statements".split()
_NAME = re.compile(r"\{(\w+)\}")

QUERIES: dict = {}
SQL: dict[str, str] = {}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name in TABLES:
        return table(spark, folder, name)
    return spark.sql(FIX[name], **{n: view(spark, folder, n) for n in set(_NAME.findall(FIX[name]))})


def _needed(text: str) -> list[str]:
    """Views that a SQL text uses, in an order that works."""
    out: list[str] = []

    def add(name: str) -> None:
        if name in FIX and name not in out:
            for n in _NAME.findall(FIX[name]):
                add(n)
            out.append(name)

    for n in _NAME.findall(text):
        add(n)
    return out


def query(sql: str, recursive: str = ""):
    """Registers a query ``fn(v)``, where ``v(name)`` is a view; ``{name}`` in the SQL is the same view."""

    def add(fn):
        def run(spark, folder):
            return fn(lambda name: view(spark, folder, name))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        with_ = [f"{n} AS ({FIX[n]})" for n in _needed(recursive + sql)] + ([recursive] if recursive else [])
        text = (f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(with_)} " if with_ else "") + sql
        SQL[fn.__name__] = _NAME.sub(r"\1", text)
        return fn

    return add


# documents and their parts


@query("SELECT document_id, max(revision_number) AS revision_number FROM {rev} GROUP BY 1")
def latest_revision(v):
    return sub.latest_revisions(v("rev")).select("document_id", "revision_number")


@query(
    "SELECT document_id, CAST(coalesce(top, 0) + row_number() OVER (PARTITION BY document_id ORDER BY arrival, h) AS BIGINT) AS revision_number, h AS content_hash FROM "
    "(SELECT concat('doc/', source) AS document_id, sha256(concat('body ', n_chars)) AS h, min(doc_id) AS arrival FROM {num} GROUP BY 1, 2) n "
    "LEFT JOIN (SELECT concat('doc/', source) AS document_id, max(doc_id) AS top FROM {num} WHERE doc_id % 5 = 0 GROUP BY 1) t USING (document_id) "
    "WHERE (document_id, h) NOT IN (SELECT concat('doc/', source), sha256(concat('body ', n_chars)) FROM {num} WHERE doc_id % 5 = 0)"
)
def add_revisions(v):
    rows = v("num").select(F.concat(F.lit("doc/"), "source").alias("document_id"), F.concat(F.lit("body "), F.col("n_chars").cast("string")).alias("body"), F.col("doc_id").alias("arrival"))
    old = rows.where("arrival % 5 = 0").select("document_id", F.col("arrival").alias("revision_number"), F.sha2("body", 256).alias("content_hash"))
    return sub.add_revisions(old, rows)


@query("SELECT annotation_id, span_id, space_id, value FROM {ann} WHERE feature = 'ner' AND span_id IN (SELECT span_id FROM {span} WHERE revision_id < 'rev/2')")
def annotations_for_span(v):
    return sub.annotations_for(v("ann"), v("span").where("revision_id < 'rev/2'").select("span_id"), feature="ner").select("annotation_id", "span_id", "space_id", "value")


@query("SELECT edge_id, source, target, relation FROM {edge} WHERE source IN (SELECT annotation_id FROM {ann} WHERE value = 3)")
def edges_from(v):
    return sub.edges_from(v("edge"), v("ann").where("value = 3").select("annotation_id"))


@query("SELECT edge_id, source, target, relation FROM {edge} WHERE target IN (SELECT annotation_id FROM {ann} WHERE value = 3)")
def edges_to(v):
    return sub.edges_to(v("edge"), v("ann").where("value = 3").select("annotation_id"))


@query("SELECT link_id, statement_id, link_type, target_document FROM {link} WHERE tx_hi IS NULL AND statement_id IN (SELECT statement_id FROM {sure})")
def evidence_for(v):
    return sub.evidence_for(v("link"), v("sure")).select("link_id", "statement_id", "link_type", "target_document")


@query("SELECT link_id, tx_hi IS NULL AND link_type <> 'cited_in' AS is_open FROM {link}")
def retract_evidence_link(v):
    gone = v("link").where("link_type = 'cited_in'").select("link_id")
    return sub.retract_links(v("link"), gone, F.lit("2027-01-01").cast("timestamp")).select("link_id", F.col("tx_hi").isNull().alias("is_open"))


@query("SELECT mention_id, span_id, revision_id, entity_iri FROM {ment} JOIN {span} USING (span_id) WHERE mention_type = 'person' AND revision_id >= 'rev/1'")
def mentions_in_revision(v):
    wanted = v("span").where("revision_id >= 'rev/1'").select("revision_id")
    return sub.mentions_in_revision(v("ment"), v("span"), wanted, "person").select("mention_id", "span_id", "revision_id", "entity_iri")


@query("SELECT table_id, row_idx, col_idx, arg_max(value, seq) AS value FROM {cell} GROUP BY 1, 2, 3")
def table_cells(v):
    return sub.table_cells(v("cell"), v("cell").select("table_id")).select("table_id", "row_idx", "col_idx", "value")


@query("SELECT run_id, chunk_index, arg_max(status, seq) AS status FROM {chunk} WHERE run_id <> 'run/3' GROUP BY 1, 2")
def extraction_chunks(v):
    return sub.extraction_chunks(v("chunk"), v("chunk").where("run_id <> 'run/3'").select("run_id")).select("run_id", "chunk_index", "status")


@query("SELECT statement_id FROM {hist} WHERE (valid_lo IS NULL OR valid_lo <= DATE '1950-12-31') AND (valid_hi IS NULL OR valid_hi >= DATE '1940-01-01')")
def temporal_expressions_in_range(v):
    rows = v("hist").select("statement_id", F.col("valid_lo").alias("resolved_from"), F.col("valid_hi").alias("resolved_to"))
    return sub.expressions_in_range(rows, F.lit("1940-01-01").cast("date"), F.lit("1950-12-31").cast("date")).select("statement_id")


@query("SELECT reference_id, citing_doc, label FROM {refs} WHERE citing_doc LIKE 'doc/src/s1%'")
def references_for(v):
    return sub.references_for(v("refs"), v("refs").where("citing_doc like 'doc/src/s1%'").select("citing_doc")).select("reference_id", "citing_doc", "label")


@query("SELECT DISTINCT concat('st/', substr(reference_id, 5)) AS statement_id, 'cited_in' AS link_type, cited_doc AS target_document FROM {refs} WHERE cited_doc IS NOT NULL")
def reference_supports(v):
    wanted = v("refs").select("reference_id", F.concat(F.lit("st/"), F.expr("substr(reference_id, 5)")).alias("statement_id"))
    return sub.reference_supports(v("refs"), wanted)


@query("SELECT content_hash, count(*) AS n FROM {rev} GROUP BY 1")
def blob_ref_count(v):
    return sub.blob_references(v("rev"))


@query("SELECT agent_id, context, arg_max(role, seq) AS role FROM {bind} WHERE agent_id < 'agent/3' GROUP BY 1, 2")
def agent_contexts(v):
    return sub.agent_contexts(v("bind"), v("bind").where("agent_id < 'agent/3'").select("agent_id"))


@query("SELECT context, agent_id, iri, agent_type, role FROM (SELECT agent_id, context, arg_max(role, seq) AS role FROM {bind} WHERE context > 'src/s20' GROUP BY 1, 2) JOIN {agent} USING (agent_id)")
def context_agents(v):
    return sub.context_agents(v("bind"), v("agent"), v("bind").where("context > 'src/s20'").select("context"))


# reactions and meaning


@query(
    "SELECT DISTINCT concat('claim:stmt/', source_stmt) AS subject, concat('claim:', kind) AS predicate, coalesce(object_iri, concat('claim:stmt/', source_stmt)) AS object_iri, context, "
    "CASE WHEN kind = 'rejects' THEN 'negated' ELSE 'asserted' END AS polarity FROM {rx} WHERE kind IN ('endorses', 'rejects') OR (kind IN ('cites', 'supersedes') AND object_iri IS NOT NULL)"
)
def react(v):
    return sub.react(v("hist"), v("rx")).drop("maturity")


@query("SELECT reaction_id, target, kind, polarity FROM {react_row} WHERE tx_hi IS NULL AND target IN (SELECT statement_id FROM {sure})")
def reactions_for(v):
    return sub.reactions_for(v("react_row"), v("sure")).select("reaction_id", "target", "kind", "polarity")


@query("SELECT a AS src, b AS dst FROM {meant} WHERE a <> b UNION SELECT b, a FROM {meant} WHERE a <> b")
def align_meaning(v):
    return sub.align_meaning(v("meant"))


@query(
    "SELECT seed, node FROM r",
    "e AS (SELECT a AS src, b AS dst FROM {meant} WHERE a <> b UNION SELECT b, a FROM {meant} WHERE a <> b), z AS (SELECT DISTINCT statement_id FROM {hist} WHERE predicate = 'ex:residesIn' AND maturity >= 2), "
    "r AS (SELECT statement_id AS seed, statement_id AS node FROM z UNION SELECT r.seed, e.dst FROM r JOIN e ON e.src = r.node)",
)
def meaning_cluster(v):
    seeds = v("hist").where("predicate = 'ex:residesIn' and maturity >= 2").select("statement_id").distinct()
    return sub.meaning_cluster(sub.align_meaning(v("meant")), seeds)


# obligations, reviews, cards

_OPEN = "(SELECT * FROM {oblig} QUALIFY row_number() OVER (PARTITION BY obligation_id ORDER BY seq DESC) = 1)"


@query(f"SELECT obligation_id, statement_id, obligation_type, priority, context FROM {_OPEN} WHERE status = 'open' AND obligation_type = 'needs_review'")
def open_obligations(v):
    return sub.open_obligations(v("oblig"), "needs_review").select("obligation_id", "statement_id", "obligation_type", "priority", "context")


@query(f"SELECT obligation_id, CASE WHEN status = 'open' AND priority > 5 THEN 'resolved' ELSE status END AS status FROM {_OPEN}")
def resolve_obligation(v):
    log = v("oblig")
    done = sub.resolve_obligations(log, sub.open_obligations(log).where("priority > 5").select("obligation_id"), F.lit(10_000_000).cast("long"))
    return store.latest(log.unionByName(done), ["obligation_id"]).select("obligation_id", "status")


@query(f"SELECT obligation_id, concat('agent/new', priority) AS assigned_agent FROM {_OPEN} WHERE status = 'open'")
def assign_obligation(v):
    log = v("oblig")
    to = sub.open_obligations(log).select("obligation_id", F.concat(F.lit("agent/new"), F.col("priority").cast("string")).alias("agent"))
    return sub.assign_obligations(log, to, F.lit(10_000_000).cast("long")).select("obligation_id", "assigned_agent")


@query(f"SELECT obligation_type, status, count(*) AS cnt FROM {_OPEN} GROUP BY 1, 2")
def obligation_summary(v):
    from claimweave.operators import evidence

    return evidence.obligation_summary(store.latest(v("oblig"), ["obligation_id"]))


@query("SELECT source AS target_id, arg_max(doc_id, (created_at, doc_id)) AS review_id FROM {num} GROUP BY 1")
def latest_review(v):
    return sub.latest_reviews(v("num").select(F.col("source").alias("target_id"), F.col("doc_id").alias("review_id"), "created_at"))


@query(
    "SELECT h.statement_id, h.subject, h.predicate, coalesce(e.n, 0) AS evidence, coalesce(e.kinds, '') AS kinds, coalesce(a.attacks, 0) AS attacks, coalesce(a.supports, 0) AS supports, coalesce(r.n, 0) AS reviews FROM {hist} h "
    "LEFT JOIN (SELECT statement_id, count(*) AS n, string_agg(DISTINCT link_type, ',' ORDER BY link_type) AS kinds FROM {link} WHERE tx_hi IS NULL GROUP BY 1) e USING (statement_id) "
    "LEFT JOIN (SELECT b AS statement_id, count(*) FILTER (ascii(substr(a, 3, 1)) % 2 = 0) AS attacks, count(*) FILTER (ascii(substr(a, 3, 1)) % 2 = 1) AS supports FROM {meant} GROUP BY 1) a USING (statement_id) "
    "LEFT JOIN (SELECT statement_id, count(*) AS n FROM {lane} GROUP BY 1) r USING (statement_id)"
)
def claim_card(v):
    odd = F.ascii(F.substring("a", 3, 1)) % 2
    args = v("meant").select(F.col("a").alias("source"), F.col("b").alias("target"), F.when(odd == 0, "rebuts").otherwise("supports").alias("relation"))
    return sub.claim_cards(v("hist"), v("link"), args, v("lane").select(F.col("statement_id").alias("target_id"))).withColumn("kinds", F.coalesce("kinds", F.lit("")))


# shapes, rules, events, statistics


@query("SELECT DISTINCT statement_id FROM {shape} WHERE tx_hi IS NULL AND verdict = 'violate'")
def has_shape_verdict(v):
    return sub.has_verdict(v("shape"), "violate")


@query("SELECT shape_iri, count(*) AS runs, CAST(sum(focus_count) AS BIGINT) AS focus, CAST(sum(violation_count) AS BIGINT) AS violations, CAST(max(evaluated_at) AS VARCHAR) AS last FROM {srep} GROUP BY 1")
def stats_shape(v):
    return sub.stats_shape(v("srep")).withColumn("last", F.col("last").cast("string"))


@query("SELECT rule_iri, count(*) AS runs, CAST(sum(emitted_count) AS BIGINT) AS emitted, round(avg(duration_ms), 4) AS avg_ms, CAST(max(evaluated_at) AS VARCHAR) AS last FROM {rrep} GROUP BY 1")
def stats_rule(v):
    return sub.stats_rule(v("rrep")).withColumns({"avg_ms": F.round("avg_ms", 4), "last": F.col("last").cast("string")})


@query("SELECT action, count(*) AS n, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last FROM {audit} GROUP BY 1")
def stats_audit(v):
    return sub.stats_audit(v("audit").withColumn("at", F.col("day"))).withColumns({"first": F.col("first").cast("string"), "last": F.col("last").cast("string")})


@query("SELECT event_id, target_id, action FROM {audit} WHERE target_id LIKE 'user/1%'")
def event_history(v):
    return sub.event_history(v("audit"), v("audit").where("target_id like 'user/1%'").select("target_id")).select("event_id", "target_id", "action")


@query("SELECT predicate, CAST(sum(score) AS BIGINT) AS total, max(score) AS peak, round(avg(score), 4) AS mean, count(*) AS windows FROM {score} WHERE distinct_polarities >= 2 GROUP BY 1")
def top_contested_predicates(v):
    return sub.contested(v("score"), "predicate").withColumn("mean", F.round("mean", 4))


@query("SELECT subject, CAST(sum(score) AS BIGINT) AS total, max(score) AS peak, round(avg(score), 4) AS mean, count(*) AS windows FROM {score} WHERE distinct_polarities >= 2 GROUP BY 1")
def top_contested_subjects(v):
    return sub.contested(v("score"), "subject").withColumn("mean", F.round("mean", 4))


# overlays and frames


@query(
    "SELECT context, count(*) AS n FROM (SELECT *, coalesce('i' || object_iri, 'l' || object_lit) AS k FROM {stated}) h JOIN "
    "(SELECT subject, predicate, context, coalesce('i' || object_iri, 'l' || object_lit) AS k FROM {stated} GROUP BY ALL HAVING count(DISTINCT polarity) > 1) m USING (subject, predicate, context, k) GROUP BY 1"
)
def polarity_conflict_count(v):
    return sub.polarity_conflicts(cl.effective_polarity(v("stated")))


@query("SELECT statement_id, subject, predicate, confidence FROM {hist} JOIN {lane} USING (statement_id) WHERE tx_hi IS NULL AND confidence < 0.5")
def low_confidence_statements(v):
    return sub.low_confidence(v("hist"), v("lane"))


@query("SELECT statement_id, arg_max(modality, seq) AS modality FROM {modal} WHERE statement_id < 'st/5' GROUP BY 1")
def modality_of(v):
    return sub.overlay(v("modal"), v("modal").where("statement_id < 'st/5'").select("statement_id"), "modality")


@query("SELECT statement_id FROM {hist} WHERE statement_id NOT IN (SELECT statement_id FROM {lane})")
def not_hypothesis_only(v):
    return sub.without_flag(v("hist"), v("lane")).select("statement_id")


@query("SELECT statement_id, CASE maturity WHEN 0 THEN 'Raw' WHEN 1 THEN 'Candidate' WHEN 2 THEN 'Evidence-supported' WHEN 3 THEN 'Reviewed' WHEN 5 THEN 'Corroborated' WHEN 4 THEN 'Certified' END AS name, CASE maturity WHEN 4 THEN 'E5' WHEN 5 THEN 'E4' ELSE concat('E', maturity) END AS level FROM {hist}")
def maturity_description(v):
    flags = s.pack_flags(F.lit("asserted"), F.col("maturity"))
    return v("hist").select("statement_id", voc.maturity_name(F.col("maturity")).alias("name"), s.maturity_label(s.flag_maturity(flags)).alias("level"))


@query("SELECT role_id, frame_id, role FROM {role} WHERE frame_id IN (SELECT frame_id FROM {frame} WHERE status = 'active')")
def frame_roles(v):
    return sub.frame_roles(v("role"), v("frame").where("status = 'active'").select("frame_id")).select("role_id", "frame_id", "role")


_PLACE = "(SELECT value_ref FROM {role} WHERE role = 'ex:residesIn' AND value_ref IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(f"SELECT frame_id, frame_type, role_id FROM {{frame}} JOIN {{role}} USING (frame_id) WHERE status = 'active' AND role = 'ex:residesIn' AND value_ref = {_PLACE}")
def frames_with_role_value(v):
    top = v("role").where("role = 'ex:residesIn' and value_ref is not null").groupBy("value_ref").count().agg(F.min(F.struct((-F.col("count")).alias("c"), "value_ref")).alias("m")).first()
    return sub.frames_with_role(v("frame"), v("role"), "ex:residesIn", top["m"]["value_ref"] if top["m"] else "")


@query(
    "SELECT f.frame_id, coalesce(CASE f.frame_type WHEN 'residence' THEN list_contains(g.roles, 'ex:residesIn') WHEN 'ownership' THEN list_contains(g.roles, 'ex:ownedBy') AND list_contains(g.roles, 'ex:residesIn') ELSE false END, false) AS complete "
    "FROM {frame} f LEFT JOIN (SELECT frame_id, list(DISTINCT role) AS roles FROM {role} GROUP BY 1) g USING (frame_id)"
)
def validate_frame_roles(v):
    types = v("frame").sparkSession.createDataFrame([("residence", ["ex:residesIn"]), ("ownership", ["ex:ownedBy", "ex:residesIn"])], "frame_type string, required array<string>")
    return sub.frames_complete(v("frame"), v("role"), types)


# identity


@query("SELECT left_id AS symbol, right_id AS other FROM {ident} UNION ALL SELECT right_id, left_id FROM {ident}")
def identity_edges_for(v):
    rows = v("ident").select(F.col("left_id").alias("left"), F.col("right_id").alias("right"), F.lit("same").alias("relation"), F.lit(0.9).alias("confidence"), F.lit(None).cast("timestamp").alias("tx_hi"))
    ids = rows.select(F.explode(F.array("left", "right")).alias("i"))
    return sub.identity_edges_for(rows, ids).select("symbol", "other")


@query("SELECT hypothesis_id, symbol_id, referent_id FROM {member} QUALIFY row_number() OVER (PARTITION BY hypothesis_id, symbol_id ORDER BY posterior DESC, referent_id) = 1")
def resolve_referent(v):
    return sub.resolve_referent(v("member"))


@query("SELECT symbol_id, referent_id, round(posterior, 6) AS posterior FROM {member} WHERE hypothesis_id = 'h/1'")
def referent_symbols(v):
    return sub.referent_symbols(v("member"), "h/1").select("symbol_id", "referent_id", F.round("posterior", 6).alias("posterior"))


@query("SELECT registry, external_id, min(symbol_id) AS symbol_id FROM {ext} WHERE external_id < 'x5' GROUP BY 1, 2")
def symbol_by_external_id(v):
    return sub.symbols_by_external_id(v("ext"), v("ext").where("external_id < 'x5'"))


@query(
    "SELECT subject, count(DISTINCT CASE WHEN predicate = 'rdf:type' THEN object_iri END) AS types, count(DISTINCT CASE WHEN predicate IN ('ex:name', 'ex:knownAs') THEN json_extract_string(object_lit, '$.v') END) AS labels, count(*) AS n "
    "FROM {hist} WHERE tx_hi IS NULL GROUP BY 1"
)
def entity_signature(v):
    return sub.entity_signatures(v("hist"), ["ex:name", "ex:knownAs"])


@query(
    "SELECT iri AS child, 'ctx:src/s01' AS parent, EXISTS (SELECT 1 FROM u WHERE u.seed = iri AND u.node = 'ctx:src/s01') AS holds FROM {tree}",
    "u AS (SELECT iri AS seed, iri AS node FROM {tree} UNION SELECT u.seed, t.parent FROM u JOIN {tree} t ON t.iri = u.node)",
)
def is_subclass(v):
    tree = v("tree")
    return sub.is_subclass(tree.select(F.col("iri").alias("src"), F.col("parent").alias("dst")), tree.select(F.col("iri").alias("child"), F.lit("ctx:src/s01").alias("parent")))


# predicates


@query("SELECT alias, canonical FROM {alias} WHERE canonical IN (SELECT alias FROM {alias})")
def alias_chains(v):
    return sub.chained_aliases(v("alias"))


@query("SELECT predicate AS iri, coalesce(s.status = 'approved', false) AS approved FROM (SELECT DISTINCT predicate FROM {predicate_types}) p LEFT JOIN (SELECT iri, arg_max(status, seq) AS status FROM {plog} GROUP BY 1) s ON s.iri = p.predicate")
def predicate_is_approved(v):
    return sub.predicates_approved(v("plog"), v("predicate_types").select("predicate"))


@query("SELECT predicate, kind, (predicate, kind) IN (SELECT predicate, kind FROM {cons}) AS holds FROM {want}")
def has_constraint(v):
    return sub.has_constraint(v("cons").withColumn("tx_hi", F.lit(None).cast("timestamp")), v("want"))


# contexts and registers


@query("SELECT context, key, arg_max(value, seq) AS value FROM {env} GROUP BY 1, 2 HAVING NOT arg_max(gone, seq)")
def context_env(v):
    return store.latest(v("env"), ["context", "key"], deleted="gone").drop("seq")


@query("SELECT context FROM (SELECT context, key, arg_max(value, seq) AS value FROM {env} GROUP BY 1, 2 HAVING NOT arg_max(gone, seq)) WHERE key = 'lang' AND value = 'en' INTERSECT SELECT context FROM (SELECT context, key, arg_max(gone, seq) AS gone, arg_max(value, seq) AS value FROM {env} GROUP BY 1, 2) WHERE key = 'zone' AND NOT gone AND value LIKE '%Kolkata'")
def contexts_with_env(v):
    env = store.latest(v("env"), ["context", "key"], deleted="gone")
    return scope.contexts_with_env(v("contexts"), env, {"lang": "en", "zone": "Asia/Kolkata"})


@query("SELECT statement_id, context, role FROM {memb} GROUP BY 1, 2, 3 HAVING NOT arg_max(gone, seq)")
def statement_memberships(v):
    return store.latest(v("memb"), ["statement_id", "context", "role"], deleted="gone").drop("seq")


@query("SELECT statement_id, 'primary' AS role FROM {hist} WHERE context = 'ctx:src/s01' UNION ALL SELECT statement_id, 'cited' FROM {hist} WHERE context = 'ctx:src/s01' AND maturity % 2 = 0")
def statements_in_context(v):
    extra = v("hist").where("maturity % 2 = 0").select("statement_id", "context", F.lit("cited").alias("role"))
    return scope.statement_contexts(v("hist"), extra).where("context = 'ctx:src/s01'").select("statement_id", "role")


@query("SELECT iri, arg_min(kind, req_id) AS kind, arg_min(mode, req_id) AS mode FROM (SELECT DISTINCT * FROM {contexts}) WHERE iri IS NOT NULL AND trim(iri) <> '' AND mode IN ('permissive', 'curated') GROUP BY 1")
def ensure_context(v):
    register = store.REGISTERS["context"]
    good, _ = register.split(v("contexts"))
    return register.read(good, "req_id").select("iri", "kind", "mode")


# browsing


@query("SELECT statement_id, subject FROM {hist} WHERE subject IN (SELECT subject FROM {hist} WHERE maturity = 5)")
def subject_history(v):
    return sub.subject_history(v("hist"), v("hist").where("maturity = 5").select("subject")).select("statement_id", "subject")


@query("SELECT subject, CAST(CAST(max(tx_lo) AS DATE) AS VARCHAR) AS last_at, count(*) AS n FROM {hist} WHERE tx_hi IS NULL GROUP BY 1")
def recent_subjects(v):
    return sub.recent_subjects(v("hist")).withColumn("last_at", F.to_date("last_at").cast("string"))


@query("SELECT count(*) AS claims, count(DISTINCT subject) AS subjects, count(DISTINCT predicate) AS predicates, count(DISTINCT context) AS contexts, count(DISTINCT object_iri) AS objects, count(object_lit) AS literals FROM {hist} WHERE tx_hi IS NULL")
def graph_stats(v):
    return sub.graph_stats(v("hist"))


@query("SELECT subject, coalesce(object_iri, json_extract_string(object_lit, '$.v')) AS name, count(DISTINCT context) AS n_contexts, count(*) AS n FROM {hist} WHERE tx_hi IS NULL AND predicate IN ('ex:residesIn', 'ex:ownedBy', 'ex:name') GROUP BY 1, 2")
def name_variants(v):
    return sub.name_variants(v("hist"), ["ex:residesIn", "ex:ownedBy", "ex:name"])


@query(
    "SELECT subject, unnest(list_filter([CASE WHEN NOT home THEN 'home' END, CASE WHEN NOT kin THEN 'kin' END, CASE WHEN NOT owned THEN 'owned' END], lambda x: x IS NOT NULL)) AS missing FROM "
    "(SELECT subject, bool_or(predicate IN ('ex:residesIn', 'ex:livesAt')) AS home, bool_or(predicate IN ('ex:childOf', 'ex:spouseOf')) AS kin, bool_or(predicate = 'ex:ownedBy') AS owned FROM {hist} WHERE tx_hi IS NULL GROUP BY 1)"
)
def evidence_gaps(v):
    return sub.evidence_gaps(v("hist"), {"home": ["ex:residesIn", "ex:livesAt"], "kin": ["ex:childOf", "ex:spouseOf"], "owned": ["ex:ownedBy"]})


@query("SELECT statement_id, subject, predicate, CAST(valid_lo AS VARCHAR) AS day FROM {hist} WHERE tx_hi IS NULL AND predicate = 'ex:residesIn' AND object_iri IS NOT NULL")
def entity_timeline(v):
    return sub.entity_timeline(v("hist").where("predicate = 'ex:residesIn' and object_iri is not null"), ["ex:residesIn"])


@query("SELECT subject, coalesce(object_iri, json_extract_string(object_lit, '$.v')) AS place, CAST(valid_lo AS VARCHAR) AS since FROM {hist} WHERE tx_hi IS NULL AND predicate = 'ex:residesIn'")
def migrations(v):
    return sub.migrations(v("hist"), ["ex:residesIn"]).withColumn("since", F.col("since").cast("string"))


def _vocabulary(name: str):
    values = voc.VOCABULARIES[name].split()
    rows = ", ".join(f"('{x}', {i})" for i, x in enumerate(values))

    def run(v):
        """The fixed code list."""
        return voc.vocabulary(v("sources").sparkSession, name)

    run.__name__ = f"vocabulary_{name}"
    query(f"SELECT * FROM (VALUES {rows}) t(value, place)")(run)


for _name in voc.VOCABULARIES:
    _vocabulary(_name)


@query("SELECT * FROM (VALUES (0, 'E0', 'Raw', 0), (1, 'E1', 'Candidate', 1), (2, 'E2', 'Evidence-supported', 2), (3, 'E3', 'Reviewed', 3), (5, 'E4', 'Corroborated', 4), (4, 'E5', 'Certified', 5)) t(stored, level, name, place)")
def vocabulary_maturity_ladder(v):
    return voc.maturity_ladder(v("sources").sparkSession)


@query(
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS ok FROM {num}"
)
def validate_anchor_locator(v):
    k = F.col("doc_id") % 4
    kind = F.when(k == 0, "char_span").when(k == 1, "page_box").when(k == 2, "whole_source").otherwise("no such kind")
    locator = F.when(k == 0, '{"start": 1, "end": 9, "text": "x"}').when(k == 1, '{"page": 1, "x": 0}').otherwise("{}")
    return v("num").select("doc_id", voc.valid_locator(kind, locator).alias("ok"))
