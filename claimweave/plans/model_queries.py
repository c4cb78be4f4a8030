"""Registered queries of the write path, time travel, policies, rules and the claim language."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.functions import scalars as s
from claimweave.operators import align, browse, claims as cl, evidence, policy, scope, store
from claimweave.plans.substrate_queries import FIX, query
from claimweave.query import Store, run

DAY = "2027-01-01"
FIX["ctx"] = "SELECT iri, min(kind) AS kind, min(CASE WHEN trim(parent) <> '' THEN trim(parent) END) AS parent FROM {contexts} WHERE iri IS NOT NULL GROUP BY iri"
FIX["pred"] = "SELECT DISTINCT predicate AS iri, 'active' AS status, CASE WHEN predicate < 'ex:n' THEN 'ex:canonical' END AS canonical_of, CAST(NULL AS VARCHAR(9)) AS inverse_of FROM {predicate_types}"
FIX["att"] = "SELECT concat('holder/', doc_id % 25) AS holder, source AS policy_iri, CASE WHEN doc_id % 3 = 0 THEN 'all' ELSE 'quote' END AS action, CASE WHEN doc_id % 5 = 0 THEN created_at END AS revoked_at FROM {num}"
FIX["line"] = "SELECT concat('rev/', doc_id) AS child, concat('rev/', CAST(floor(doc_id / 2) AS INT)) AS parent FROM {num} WHERE doc_id > 0"
_OPEN = "tx_hi IS NULL AND polarity = 'asserted'"


# contexts and scopes

_SCOPE_DOWN = "dn AS (SELECT iri FROM {ctx} WHERE iri = 'ctx:src/s07' UNION SELECT c.iri FROM {ctx} c JOIN dn ON c.parent = dn.iri)"
_SCOPE_UP = "up AS (SELECT iri, parent FROM {ctx} WHERE kind = 'hypothesis' UNION SELECT c.iri, c.parent FROM {ctx} c JOIN up ON up.parent = c.iri)"


@query("SELECT iri AS context FROM dn", _SCOPE_DOWN)
def resolve_scope_named(v):
    presets = {"one": {"include": ["ctx:src/s07"]}}
    return scope.resolve_named(v("ctx"), presets, preset="one")


@query("SELECT DISTINCT iri AS context FROM up", _SCOPE_UP)
def scope_as_of(v):
    """Contexts of kind hypothesis and everything above them."""
    seeds = v("ctx").where("kind = 'hypothesis'").select(F.col("iri").alias("node"))
    return scope.resolve_scope(v("ctx"), include=seeds, **{k: x for k, x in scope.scope_as_of("").items() if k != "include"})


@query(
    "SELECT seed, node, min(depth) AS depth FROM u WHERE seed <> node GROUP BY 1, 2",
    "e AS (SELECT iri AS src, parent AS dst FROM {ctx} WHERE parent IS NOT NULL UNION SELECT iri, 'ctx:all' FROM {ctx}), "
    "u AS (SELECT src AS seed, dst AS node, 1 AS depth FROM e UNION SELECT u.seed, e.dst, u.depth + 1 FROM u JOIN e ON e.src = u.node WHERE u.depth < 16)",
)
def context_ancestors_typed(v):
    """Ancestors over typed extra parents and the single parent together, with the least depth."""
    extra = v("ctx").select(F.col("iri").alias("context"), F.lit("ctx:all").alias("parent_context"))
    got = scope.context_ancestors(extra, v("ctx"), v("ctx").select(F.col("iri").alias("node")))
    return got.where("seed <> node")


# write path


@query("SELECT statement_id, lower(polarity) IN ('asserted', 'negated', 'absent', 'unknown') AS ok FROM {hist}")
def is_polarity(v):
    return v("hist").select("statement_id", s.is_polarity(F.upper("polarity")).alias("ok"))


@query("SELECT subject, predicate, object_iri, context, 'negated' AS polarity FROM {hist} WHERE tx_hi IS NULL AND maturity >= 2 AND polarity = 'asserted' GROUP BY ALL")
def correct(v):
    rows = v("hist")
    changes = rows.where("maturity >= 2 and polarity = 'asserted'").select("statement_id", F.lit("negated").alias("polarity"))
    _, added = cl.correct(rows, changes, F.lit(DAY).cast("timestamp"))
    return added.select("subject", "predicate", "object_iri", "context", "polarity").distinct()


@query("SELECT DISTINCT subject, predicate, object_iri, 'ctx:main' AS context FROM {hist} WHERE tx_hi IS NULL AND maturity >= 2")
def promote_candidates(v):
    rows = v("hist")
    _, copies, _ = cl.promote(rows, rows.where("maturity >= 2").select("statement_id"), "ctx:main", F.lit(DAY).cast("timestamp"))
    return copies.select("subject", "predicate", "object_iri", "context").distinct()


@query("SELECT statement_id, maturity AS from_maturity, 3 AS to_maturity FROM {hist} WHERE maturity <> 3")
def maturity_audit(v):
    return cl.maturity_changes(v("hist"), v("hist").withColumn("maturity", F.lit(3)))


@query("SELECT statement_id, CAST(valid_lo AS VARCHAR) AS valid_lo, reason FROM {hist} JOIN (SELECT statement_id, CASE WHEN maturity % 2 = 0 THEN 'late source' ELSE ' ' END AS reason FROM {hist}) USING (statement_id) WHERE trim(reason) <> '' AND (valid_lo IS NOT NULL OR valid_hi IS NOT NULL)")
def retrofit_log(v):
    """Back-dated claims with their reasons: a reason and at least one bound are needed."""
    why = v("hist").select("statement_id", F.when(F.col("maturity") % 2 == 0, "late source").otherwise(" ").alias("retrofit_reason"))
    good, _ = store.REGISTERS["retrofit"].split(why)
    rows = v("hist").where("valid_lo is not null or valid_hi is not null").join(good, "statement_id")
    return rows.select("statement_id", F.col("valid_lo").cast("string").alias("valid_lo"), F.col("retrofit_reason").alias("reason"))


# time travel


@query("SELECT statement_id FROM {hist} WHERE tx_hi IS NULL AND polarity = 'asserted' AND context IN (SELECT iri FROM dn)", _SCOPE_DOWN)
def match_in_snapshot(v):
    members = cl.snapshot(v("hist"), scope.resolve_scope(v("ctx"), include=["ctx:src/s07"]))
    return cl.match_in_snapshot(v("hist"), members).select("statement_id")


@query("SELECT snapshot, n FROM (SELECT context AS snapshot, count(*) AS n FROM {hist} GROUP BY 1) WHERE snapshot NOT LIKE '%1'")
def snapshot_drop(v):
    """Snapshots left after some were dropped."""
    log = v("hist").groupBy(F.col("context").alias("snapshot")).agg(F.count("*").alias("n")).withColumns({"seq": F.lit(1), "gone": F.lit(False)})
    drops = log.where("snapshot like '%1'").withColumns({"seq": F.lit(2), "gone": F.lit(True)})
    return store.latest(log.unionByName(drops), ["snapshot"], deleted="gone").select("snapshot", "n")


@query(f"SELECT statement_id FROM {{hist}} h LEFT JOIN {{pred}} p ON p.iri = h.predicate WHERE {_OPEN} AND coalesce(canonical_of, h.predicate) = coalesce((SELECT max(canonical_of) FROM {{pred}} WHERE iri = 'ex:holdsOffice'), 'ex:holdsOffice')")
def match_canonical(v):
    return align.match_canonical(v("hist"), v("pred"), "ex:holdsOffice").select("statement_id")


# predicates


@query("SELECT predicate, statement_id, coalesce(canonical_of, predicate) AS canonical FROM {hist} h LEFT JOIN {pred} p ON p.iri = h.predicate")
def canonical_predicate(v):
    return align.canonical_predicate(v("hist").select("predicate", "statement_id"), v("pred"))


# evidence and policy


@query(
    "SELECT seed, node, depth FROM r",
    "r AS (SELECT child AS seed, child AS node, 0 AS depth FROM {line} UNION ALL SELECT r.seed, l.parent, r.depth + 1 FROM r JOIN {line} l ON l.child = r.node)",
)
def revision_lineage(v):
    rows = v("line").select(F.col("child").alias("revision_id"), F.array("parent").alias("derived_from"))
    return evidence.revision_lineage(rows, v("line").select(F.col("child").alias("node")))


@query("SELECT DISTINCT holder, policy_iri, action FROM {att} WHERE revoked_at IS NULL")
def holder_can(v):
    rows = v("att").select("holder", "policy_iri", F.array("action").alias("actions"), "revoked_at", F.lit(None).cast("timestamp").alias("expires_at"))
    return policy.holder_can(rows, DAY)




@query("SELECT DISTINCT a.statement_id, b.statement_id IS NOT NULL AS seen FROM {hist} a LEFT JOIN {lane} b USING (statement_id)")
def overlay_presence(v):
    """Which claims have a confidence overlay: sparse overlays leave the rest unknown."""
    there = v("lane").select("statement_id", F.lit(True).alias("t")).distinct()
    return v("hist").join(there, "statement_id", "left").select("statement_id", F.coalesce("t", F.lit(False)).alias("seen"))


# rules


@query(
    "SELECT DISTINCT object_iri AS subject, 'ex:knows' AS predicate, subject AS object_iri FROM {hist} h WHERE tx_hi IS NULL AND polarity = 'asserted' AND predicate = 'ex:residesIn' AND object_iri IS NOT NULL "
)
def symmetric_emission(v):
    """The other direction of every row of a symmetric rule."""
    rows = v("hist").where("predicate = 'ex:residesIn'").withColumn("predicate", F.lit("ex:knows"))
    return evidence.emit_inverse(rows, "ex:knows", "ex:knows").select("subject", "predicate", "object_iri")


@query("SELECT subject, 'ex:birthYear' AS class_a, 'ex:occupation' AS class_b FROM {statements} GROUP BY 1 HAVING subject IS NOT NULL AND bool_or(predicate = 'ex:birthYear') AND bool_or(predicate = 'ex:occupation')")
def check_disjointness(v):
    types = v("statements").where("subject is not null").select("subject", F.col("predicate").alias("class"))
    disjoint = types.sparkSession.createDataFrame([("ex:occupation", "ex:birthYear")], "class_a string, class_b string")
    return browse.check_disjointness(types, disjoint)


# the claim language


def _store(v) -> Store:
    return Store(v("hist"), contexts=v("ctx"))


@query(f"SELECT subject AS s, coalesce(object_iri, object_lit) AS o FROM {{hist}} WHERE {_OPEN} AND predicate = 'ex:residesIn' AND coalesce(object_iri, object_lit) IS NOT NULL")
def language_bound(v):
    return run(_store(v), "MATCH ?s ex:residesIn ?o FILTER BOUND(?o), ?s != ex:nobody PROJECT ?s, ?o")


@query("SELECT subject AS s, predicate AS p FROM {hist} WHERE tx_hi IS NULL AND polarity = 'negated' AND maturity >= 1")
def language_polarity(v):
    return run(_store(v), "MATCH ?s ?p ?o POLARITY negated MATURITY >= 1 PROJECT ?s, ?p")


@query(f"SELECT h.subject AS s, h.context AS g FROM {{hist}} h WHERE {_OPEN} AND predicate = 'ex:residesIn' AND context IN (SELECT iri FROM dn)", _SCOPE_DOWN)
def language_scope_graph(v):
    return run(_store(v), "MATCH ?s ex:residesIn ?o IN ?g SCOPE include ctx:src/s07 PROJECT ?s, ?g")


@query("SELECT subject AS s FROM {hist} WHERE polarity = 'asserted' AND predicate = 'ex:residesIn' AND (tx_lo IS NULL OR tx_lo <= TIMESTAMP '2025-06-01') AND (tx_hi IS NULL OR tx_hi > TIMESTAMP '2025-06-01')")
def language_as_of(v):
    return run(_store(v), 'MATCH ?s ex:residesIn ?o TRANSACTION_TIME AS_OF "2025-06-01" PROJECT ?s')


@query(
    "SELECT a.subject AS p, b.subject AS q, a.context AS g FROM {hist} a JOIN {hist} b ON a.context = b.context WHERE a.predicate = 'ex:holdsOffice' AND b.predicate = 'ex:marriedTo' "
    "AND a.tx_hi IS NULL AND b.tx_hi IS NULL AND a.polarity = 'asserted' AND b.polarity = 'asserted' AND a.maturity >= 2 AND b.maturity >= 2"
)
def language_shared_graph(v):
    """Two unpinned patterns joined on the context they stand in."""
    return run(_store(v), "MATCH ?p ex:holdsOffice ?o IN ?g, ?q ex:marriedTo ?r IN ?g MATURITY >= 2 PROJECT ?p, ?q, ?g")


@query(f"SELECT count(*) AS n FROM {{hist}} WHERE {_OPEN}")
def language_everything(v):
    """A full scan through the language."""
    return run(_store(v), "MATCH ?s ?p ?o PROJECT ?s").agg(F.count("*").alias("n"))


@query("SELECT lens, statement_id, round(confidence, 6) AS value FROM {lane}, (SELECT unnest(['machine', 'human', 'calibrated', 'source_weighted']) AS lens)")
def confidence_lenses(v):
    """Every single-lane lens falls back to the machine's value where its lane is empty."""
    none = F.lit(None).cast("double")
    lanes = v("lane").select("statement_id", "confidence", none.alias("calibrated"), none.alias("human"), none.alias("reliability"))
    out = None
    for lens in ("machine", "human", "calibrated", "source_weighted"):
        part = evidence.confidence_lens(lanes, lens).select(F.lit(lens).alias("lens"), "statement_id", F.round("value", 6).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT statement_id, label, stored, auto FROM (SELECT statement_id, concat('E', maturity) AS label, CASE maturity WHEN 4 THEN 5 WHEN 5 THEN 4 ELSE maturity END AS stored, CASE WHEN maturity % 2 = 0 THEN 2 ELSE 1 END AS auto FROM {hist})")
def maturity_from_labels(v):
    label = F.concat(F.lit("E"), F.col("maturity").cast("string"))
    level = F.when(F.col("maturity") % 2 == 0, "quoted").otherwise("model_hypothesis")
    return v("hist").select("statement_id", label.alias("label"), s.maturity_from_label(label).alias("stored"), s.max_auto_maturity(level).alias("auto"))


@query("SELECT statement_id, CASE WHEN confidence >= 0.95 THEN 4 WHEN confidence >= 0.8 THEN 3 WHEN confidence >= 0.6 THEN 2 WHEN confidence >= 0.4 THEN 1 ELSE 0 END AS maturity FROM {lane}")
def confidence_to_maturity(v):
    return v("lane").select("statement_id", s.confidence_to_maturity(F.col("confidence")).alias("maturity"))
