"""Query object to one lazy DataFrame.

Each pattern is one filtered scan; patterns meet in equi-joins on shared variables,
connected patterns first; overlays are semi or anti joins. A variable's column holds an
IRI or a literal's JSON text, so term equality is string equality.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.operators import claims as cl
from claimweave.operators import evidence, policy
from claimweave.operators.scope import resolve_scope
from claimweave.query.lang import Pattern, Query, Term, parse, parse_sparql


@dataclass
class Store:
    """The frames a query may touch; only ``claims`` is needed by every query."""

    claims: DataFrame
    contexts: DataFrame | None = None
    closure: DataFrame | None = None
    arguments: DataFrame | None = None
    modality: DataFrame | None = None  # statement_id, modality
    extraction_level: DataFrame | None = None  # statement_id, level
    links: DataFrame | None = None  # statement_id, doc_id, tx_hi
    documents: DataFrame | None = None  # doc_id, policy_iri
    capsules: DataFrame | None = None
    memberships: DataFrame | None = None  # statement_id, context, role
    alignments: DataFrame | None = None  # source, target, scope, safe_for_query_expansion, tx_hi
    identities: DataFrame | None = None  # iri, cluster


def run(store: Store, text: str, **options) -> DataFrame:
    """Plan a query text; SPARQL is recognised by its first word."""
    first = text.strip().split(None, 1)[0].lower() if text.strip() else ""
    return plan(store, parse_sparql(text) if first in ("select", "prefix") else parse(text), **options)


def plan(store: Store, q: Query, allow_product: bool = False) -> DataFrame:
    """The query's rows. Patterns without a shared variable are refused unless a product is asked for."""
    spark = store.claims.sparkSession
    if not q.patterns:
        return spark.createDataFrame([], "statement_id string")
    base = _base(store, q)
    pending = list(enumerate(q.patterns))
    index, first = pending.pop(0)
    out, bound = _scan(store, q, base, first, index)
    while pending:
        pick = next((k for k, (_, p) in enumerate(pending) if _variables(p) & bound), None)
        if pick is None and not allow_product:
            raise ValueError("patterns share no variable")
        index, pattern = pending.pop(pick or 0)
        rows, names = _scan(store, q, base, pattern, index)
        shared = sorted(names & bound)
        out = out.join(rows, shared) if shared else out.crossJoin(rows)
        bound |= names
    for left, op, right in q.filters:
        out = out.where(_compare(left, op, right, bound))
    last = f"_stmt{len(q.patterns) - 1}"
    if q.order:
        front = evidence.contradiction_frontier(store.arguments).select(F.col("statement_id").alias(last), "net_pressure")
        out = out.join(front, last, "left").withColumn("pressure", -F.coalesce("net_pressure", F.lit(0))).drop("net_pressure")
        key = F.col("pressure").asc() if q.order == "asc" else F.col("pressure").desc()
        out = out.orderBy(key, last)
    if q.evidence != "none":
        links = store.links.where("tx_hi is null").groupBy(F.col("statement_id").alias(last)).agg(
            F.sort_array(F.collect_set(F.col("doc_id").cast("string"))).alias("evidence")
        )
        if q.evidence == "redacted_if_required":
            hidden = policy.denied_statements(store.links, store.documents, store.capsules, "view_anchor_location")
            out = out.join(hidden.select(F.col("statement_id").alias(last)), last, "left_anti")
        out = out.join(links, last, "left")
    names = [v for v in q.project if v in bound] if q.project else sorted(bound)
    extra = [c for c in ("pressure", "evidence") if c in out.columns]
    out = out.select(*names, *extra)
    if q.offset:
        out = out.offset(q.offset)
    return out.limit(q.limit) if q.limit is not None else out


def _base(store: Store, q: Query) -> DataFrame:
    """Claims after every filter that concerns statements alone."""
    scope = None
    if q.scope:
        s = dict(q.scope)
        if s.pop("with_descendants_of_kind", False):
            seeds = store.contexts.where(F.col("kind").isin(s["kinds"])).select(F.col("iri").alias("node"))
            scope = resolve_scope(store.contexts, include=seeds)
        else:
            scope = resolve_scope(store.contexts, **s)
    rows = cl.match(store.claims, scope=scope, polarity=q.polarity, min_maturity=q.min_maturity, as_of_tx=q.as_of)
    if q.modality:
        rows = rows.join(store.modality.where(F.col("modality").isin(q.modality)).select("statement_id").distinct(), "statement_id", "left_semi")
    if q.extraction_level:
        rows = rows.join(store.extraction_level.where(F.col("level").isin(q.extraction_level)).select("statement_id").distinct(), "statement_id", "left_semi")
    if q.schema_lens:
        member = store.memberships.where((F.col("role") == "schema_lens") & (F.col("context") == q.schema_lens))
        rows = rows.join(member.select("statement_id").distinct(), "statement_id", "left_semi")
    if q.concept:
        concept, lens = q.concept
        targets = store.alignments.where((F.col("source") == concept) & (F.col("scope") == lens) & F.col("safe_for_query_expansion") & F.col("tx_hi").isNull())
        own = store.claims.sparkSession.createDataFrame([(concept,)], "predicate string")
        rows = rows.join(targets.select(F.col("target").alias("predicate")).unionByName(own).distinct(), "predicate", "left_semi")
    if q.policy_action:
        rows = policy.policy_allows(rows, store.links, store.documents, store.capsules, q.policy_action)
    if store.identities is not None and q.identity in ("expand_clusters", "expand_sameas_transitive"):
        ids = store.identities.select("iri", "cluster").distinct()
        for c in ("subject", "object_iri"):
            rows = rows.join(ids.select(F.col("iri").alias(c), F.col("cluster").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return rows


def _variables(p: Pattern) -> set[str]:
    return {t.text for t in (p.subject, p.predicate, p.object, p.graph) if t is not None and t.kind == "var"}


def _scan(store: Store, q: Query, base: DataFrame, p: Pattern, index: int) -> tuple[DataFrame, set[str]]:
    if p.predicate.kind == "iri" and q.expand is not None and store.closure is not None:
        rows = cl.match_aligned(base, store.closure, p.predicate.text, q.expand, polarity=None, as_of_tx=q.as_of)
    elif p.predicate.kind == "iri":
        rows = base.where(F.col("predicate") == p.predicate.text)
    else:
        rows = base
    slots: list[tuple[Term, Column]] = [(p.subject, F.col("subject")), (p.object, F.coalesce("object_iri", "object_lit"))]
    if p.predicate.kind == "var":
        slots.append((p.predicate, F.col("predicate")))
    if p.graph is not None:
        slots.append((p.graph, F.col("context")))
    picked: dict[str, Column] = {}
    for term, value in slots:
        if term.kind == "var" and term.text not in picked:
            picked[term.text] = value
        elif term.kind == "var":
            rows = rows.where(picked[term.text] == value)
        elif term.kind == "iri":
            rows = rows.where(value == term.text)
        else:
            rows = rows.where(_same_literal(F.col("object_lit"), term.text))
    return rows.select(F.col("statement_id").alias(f"_stmt{index}"), *[c.alias(n) for n, c in picked.items()]), set(picked)


def _same_literal(column: Column, text: str) -> Column:
    """Literal equality by value, datatype and language, whatever the spacing of the JSON text."""
    want = F.lit(text)
    out = column.isNotNull()
    for path in ("$.v", "$.dt", "$.lang"):
        out = out & F.get_json_object(column, path).eqNullSafe(F.get_json_object(want, path))
    return out


def _number(x: Column) -> Column:
    """Numeric value of a literal that is a JSON number, else null."""
    return F.when(x.rlike(r'"v"\s*:\s*-?[0-9]'), F.get_json_object(x, "$.v").try_cast("double"))


def _compare(left: Term, op: str, right: Term, bound: set[str]) -> Column:
    def value(t: Term) -> Column:
        if t.kind == "var":
            return F.col(t.text) if t.text in bound else F.lit(None).cast("string")
        return F.lit(t.text)

    a, b = value(left), value(right)
    if op == "bound":
        return a.isNotNull()
    if op in ("=", "!="):
        if "lit" in (left.kind, right.kind):
            var, lit = (a, right.text) if right.kind == "lit" else (b, left.text)
            same = F.coalesce(_same_literal(F.when(var.startswith("{"), var), lit), F.lit(False))
        else:
            same = a.eqNullSafe(b)
        return same if op == "=" else ~same
    x, y = _number(a), _number(b)
    return F.coalesce({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], F.lit(False))
