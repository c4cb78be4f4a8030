"""Registered queries over the claim model, each beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.functions import scalars as s
from claimweave.operators import align, browse, claims as cl, detect, evidence, fixpoint, policy, scope
from claimweave.plans import fixtures as fx
from claimweave.plans.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = (f"WITH RECURSIVE {', '.join(views)} " if views else "") + sql
        return fn

    return add


def _text(df, *columns):
    """Dates as text: the two engines' drivers render them differently."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


C, X, A, G, R = fx.CLAIMS_SQL, fx.CONTEXTS_SQL, fx.ALIGN_SQL, fx.ARGS_SQL, fx.REVIEWS_SQL
V = "coalesce(object_iri, json_extract_string(object_lit, '$.v'))"
ROOTS = "'ctx:src/s01', 'ctx:src/s12'"
UNDER = f"sc AS (SELECT iri FROM ctx WHERE iri IN ({ROOTS}) UNION SELECT ctx.iri FROM ctx JOIN sc ON ctx.parent = sc.iri)"


@query(
    "SELECT c.statement_id, c.subject, c.predicate, c.context, c.maturity, coalesce(f.net, 0) AS pressure FROM claims c "
    "LEFT JOIN (SELECT target, count(*) FILTER (relation = 'supports') - count(*) FILTER (relation IN ('rebuts', 'undercuts')) AS net FROM args GROUP BY target "
    "HAVING count(*) FILTER (relation IN ('rebuts', 'undercuts')) > 0) f ON f.target = c.statement_id "
    "WHERE tx_hi IS NULL AND polarity = 'asserted' AND maturity >= 2 AND context IN (SELECT iri FROM sc) ORDER BY pressure DESC, c.statement_id LIMIT 20",
    C, X, G, UNDER,
)
def flagship(spark, folder):
    """Open asserted claims of maturity 2 or more below two contexts, most pressed first, top 20."""
    sc = scope.resolve_scope(fx.contexts(spark, folder), include=["ctx:src/s01", "ctx:src/s12"])
    rows = cl.match(fx.claims(spark, folder), scope=sc, min_maturity=2)
    front = evidence.contradiction_frontier(fx.arguments(spark, folder)).select("statement_id", "net_pressure")
    out = rows.join(front, "statement_id", "left").withColumn("pressure", F.coalesce("net_pressure", F.lit(0)))
    return out.select("statement_id", "subject", "predicate", "context", "maturity", "pressure").orderBy(F.desc("pressure"), "statement_id").limit(20)


@query("SELECT statement_id, subject, predicate, object_iri, context FROM claims WHERE tx_hi IS NULL AND polarity = 'asserted' AND predicate = 'ex:residesIn'", C)
def match_strict(spark, folder):
    return cl.match(fx.claims(spark, folder), predicate="ex:residesIn").select("statement_id", "subject", "predicate", "object_iri", "context")


@query(
    "SELECT statement_id, polarity FROM claims WHERE (tx_lo IS NULL OR tx_lo <= TIMESTAMP '2025-12-01') AND (tx_hi IS NULL OR tx_hi > TIMESTAMP '2025-12-01') "
    "AND (valid_lo IS NULL OR valid_lo <= DATE '1930-06-01') AND (valid_hi IS NULL OR valid_hi > DATE '1930-06-01')", C,
)
def match_as_of(spark, folder):
    return cl.match(fx.claims(spark, folder), polarity=None, as_of_tx="2025-12-01", as_of_valid="1930-06-01").select("statement_id", "polarity")


@query("SELECT iri AS context FROM sc", X, UNDER)
def resolve_scope(spark, folder):
    return scope.resolve_scope(fx.contexts(spark, folder), include=["ctx:src/s01", "ctx:src/s12"])


@query(f"SELECT iri AS context FROM ctx WHERE iri NOT IN ({ROOTS}) AND (kind IS NULL OR kind <> 'hypothesis')", X)
def resolve_scope_exclude(spark, folder):
    """Only the named contexts go; what lies below them stays."""
    return scope.resolve_scope(fx.contexts(spark, folder), exclude=["ctx:src/s01", "ctx:src/s12"], exclude_kinds=["hypothesis"])


@query("SELECT DISTINCT seed, node FROM up", X, "up AS (SELECT iri AS seed, parent AS node FROM ctx WHERE parent IS NOT NULL UNION SELECT up.seed, ctx.parent FROM up JOIN ctx ON ctx.iri = up.node WHERE ctx.parent IS NOT NULL)")
def context_ancestors(spark, folder):
    ctx = fx.contexts(spark, folder)
    e = ctx.select(F.col("iri").alias("src"), F.col("parent").alias("dst"))
    return fixpoint.transitive_closure(e).select(F.col("src").alias("seed"), F.col("dst").alias("node"))


@query("SELECT statement_id FROM claims WHERE tx_hi IS NULL AND context IN (SELECT iri FROM sc)", C, X, UNDER)
def snapshot_members(spark, folder):
    sc = scope.resolve_scope(fx.contexts(spark, folder), include=["ctx:src/s01", "ctx:src/s12"])
    return cl.snapshot(fx.claims(spark, folder), sc)


@query(
    "SELECT c.statement_id, CASE WHEN m.k IS NOT NULL THEN 'conflicting' ELSE c.polarity END AS effective FROM (SELECT *, coalesce('i' || object_iri, 'l' || object_lit) AS k FROM claims WHERE tx_hi IS NULL) c "
    "LEFT JOIN (SELECT subject, predicate, context, coalesce('i' || object_iri, 'l' || object_lit) AS k FROM claims WHERE tx_hi IS NULL GROUP BY ALL HAVING count(DISTINCT polarity) > 1) m USING (subject, predicate, context, k)", C,
)
def effective_polarity(spark, folder):
    return cl.effective_polarity(fx.claims(spark, folder)).select("statement_id", "effective")


@query(
    "SELECT statement_id, sha256(concat_ws(chr(31), coalesce(subject, ''), coalesce(predicate, ''), coalesce(object_iri, ''), coalesce(object_lit, ''), coalesce(context, ''), "
    "coalesce(polarity, ''), coalesce(CAST(valid_lo AS VARCHAR), ''), coalesce(CAST(valid_hi AS VARCHAR), ''))) AS content_hash FROM claims", C,
)
def content_hash(spark, folder):
    return cl.with_hash(fx.claims(spark, folder)).select("statement_id", "content_hash")


@query(
    "SELECT subject, predicate, object_iri, context, polarity FROM (SELECT DISTINCT subject, predicate, object_iri, object_lit, context, polarity, valid_lo, valid_hi FROM statements "
    "WHERE (object_iri IS NULL) <> (object_lit IS NULL) AND subject IS NOT NULL AND predicate IS NOT NULL AND context IS NOT NULL AND polarity IS NOT NULL)",
)
def assert_batch(spark, folder):
    new = table(spark, folder, "statements").where("context is not null and polarity is not null").drop("stmt_id", "batch_id", "received_at")
    rows, _ = cl.assert_batch(fx.claims(spark, folder).limit(0), new, F.lit("2026-01-01").cast("timestamp"))
    return rows.select("subject", "predicate", "object_iri", "context", "polarity")


@query("SELECT statement_id FROM claims WHERE tx_hi IS NULL AND polarity <> 'negated'", C)
def retract_negated(spark, folder):
    rows = fx.claims(spark, folder)
    return cl.open_at(cl.retract(rows, rows.where("polarity = 'negated'"), F.lit("2027-01-01").cast("timestamp"))).select("statement_id")


_CLOSURE = (
    "e AS (SELECT predicate AS predicate, predicate AS equivalent, 'self' AS relation, false AS swap, 1.0::DOUBLE AS confidence, 0 AS rank FROM predicate_types UNION ALL "
    "SELECT source, target, relation, false, confidence, 1 FROM al WHERE relation = 'exact_equivalent' UNION ALL SELECT target, source, relation, false, confidence, 2 FROM al WHERE relation = 'exact_equivalent' UNION ALL "
    "SELECT source, target, relation, true, confidence, 3 FROM al WHERE relation = 'inverse_equivalent' UNION ALL SELECT target, source, relation, true, confidence, 4 FROM al WHERE relation = 'inverse_equivalent' UNION ALL "
    "SELECT target, source, relation, false, confidence, 5 FROM al WHERE relation = 'sub_property_of' UNION ALL SELECT source, target, relation, false, confidence, 6 FROM al WHERE relation = 'close_match' AND confidence >= 0.8 UNION ALL "
    "SELECT target, source, relation, false, confidence, 7 FROM al WHERE relation = 'close_match' AND confidence >= 0.8)"
)


@query("SELECT predicate, equivalent, relation, swap, confidence FROM e QUALIFY row_number() OVER (PARTITION BY predicate, equivalent ORDER BY rank, coalesce(confidence, -1) DESC) = 1", A, _CLOSURE)
def predicate_closure(spark, folder):
    return align.closure(fx.predicates(spark, folder), fx.alignments(spark, folder))


_VIA = "al2 AS (SELECT * FROM (VALUES ('ex:residesIn', 'ex:spokenIn', false, 0.9), ('ex:residesIn', 'ex:ownedBy', true, 0.85), ('ex:residesIn', 'ex:employedBy', false, 0.5)) t(predicate, equivalent, swap, confidence))"


@query(
    "SELECT statement_id, subject, object_iri, 'direct' AS matched_via FROM claims WHERE tx_hi IS NULL AND polarity = 'asserted' AND predicate = 'ex:residesIn' UNION ALL "
    "SELECT statement_id, CASE WHEN swap THEN object_iri ELSE subject END, CASE WHEN swap THEN subject ELSE object_iri END, CASE WHEN swap THEN 'inverse_equivalent' ELSE 'exact_equivalent' END "
    "FROM claims JOIN al2 ON claims.predicate = al2.equivalent WHERE tx_hi IS NULL AND polarity = 'asserted' AND confidence >= 0.8 AND (NOT swap OR object_iri IS NOT NULL)", C, _VIA,
)
def match_aligned(spark, folder):
    edges = [("ex:residesIn", "ex:spokenIn", "exact_equivalent", False, 0.9), ("ex:residesIn", "ex:ownedBy", "inverse_equivalent", True, 0.85), ("ex:residesIn", "ex:employedBy", "exact_equivalent", False, 0.5)]
    closure = spark.createDataFrame(edges, "predicate string, equivalent string, relation string, swap boolean, confidence double")
    return cl.match_aligned(fx.claims(spark, folder), closure, "ex:residesIn").select("statement_id", "subject", "object_iri", "matched_via")


@query("SELECT predicate, trim(regexp_replace(lower(regexp_replace(regexp_extract(predicate, '([^/#:]*)$', 1), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g')) AS words FROM predicate_types")
def normalize_predicate(spark, folder):
    return table(spark, folder, "predicate_types").select("predicate", s.local_words(F.col("predicate")).alias("words"))


_WORDS = (
    "w AS (SELECT predicate AS iri, unnest(string_split(trim(regexp_replace(lower(regexp_replace(regexp_extract(predicate, '([^/#:]*)$', 1), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g')), ' ')) AS word FROM predicate_types)"
)
_GRAMS = (
    "g AS (SELECT iri, list_distinct(flatten(list(list_transform(range(1, length(word) + 2), lambda i: substr('  ' || word || ' ', i, 3))))) AS g FROM w GROUP BY iri)"
)
_LIKE = "len(list_intersect(x.g, y.g)) / len(list_distinct(list_concat(x.g, y.g)))::DOUBLE"


@query(
    "SELECT x.iri AS a, y.iri AS b, round(len(list_intersect(x.g, y.g)) / len(list_distinct(list_concat(x.g, y.g)))::DOUBLE, 6) AS similarity FROM g x JOIN g y ON x.iri < y.iri "
    "WHERE len(list_intersect(x.g, y.g)) / len(list_distinct(list_concat(x.g, y.g)))::DOUBLE >= 0.4",
    _WORDS, _GRAMS,
)
def lexical_pairs(spark, folder):
    return align.lexical_pairs(fx.predicates(spark, folder), 0.4).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(
    f"SELECT DISTINCT least(a, b) AS source, greatest(a, b) AS target, round(sim, 6) AS confidence FROM (SELECT x.iri AS a, y.iri AS b, {_LIKE} AS sim FROM g x JOIN g y ON x.iri <> y.iri "
    f"WHERE {_LIKE} >= 0.5 AND (least(x.iri, y.iri), greatest(x.iri, y.iri)) NOT IN (SELECT least(source, target), greatest(source, target) FROM al)) QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) = 1",
    A, _WORDS, _GRAMS,
)
def auto_align(spark, folder):
    """Each predicate's best lexical partner that it isn't aligned with yet."""
    got = align.auto_align(fx.predicates(spark, folder), fx.alignments(spark, folder), 0.5)
    return got.select("source", "target", F.round("confidence", 6).alias("confidence"))


@query(
    f"SELECT y.iri AS target, round({_LIKE}, 6) AS similarity FROM g x JOIN g y ON x.iri = 'ex:birthYear' AND y.iri <> x.iri WHERE {_LIKE} >= 0.2 "
    "AND y.iri NOT IN (SELECT target FROM al WHERE source = 'ex:birthYear' UNION SELECT source FROM al WHERE target = 'ex:birthYear') ORDER BY similarity DESC, target LIMIT 50", A, _WORDS, _GRAMS,
)
def suggest_alignments(spark, folder):
    """Best lexical matches of one predicate that are not aligned with it yet: a top-50 report."""
    got = align.suggest_alignments(fx.predicates(spark, folder), fx.alignments(spark, folder), "ex:birthYear", 0.2, 50)
    return got.select("target", F.round("similarity", 6).alias("similarity"))


@query(
    "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))), 6) AS similarity "
    "FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 10",
)
def nearest_vectors(spark, folder):
    v = table(spark, folder, "embeddings")
    first = v.orderBy("vec_id").select("embedding").first()  # one query vector
    return align.nearest_vectors(v, list(first[0])).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT target AS statement_id, count(*) FILTER (relation IN ('rebuts', 'undercuts')) AS attack_count, count(*) FILTER (relation = 'supports') AS support_count, count(*) FILTER (relation = 'supports') - count(*) FILTER (relation IN ('rebuts', 'undercuts')) AS net_pressure FROM args GROUP BY target HAVING count(*) FILTER (relation IN ('rebuts', 'undercuts')) > 0", G)
def contradiction_frontier(spark, folder):
    return evidence.contradiction_frontier(fx.arguments(spark, folder))


@query("SELECT source AS statement_id, argument_id, 'source' AS role, relation FROM args UNION ALL SELECT target, argument_id, 'target', relation FROM args", G)
def arguments_for(spark, folder):
    return evidence.arguments_for(fx.arguments(spark, folder))


@query("SELECT target, sum(CASE relation WHEN 'endorses' THEN 1 ELSE -1 END)::BIGINT AS weight, count(*) AS n FROM args WHERE relation IN ('endorses', 'rebuts') GROUP BY target", G)
def endorsement_weights(spark, folder):
    kinds = F.when(F.col("relation") == "endorses", "endorses").when(F.col("relation") == "rebuts", "rejects")
    return evidence.endorsement_weights(fx.arguments(spark, folder).withColumn("kind", kinds))


@query("SELECT target_id, arg_max(decision, (created_at, review_id)) AS last_decision, count(*) AS review_count FROM rv GROUP BY target_id", R)
def review_queue(spark, folder):
    return evidence.review_queue(fx.reviews(spark, folder)).drop("last_review_at")


@query("SELECT coalesce(review_context, '_no_context') AS context, reviewer_id, count(*) AS total, count(*) FILTER (decision = 'accept') AS accepts, count(*) FILTER (decision = 'reject') AS rejects, round(count(*) FILTER (decision = 'reject') / count(*)::DOUBLE, 6) AS reject_rate, count(*) FILTER (decision = 'reject') / count(*)::DOUBLE >= 0.4 AND count(*) >= 5 AS warning FROM rv GROUP BY ALL", R)
def reviewer_acceptance(spark, folder):
    return detect.reviewer_acceptance(fx.reviews(spark, folder)).withColumn("reject_rate", F.round("reject_rate", 6))


@query(
    "SELECT subject, predicate, count(*) AS distinct_polarities, sum(n)::BIGINT AS n, round(-sum(n / t * log2(n / t)) / log2(count(*)), 6) AS conflict_score FROM "
    "(SELECT *, sum(n) OVER (PARTITION BY subject, predicate) AS t FROM (SELECT subject, predicate, polarity, count(*)::DOUBLE AS n FROM claims WHERE tx_hi IS NULL GROUP BY ALL)) GROUP BY subject, predicate HAVING count(*) > 1", C,
)
def paraconsistency(spark, folder):
    out = detect.paraconsistency(fx.claims(spark, folder))
    return out.select("subject", "predicate", "distinct_polarities", "n", F.round("conflict_score", 6).alias("conflict_score"))


@query("SELECT o_orderpriority AS rule, count(*) AS total, count(*) FILTER (o_orderkey % 10 = 0) AS nulls, round(count(*) FILTER (o_orderkey % 10 = 0) / count(*)::DOUBLE, 6) AS rate FROM orders GROUP BY 1")
def duration_null_rate(spark, folder):
    return detect.null_rate(_durations(spark, folder)).withColumn("rate", F.round("rate", 6))


def _durations(spark, folder):
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").select(F.col("o_orderpriority").alias("rule"), k.alias("report_id"), F.col("o_orderdate").alias("evaluated_at"), F.when(k % 10 != 0, F.col("o_totalprice")).alias("duration"))


@query(
    "SELECT rule, report_id, round(z, 6) AS z, CASE WHEN z > 10 THEN 'critical' ELSE 'warning' END AS severity FROM (SELECT rule, report_id, CASE WHEN mad = 0 THEN CASE WHEN x = med THEN 0.0 ELSE CAST('infinity' AS DOUBLE) END ELSE (x - med) / (1.4826 * mad) END AS z FROM "
    "(SELECT *, list_median(list_transform(d, lambda q: abs(q - med))) AS mad FROM (SELECT *, list_median(d) AS med FROM (SELECT rule, report_id, x, list_transform(list_filter(p, lambda q: q.t >= day - INTERVAL 30 DAY), lambda q: q.x) AS d FROM "
    "(SELECT rule, report_id, day, x, list({'t': day, 'x': x}) OVER (PARTITION BY rule ORDER BY day, report_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS p FROM "
    "(SELECT o_orderpriority AS rule, o_orderkey AS report_id, o_orderdate AS day, o_totalprice AS x FROM orders WHERE o_orderkey % 10 <> 0 AND o_totalprice IS NOT NULL))) WHERE len(d) >= 3))) WHERE z > 3",
)
def rule_duration(spark, folder):
    return detect.rule_duration(_durations(spark, folder), warn=3.0).withColumn("z", F.round("z", 6))


@query("SELECT context, count(*) AS statement_count, count(*) FILTER (tx_hi IS NULL) AS open_count FROM claims GROUP BY context", C)
def stats_context(spark, folder):
    return browse.stats_context(fx.claims(spark, folder)).drop("last_assert")


@query("SELECT context, maturity, polarity, count(*) AS n FROM claims WHERE tx_hi IS NULL GROUP BY ALL", C)
def stats_maturity(spark, folder):
    return browse.stats_maturity(fx.claims(spark, folder))


@query("SELECT t.predicate, count(s.predicate) AS use_count, count(DISTINCT s.context) AS context_count FROM (SELECT DISTINCT predicate FROM predicate_types) t LEFT JOIN statements s USING (predicate) GROUP BY 1")
def stats_predicate(spark, folder):
    return browse.stats_predicate(table(spark, folder, "statements"), table(spark, folder, "predicate_types"))


_EDGES = "ed AS (SELECT DISTINCT subject, predicate, object_iri FROM claims WHERE tx_hi IS NULL AND polarity = 'asserted' AND object_iri IS NOT NULL)"


@query("SELECT entity, count(*) AS degree FROM (SELECT subject AS entity, object_iri AS other, predicate, 'out' AS d FROM ed UNION SELECT object_iri, subject, predicate, 'in' FROM ed) GROUP BY entity", C, _EDGES)
def degrees(spark, folder):
    return browse.degrees(fx.claims(spark, folder))


@query(
    "SELECT node, min(depth) AS depth FROM (SELECT 'ex:place/2702' AS node, 0 AS depth UNION ALL SELECT b, 1 FROM un WHERE a = 'ex:place/2702' UNION ALL SELECT v.b, 2 FROM un u JOIN un v ON u.b = v.a WHERE u.a = 'ex:place/2702') GROUP BY node",
    C, _EDGES, "un AS (SELECT subject AS a, object_iri AS b FROM ed UNION SELECT object_iri, subject FROM ed)",
)
def neighbourhood(spark, folder):
    seeds = spark.createDataFrame([("ex:place/2702",)], "node string")
    return browse.neighbourhood(fx.claims(spark, folder), seeds, 2).select("node", "depth")


@query("SELECT context, count(*) AS n, count(DISTINCT subject) AS subjects, count(DISTINCT predicate) AS predicates FROM claims WHERE tx_hi IS NULL GROUP BY context", C)
def context_analytics(spark, folder):
    return browse.context_analytics(fx.claims(spark, folder))


@query("SELECT subject, min(context) AS context FROM claims WHERE tx_hi IS NULL GROUP BY subject HAVING count(DISTINCT context) = 1", C)
def exclusive_subjects(spark, folder):
    return browse.exclusive_subjects(fx.claims(spark, folder))


@query(
    f"SELECT DISTINCT a.subject, a.predicate, n.n_values, n.hard FROM claims a JOIN claims b ON a.subject = b.subject AND a.predicate = b.predicate AND a.statement_id < b.statement_id AND {V.replace('object', 'a.object')} <> {V.replace('object', 'b.object')} "
    f"JOIN (SELECT subject, predicate, count(DISTINCT {V}) AS n_values, min(maturity) FILTER ({V} IS NOT NULL) >= 3 AS hard FROM claims WHERE tx_hi IS NULL GROUP BY 1, 2) n ON n.subject = a.subject AND n.predicate = a.predicate "
    "WHERE a.tx_hi IS NULL AND b.tx_hi IS NULL AND a.predicate NOT LIKE 'claim:%' AND a.predicate NOT LIKE 'rdf:%'", C,
)
def contradictions(spark, folder):
    return browse.contradictions(fx.claims(spark, folder))


@query(f"SELECT subject, predicate, {V} AS value, count(DISTINCT context) AS n_contexts, max(maturity) AS max_maturity FROM claims WHERE tx_hi IS NULL AND predicate NOT LIKE 'claim:%' GROUP BY 1, 2, 3 HAVING count(DISTINCT context) > 1", C)
def corroborations(spark, folder):
    return browse.corroborations(fx.claims(spark, folder))


@query("SELECT object_iri AS type, count(DISTINCT subject) AS n FROM statements WHERE predicate = 'rdf:type' AND object_iri IS NOT NULL GROUP BY 1")
def type_histogram(spark, folder):
    return browse.type_histogram(table(spark, folder, "statements"))


@query("SELECT CAST(make_date(CAST(b * 10 + 1970 AS INT), 1, 1) AS VARCHAR) AS bucket_start, cnt, CAST(make_date(CAST(b * 10 + 1980 AS INT), 1, 1) AS VARCHAR) AS bucket_end FROM (SELECT floor((year(valid_lo) - 1970) / 10.0) AS b, count(*) AS cnt FROM claims WHERE tx_hi IS NULL AND valid_lo IS NOT NULL GROUP BY 1)", C)
def valid_time_decades(spark, folder):
    return _text(browse.time_buckets(fx.claims(spark, folder), months=120), "bucket_start", "bucket_end")


@query("SELECT CAST(CAST(tx_lo AS DATE) AS VARCHAR) AS day, count(*) AS n FROM claims GROUP BY 1", C)
def pulse(spark, folder):
    return _text(browse.pulse(fx.claims(spark, folder)), "day")


@query("SELECT CAST(day AS VARCHAR) AS day, count(*) AS new_predicates FROM (SELECT predicate, min(CAST(tx_lo AS DATE)) AS day FROM claims GROUP BY 1) GROUP BY 1", C)
def predicate_growth(spark, folder):
    return _text(browse.predicate_growth(fx.claims(spark, folder)), "day")


@query(
    f"SELECT subject, n, predicates, contradictions, round(0.3 * least(mat / 4, 1.0) + 0.2 * least(predicates / 20, 1.0) + 0.2 * corr / claims + 0.15 * (1 - least(least(contradictions, 100) / n * 100 / 10, 1.0)) + 0.15 * coverage, 5) AS score FROM "
    "(SELECT subject, count(*) AS n, avg(maturity) AS mat, count(DISTINCT predicate) AS predicates, (CAST(bool_or(predicate IN ('ex:residesIn', 'ex:livesAt')) AS INT) + CAST(bool_or(predicate IN ('ex:childOf', 'ex:spouseOf')) AS INT)) / 2.0 AS coverage "
    "FROM claims WHERE tx_hi IS NULL GROUP BY 1) s JOIN "
    f"(SELECT subject, count(*) FILTER (c >= 2) AS corr, count(*) AS claims FROM (SELECT subject, predicate, {V} AS v, count(DISTINCT context) AS c FROM claims WHERE tx_hi IS NULL GROUP BY 1, 2, 3) GROUP BY 1) r USING (subject) JOIN "
    f"(SELECT subject, count(*) FILTER (k > 1 AND predicate NOT LIKE 'claim:%' AND predicate NOT LIKE 'rdf:%') AS contradictions FROM (SELECT subject, predicate, count(DISTINCT {V}) AS k FROM claims WHERE tx_hi IS NULL GROUP BY 1, 2) GROUP BY 1) d USING (subject)", C,
)
def quality(spark, folder):
    expected = {"home": ["ex:residesIn", "ex:livesAt"], "kin": ["ex:childOf", "ex:spouseOf"]}
    return browse.quality(fx.claims(spark, folder), expected).withColumn("score", F.round("score", 5))


@query("SELECT count(*) AS n, count(DISTINCT subject) AS subjects, count(DISTINCT predicate) AS predicates, count(DISTINCT context) AS contexts, count(*) FILTER (maturity <= 1) AS hypotheses FROM claims WHERE tx_hi IS NULL", C)
def yield_metrics(spark, folder):
    return browse.yield_metrics(fx.claims(spark, folder))


@query("SELECT subject, predicate, count(DISTINCT coalesce(object_iri, object_lit)) AS n_values FROM claims WHERE tx_hi IS NULL AND polarity = 'asserted' GROUP BY 1, 2 HAVING count(DISTINCT coalesce(object_iri, object_lit)) > 1", C)
def shape_functional(spark, folder):
    return evidence.shape_functional(fx.claims(spark, folder))


@query(
    "SELECT DISTINCT stmt_id AS statement_id, CASE WHEN json_extract_string(object_lit, '$.dt') = CASE value_type WHEN 'string' THEN 'xsd:string' ELSE 'xsd:' || value_type END THEN 'pass' ELSE 'warn' END AS verdict "
    "FROM statements JOIN predicate_types USING (predicate)",
)
def shape_datatype(spark, folder):
    types = table(spark, folder, "predicate_types").select("predicate", F.concat(F.lit("xsd:"), "value_type").alias("datatype"))
    rows = table(spark, folder, "statements").select(F.col("stmt_id").alias("statement_id"), "predicate", "object_lit", F.lit(None).cast("timestamp").alias("tx_hi"))
    return evidence.shape_datatype(rows, types).distinct()


@query(
    "SELECT DISTINCT stmt_id AS statement_id, CASE WHEN try_cast(json_extract_string(object_lit, '$.v') AS DOUBLE) IS NOT NULL THEN 'pass' ELSE 'warn' END AS verdict "
    "FROM statements WHERE json_extract_string(object_lit, '$.dt') IN ('xsd:integer', 'xsd:decimal', 'xsd:double')",
)
def shape_numeric(spark, folder):
    rows = table(spark, folder, "statements").select(F.col("stmt_id").alias("statement_id"), "object_lit", F.lit(None).cast("timestamp").alias("tx_hi"))
    return evidence.shape_numeric(rows).distinct()


@query("SELECT DISTINCT object_iri AS subject, 'ex:hosts' AS predicate, subject AS object_iri FROM claims WHERE tx_hi IS NULL AND polarity = 'asserted' AND object_iri IS NOT NULL AND predicate = 'ex:residesIn'", C)
def emit_inverse(spark, folder):
    return evidence.emit_inverse(fx.claims(spark, folder), "ex:residesIn", "ex:hosts")


@query(
    "SELECT DISTINCT src, dst FROM tc", "lin AS (SELECT DISTINCT statement_id AS src, unnest(lineage) AS dst FROM history)",
    "tc AS (SELECT src, dst FROM lin UNION SELECT tc.src, lin.dst FROM tc JOIN lin ON tc.dst = lin.src)",
)
def lineage_closure(spark, folder):
    e = table(spark, folder, "history").select(F.col("statement_id").alias("src"), F.explode("lineage").alias("dst"))
    return fixpoint.transitive_closure(e)


@query(
    "SELECT id AS policy_iri, action, CASE WHEN n % 5 = 4 THEN false ELSE (n + i) % 3 <> 0 END AS allowed FROM (SELECT id, CAST(substr(id, 6, 2) AS INT) AS n FROM sources) s, "
    "(SELECT unnest(generate_series(0, 14)) AS i, unnest(['read_metadata','read_content','quote','view_anchor_location','derive_claims','derive_embeddings','translate','summarize','export_claims','export_sources','export_anchors','train_model','publish_release','share_with_third_party','federated_query']) AS action) a",
)
def effective_actions(spark, folder):
    caps = fx.capsules(spark, folder)
    assigned = caps.select(F.lit("source").alias("target_kind"), F.col("policy_iri").alias("target_id"), "policy_iri")
    return policy.effective_actions(assigned, caps).select(F.col("target_id").alias("policy_iri"), "action", "allowed")


@query(
    "SELECT DISTINCT stmt_id AS statement_id FROM statements WHERE NOT (stmt_id % 3 = 0 AND stmt_id IN (SELECT s.stmt_id FROM statements s JOIN documents d ON d.doc_id = s.stmt_id % 1000 AND s.stmt_id % 3 = 0 JOIN sources p ON p.id = d.source "
    "WHERE CAST(substr(p.id, 6, 2) AS INT) % 5 <> 4 AND (CAST(substr(p.id, 6, 2) AS INT) + 2) % 3 = 0))",
)
def policy_allows(spark, folder):
    ids = table(spark, folder, "statements").select(F.col("stmt_id").alias("statement_id")).distinct()
    links = ids.where("statement_id % 3 = 0").select("statement_id", (F.col("statement_id") % 1000).alias("doc_id"), F.lit(None).cast("timestamp").alias("tx_hi"))
    docs = table(spark, folder, "documents").select("doc_id", F.col("source").alias("policy_iri"))
    return policy.policy_allows(ids, links, docs, fx.capsules(spark, folder), "quote")


_FORMS = [("c. ", "year"), ("about ", "month"), ("", "day"), ("Circa ", "day"), ("approx. ", "year"), ("", "month"), ("after ", "unknown")]
_SHOWN = {"year": 4, "month": 7, "day": 10, "unknown": 4}


def _form_sql(mark: str, grain: str) -> str:
    lo = "CAST(NULL AS DATE)" if grain == "unknown" else f"date_trunc('{grain}', d)"
    return (
        f"SELECT '{mark}' || left(CAST(d AS VARCHAR), {_SHOWN[grain]}) || CASE WHEN day(d) % 2 = 0 THEN '?' ELSE '' END AS raw, '{grain}' AS grain, {lo} AS lo, "
        f"{mark not in ('', 'after ')} AS approximate, day(d) % 2 = 0 AS uncertain FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)"
    )


@query(
    "SELECT raw, grain, CAST(CAST(lo AS DATE) AS VARCHAR) AS lo, CAST(CAST(CASE grain WHEN 'year' THEN lo + INTERVAL 1 YEAR WHEN 'month' THEN lo + INTERVAL 1 MONTH WHEN 'day' THEN lo + INTERVAL 1 DAY END AS DATE) AS VARCHAR) AS hi, approximate, uncertain FROM ("
    + " UNION ALL ".join(_form_sql(*f) for f in _FORMS) + ")",
)
def time_expressions(spark, folder):
    """Approximate, uncertain, partial and unreadable times of every order date."""
    days = table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    tail = F.when(F.dayofmonth("d") % 2 == 0, "?").otherwise("")
    forms = [F.concat(F.lit(mark), F.substring(F.col("d").cast("string"), 1, _SHOWN[g]), tail) for mark, g in _FORMS]
    raw = days.select(F.explode(F.array(*forms)).alias("raw"))
    t = s.time_expression(F.col("raw"))
    return _text(raw.select("raw", t["grain"].alias("grain"), t["lo"].alias("lo"), t["hi"].alias("hi"), t["approximate"].alias("approximate"), t["uncertain"].alias("uncertain")), "lo", "hi")


@query(
    "SELECT event_id, polarity, maturity, (CASE polarity WHEN 'asserted' THEN 0 WHEN 'negated' THEN 1 WHEN 'absent' THEN 2 ELSE 3 END) | (maturity << 2) AS flags, "
    "CASE maturity WHEN 4 THEN 'E5' WHEN 5 THEN 'E4' ELSE 'E' || maturity END AS label FROM (SELECT event_id, CASE event_id % 11 WHEN 0 THEN 'negated' WHEN 1 THEN 'absent' WHEN 2 THEN 'unknown' ELSE 'asserted' END AS polarity, CAST(event_id % 6 AS INT) AS maturity FROM events)",
)
def flags_and_labels(spark, folder):
    k = F.col("event_id") % 11
    rows = table(spark, folder, "events").select("event_id", F.when(k == 0, "negated").when(k == 1, "absent").when(k == 2, "unknown").otherwise("asserted").alias("polarity"), (F.col("event_id") % 6).cast("int").alias("maturity"))
    return rows.select("event_id", "polarity", "maturity", s.pack_flags(F.col("polarity"), F.col("maturity")).alias("flags"), s.maturity_label(F.col("maturity")).alias("label"))


@query(
    "SELECT s.k AS query_id, t.k AS span_id FROM sp s JOIN sp t ON s.r = t.r AND t.a < s.b AND t.b > s.a",
    "sp AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_orderkey AS r, CAST(l_partkey % 500 AS BIGINT) AS a, CAST(l_partkey % 500 + l_quantity AS BIGINT) AS b FROM lineitem)",
)
def spans_overlapping(spark, folder):
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    sp = table(spark, folder, "lineitem").select(k.alias("span_id"), F.col("l_orderkey").alias("revision_id"), (F.col("l_partkey") % 500).cast("long").alias("start_offset"), (F.col("l_partkey") % 500 + F.col("l_quantity")).cast("long").alias("end_offset"))
    return evidence.spans_overlapping(sp, sp.withColumnRenamed("span_id", "query_id"))


@query("SELECT DISTINCT statement_id, 'claim:stmt/' || statement_id AS iri, statement_id AS back FROM history")
def statement_iris(spark, folder):
    ids = table(spark, folder, "history").select("statement_id").distinct()
    iri = s.statement_iri(F.col("statement_id"))
    return ids.select("statement_id", iri.alias("iri"), s.statement_id_of(iri).alias("back"))


@query("SELECT s.id AS source, count(h.statement_id) AS n FROM sources s LEFT JOIN (SELECT DISTINCT statement_id, context FROM history WHERE tx_hi IS NULL) h ON h.context = s.context_iri GROUP BY 1")
def list_contexts(spark, folder):
    open_ = fx.claims(spark, folder).where("tx_hi is null").groupBy("context").agg(F.count_distinct("statement_id").alias("k"))
    src = table(spark, folder, "sources").select(F.col("id").alias("source"), F.col("context_iri").alias("context"))
    return src.join(open_, "context", "left").select("source", F.coalesce("k", F.lit(0)).alias("n"))


def _store(spark, folder):
    from claimweave.query import Store

    ids = table(spark, folder, "history").select("statement_id").distinct()
    k = F.ascii("statement_id")
    return Store(
        fx.claims(spark, folder), contexts=fx.contexts(spark, folder), arguments=fx.arguments(spark, folder),
        modality=ids.where(k % 2 == 0).select("statement_id", F.when(k % 4 == 0, "descriptive").otherwise("inferred").alias("modality")),
    )


@query(
    "SELECT a.subject AS p, b.subject AS q FROM claims a JOIN claims b ON a.object_iri = b.object_iri WHERE a.predicate = 'ex:residesIn' AND b.predicate = 'ex:ownedBy' "
    "AND a.tx_hi IS NULL AND b.tx_hi IS NULL AND a.polarity = 'asserted' AND b.polarity = 'asserted'", C,
)
def language_join(spark, folder):
    """Two unpinned patterns joined on their object."""
    from claimweave.query import run

    return run(_store(spark, folder), "MATCH ?p ex:residesIn ?x, ?q ex:ownedBy ?x PROJECT ?p, ?q")


@query(
    "SELECT subject AS s, predicate AS p, object_iri AS o FROM claims WHERE tx_hi IS NULL AND polarity = 'asserted' AND maturity >= 2 AND object_iri IS NOT NULL AND predicate <> 'ex:holdsOffice' AND ascii(statement_id) % 4 = 0 "
    "AND context IN (SELECT iri FROM sc)", C, X, UNDER,
)
def language_overlays(spark, folder):
    from claimweave.query import run

    text = "MATCH ?s ?p ?o SCOPE include ctx:src/s01, ctx:src/s12 MATURITY >= 2 MODALITY descriptive FILTER ?p != ex:holdsOffice PREDICATES STRICT"
    return run(_store(spark, folder), text).where("not startswith(o, '{')")


@query("SELECT subject AS s, context AS g FROM claims WHERE tx_hi IS NULL AND polarity = 'asserted' AND predicate = 'ex:marriedTo'", C)
def sparql_graph(spark, folder):
    from claimweave.query import run

    return run(_store(spark, folder), "PREFIX e: <ex:> SELECT ?s ?g WHERE { GRAPH ?g { ?s e:marriedTo ?o . } }")


@query(
    "SELECT o_orderkey, round(CASE o_orderkey % 3 WHEN 0 THEN o_totalprice / 3600.0 WHEN 1 THEN o_totalprice * 0.001 END, 6) AS converted FROM orders",
)
def convert_units(spark, folder):
    from claimweave.operators import units

    k = F.col("o_orderkey") % 3
    rows = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("value"), F.when(k == 0, "unit:second").when(k == 1, "unit:gram").otherwise("unit:meter").alias("from_unit"),
        F.when(k == 0, "unit:hour").when(k == 1, "unit:kilogram").otherwise("unit:second").alias("to_unit"),
    )
    return units.convert(rows).select("o_orderkey", F.round("converted", 6).alias("converted"))


@query(
    "SELECT DISTINCT stmt_id, w.text FROM (SELECT stmt_id, json_extract_string(object_lit, '$.v') AS text FROM statements WHERE predicate = 'ex:title') w "
    "WHERE list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'papers') AND list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'folio')",
)
def match_text(spark, folder):
    from claimweave.operators import text

    rows = table(spark, folder, "statements").where("predicate = 'ex:title'").select("stmt_id", F.get_json_object("object_lit", "$.v").alias("text"))
    return text.match_text(rows, F.col("text"), "folio papers").select("stmt_id", "text").distinct()


@query(
    "SELECT e.subject, e.label, count(s.subject) AS n FROM (SELECT subject, arg_min(label, (length(label), label)) AS label FROM "
    "(SELECT DISTINCT subject, json_extract_string(object_lit, '$.v') AS label FROM statements WHERE predicate = 'ex:name') WHERE lower(label) LIKE '%elizabeth%' GROUP BY subject) e "
    "LEFT JOIN (SELECT DISTINCT stmt_id, subject FROM statements) s USING (subject) GROUP BY ALL",
)
def label_search(spark, folder):
    from claimweave.operators import text

    s_ = table(spark, folder, "statements")
    rows = s_.select("stmt_id", "subject", F.lit(None).cast("timestamp").alias("tx_hi")).distinct()
    labels = s_.where("predicate = 'ex:name'").select("subject", F.get_json_object("object_lit", "$.v").alias("label"))
    return text.label_search(rows, labels, "elizabeth")


@query(
    "SELECT s.predicate, coalesce(CASE WHEN a.lo <= DATE '1930-01-01' AND DATE '1930-01-01' < a.hi THEN a.canonical END, s.predicate) AS canonical, count(*) AS n FROM claims s "
    "LEFT JOIN (VALUES ('ex:residesIn', 'ex:livesAt', DATE '1900-01-01', DATE '1950-01-01'), ('ex:ownedBy', 'ex:heldBy', DATE '1950-01-01', DATE '1960-01-01')) a(predicate, canonical, lo, hi) USING (predicate) GROUP BY ALL", C,
)
def canonical_at(spark, folder):
    import datetime as dt

    al = spark.createDataFrame(
        [("ex:residesIn", "ex:livesAt", dt.date(1900, 1, 1), dt.date(1950, 1, 1)), ("ex:ownedBy", "ex:heldBy", dt.date(1950, 1, 1), dt.date(1960, 1, 1))],
        "alias string, canonical string, valid_lo date, valid_hi date",
    )
    rows = fx.claims(spark, folder).select("predicate", F.lit("1930-01-01").cast("date").alias("day"))
    return align.canonical_at(rows, al, fx.predicates(spark, folder)).groupBy("predicate", "canonical").agg(F.count("*").alias("n"))


@query(
    "SELECT statement_id, coalesce('ex:place/0', '') AS fixed, CASE WHEN ascii(statement_id) % 2 = 0 THEN (ascii(statement_id) / 200.0 + maturity / 5.0) / 2 ELSE ascii(statement_id) / 200.0 END AS value FROM claims", C,
)
def confidence_lens(spark, folder):
    k = F.ascii("statement_id")
    lanes = fx.claims(spark, folder).select(
        "statement_id", (k / 200.0).alias("confidence"), F.when(k % 2 == 0, F.col("maturity") / 5.0).alias("calibrated"),
        F.lit(None).cast("double").alias("human"), F.lit(None).cast("double").alias("reliability"),
    )
    return evidence.confidence_lens(lanes, "multi").select("statement_id", F.lit("ex:place/0").alias("fixed"), "value")


@query(
    "SELECT context, stage, count(*) FILTER (reached) AS reached_count, count(*) AS total_count FROM (SELECT context, 'derived' AS stage, statement_id IN (SELECT source FROM args) AS reached FROM claims "
    "UNION ALL SELECT context, 'unattacked', statement_id NOT IN (SELECT target FROM args WHERE relation IN ('rebuts', 'undercuts')) FROM claims) GROUP BY ALL", C, G,
)
def lifecycle_stages(spark, folder):
    args = fx.arguments(spark, folder)
    derived = args.select(F.col("source").alias("statement_id"))
    attacked = args.where(F.col("relation").isin(evidence.ATTACKS)).select(F.col("target").alias("statement_id"))
    return evidence.lifecycle_stages(fx.claims(spark, folder), {"derived": derived}, {"unattacked": attacked}).drop("coverage")


@query(
    "SELECT DISTINCT 'claim:frame/' || sha256(concat_ws(chr(31), subject, predicate, object_iri, context)) AS subject, r.p AS predicate, r.o AS object_iri, context FROM claims, "
    "LATERAL (SELECT unnest([{'p': 'rdf:type', 'o': 'ex:Event'}, {'p': predicate || '/subject', 'o': subject}, {'p': predicate || '/object', 'o': object_iri}]) AS r) WHERE object_iri IS NOT NULL", C,
)
def decompose_to_frame(spark, folder):
    return align.decompose_to_frame(fx.claims(spark, folder), "ex:Event")


@query(
    "SELECT statement_id, predicate AS canonical_predicate, coalesce(a.canonical, subject) AS canonical_subject FROM claims LEFT JOIN "
    "(SELECT DISTINCT subject, 'ex:merged/' || right(subject, 2) AS canonical FROM claims WHERE subject LIKE 'ex:person/%') a USING (subject) WHERE tx_hi IS NULL", C,
)
def canonical_shadows(spark, folder):
    rows = fx.claims(spark, folder)
    people = rows.where("subject like 'ex:person/%'").select("subject").distinct()
    aliases = people.select(F.col("subject").alias("alias"), F.concat(F.lit("ex:merged/"), F.expr("right(subject, 2)")).alias("canonical"), F.lit(0.9).alias("confidence"))
    closure = align.closure(fx.predicates(spark, folder), fx.alignments(spark, folder).limit(0))
    return align.shadows(rows, closure, aliases).select("statement_id", "canonical_predicate", "canonical_subject")


@query(
    "SELECT p_brand AS class, 'ex:type/' || p_type AS ancestor FROM (SELECT p_brand, max(p_type) AS p_type FROM part GROUP BY 1) UNION ALL SELECT p_brand, 'ex:root' FROM (SELECT DISTINCT p_brand FROM part)",
)
def class_ancestors(spark, folder):
    brands = table(spark, folder, "part").groupBy("p_brand").agg(F.concat(F.lit("ex:type/"), F.max("p_type")).alias("t"))
    e = brands.select(F.col("p_brand").alias("src"), F.col("t").alias("dst")).unionByName(brands.select(F.col("t").alias("src"), F.lit("ex:root").alias("dst")))
    got = fixpoint.reach(e, brands.select(F.col("p_brand").alias("node")), 16, include_seeds=False)
    return got.select(F.col("seed").alias("class"), F.col("node").alias("ancestor"))


@query("SELECT id, lang, CASE lower(coalesce(lang, '')) WHEN '' THEN 'english' WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' WHEN 'es' THEN 'spanish' ELSE 'simple' END AS config FROM sources")
def text_config(spark, folder):
    return table(spark, folder, "sources").select("id", "lang", s.text_config(F.col("lang")).alias("config"))


@query(
    "SELECT predicate, string_agg(DISTINCT subject, ',' ORDER BY subject) AS subjects, count(DISTINCT subject) = 2 AS shared FROM claims WHERE tx_hi IS NULL AND subject IN (SELECT min(subject) FROM claims UNION SELECT max(subject) FROM claims) GROUP BY 1", C,
)
def compare_subjects(spark, folder):
    rows = fx.claims(spark, folder)
    ends = rows.agg(F.min("subject").alias("a"), F.max("subject").alias("b")).first()
    return browse.compare(rows, [ends["a"], ends["b"]])


@query(
    "SELECT statement_id, context, 'primary' AS role FROM claims UNION ALL SELECT s.statement_id, c.context_iri, 'derived' FROM claims s JOIN sources c ON c.context_iri = 'ctx:src/s0' || (ascii(s.statement_id) % 10)", C,
)
def statement_contexts(spark, folder):
    rows = fx.claims(spark, folder)
    extra = rows.select("statement_id", F.concat(F.lit("ctx:src/s0"), (F.ascii("statement_id") % 10).cast("string")).alias("context"), F.lit("derived").alias("role"))
    known = table(spark, folder, "sources").select(F.col("context_iri").alias("context"))
    return scope.statement_contexts(rows, extra.join(known, "context", "left_semi"))


@query(
    "SELECT statement_id, sha256(concat_ws(chr(31), coalesce(subject, ''), coalesce(predicate, ''), coalesce(object_iri, ''), coalesce(object_lit, ''), coalesce(context, ''), "
    "coalesce(polarity, ''), coalesce(CAST(valid_lo AS VARCHAR), ''), coalesce(CAST(valid_hi AS VARCHAR), ''))) AS sha256 FROM claims WHERE tx_hi IS NULL AND context IN ('ctx:src/s01', 'ctx:src/s02')", C,
)
def release_rows(spark, folder):
    from claimweave.sources.release import release_rows as rows_of

    return rows_of(fx.claims(spark, folder), ["ctx:src/s01", "ctx:src/s02"]).select("statement_id", "sha256")
