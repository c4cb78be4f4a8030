"""Queries of the training-data problems that belong to the core (1, 2, 4, 5, 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import timetext as tt
from claimweave.operators.hierarchy import build_hierarchy
from claimweave.operators.instants import normalise_instants
from claimweave.operators import heavy, periods, wide
from claimweave.plans.runtime import table


def instants_all(spark: SparkSession, folder: str, estimate: bool = True) -> DataFrame:
    """Every dated record of both tables with ``norm`` and ``basis``; with ``estimate``, zones of silent sources are estimated."""
    sources = table(spark, folder, "sources")
    zones = estimate and [
        r[0]  # as many as the time-zone database has at most, whatever the register's size
        for r in sources.select(tt.zone_name(F.col("tz"), tt.known_zones(spark)).alias("tz")).where("tz is not null").distinct().orderBy("tz").collect()
    ]
    life = (
        table(spark, folder, "life_events")
        .where("date is not null")
        .select(F.lit("life_events").alias("tbl"), F.col("id").alias("rec_id"), F.col("date").alias("value"), "source_id", F.col("loaded_at").alias("arrived"))
        .join(sources.select(F.col("id").alias("source_id"), "tz", "date_order"), "source_id", "left")
        .withColumnRenamed("source_id", "source")
    )
    instants = table(spark, folder, "predicate_types").where("value_type = 'instant'").select("predicate")
    stmts = (
        table(spark, folder, "statements")
        .where("object_lit is not null")
        .join(F.broadcast(instants), "predicate", "left_semi")  # predicate_types: a fixed register
        .select(
            F.lit("statements").alias("tbl"), F.col("stmt_id").cast("string").alias("rec_id"),
            F.get_json_object("object_lit", "$.v").alias("value"), "context", F.col("received_at").alias("arrived"),
        )
        .join(sources.select(F.col("context_iri").alias("context"), F.col("id").alias("source"), "tz", "date_order"), "context", "left")
        .drop("context")
    )
    both = life.select("tbl", "rec_id", "value", "source", "tz", "date_order", "arrived").unionByName(stmts)
    return normalise_instants(
        both, F.col("value"), F.col("tz"), F.col("date_order"), F.col("source"), F.col("arrived"), candidates=zones or None
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records with a normal form; an estimated zone is no known one here, so none is estimated (``p1_instants`` does)."""
    return instants_all(spark, folder, estimate=False).where("norm is not null").select("tbl", "rec_id", "norm").distinct()


def p1_instants(spark: SparkSession, folder: str) -> DataFrame:
    """Records with a normal form and what it rests on, estimated zones included."""
    return instants_all(spark, folder).where("norm is not null").select("tbl", "rec_id", "norm", "basis").distinct()


def _single_typed(spark: SparkSession, folder: str) -> list[tuple[str, str, bool]]:
    types = table(spark, folder, "predicate_types")
    return [a for a in wide.attribute_list(types) if not a[2] and a[1] in ("integer", "double", "boolean", "iri")]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of single-valued typed predicates that have asserted rows but can't be filled."""
    attributes = _single_typed(spark, folder)
    full = wide.grid(wide.cells(table(spark, folder, "statements"), attributes), len(attributes))
    return wide.unfilled_cells(full, attributes).select("subject", "predicate")


def p2_wide(spark: SparkSession, folder: str) -> DataFrame:
    """The wide table itself, over all predicates of the register; many-valued ones are arrays of the declared type."""
    return wide.pivot_typed(table(spark, folder, "statements"), wide.attribute_list(table(spark, folder, "predicate_types")), lists=True)


def p2_overflow(spark: SparkSession, folder: str) -> DataFrame:
    """All values of the many-valued cells that are null in the wide table because they hold too many for one row."""
    return wide.overflow_values(table(spark, folder, "statements"), wide.attribute_list(table(spark, folder, "predicate_types")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Stored counts per batch and key that are null, missing, wrong or without any statement."""
    keys = {"predicate": "predicate_rows", "context": "context_rows"}
    both = F.array(*[F.struct(F.lit(name).alias("listing"), F.col(name).alias("item")) for name in keys])
    rows = table(spark, folder, "statements").select("batch_id", "stmt_id", F.inline(both))  # both listings in one pass
    real = heavy.distinct_counts(rows, ["batch_id", "listing"], "item", "stmt_id")
    stored = None
    for name, stored_in in keys.items():
        part = table(spark, folder, stored_in).select("batch_id", F.lit(name).alias("listing"), F.col(name).alias("item"), "count")
        stored = part if stored is None else stored.unionByName(part)
    # one stored row per batch and key; repeated or contradicting ones are wrong unless all agree
    told = stored.groupBy("batch_id", "listing", "item").agg(
        F.min("count").alias("lo"), F.max("count").alias("hi"), F.count("*").alias("rows"), F.count("count").alias("known")
    )
    both = real.join(told, ["batch_id", "listing", "item"], "full_outer")
    right = (F.col("rows") == F.col("known")) & (F.col("lo") == F.col("n")) & (F.col("hi") == F.col("n"))
    return both.where(~F.coalesce(right, F.lit(False))).select("listing", F.col("batch_id").cast("int").alias("batch_id"), "item")


def history_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """History rows as ``subject, predicate, axis, lo, hi``: days for valid time, microseconds for transaction time."""
    h = table(spark, folder, "history")
    both = F.array(
        F.struct(F.lit("valid").alias("axis"), F.unix_date("valid_lo").cast("long").alias("lo"), F.unix_date("valid_hi").cast("long").alias("hi")),
        F.struct(
            F.lit("tx").alias("axis"), F.unix_micros(F.col("tx_lo").cast("timestamp")).alias("lo"),
            F.unix_micros(F.col("tx_hi").cast("timestamp")).alias("hi"),
        ),
    )
    return h.select("subject", "predicate", F.inline(both))


def _all_gaps(rows: DataFrame) -> DataFrame:
    keys = ["subject", "predicate", "axis"]
    # cells for hot groups: 512 days, 2**36 microseconds (19 hours)
    return periods.gaps(rows.where("axis = 'valid'"), keys, 9).unionByName(periods.gaps(rows.where("axis = 'tx'"), keys, 36))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps between the continuous periods of each subject and predicate, on both time axes."""
    return _all_gaps(history_intervals(spark, folder))


def p5_periods(spark: SparkSession, folder: str) -> DataFrame:
    """The continuous periods of each subject and predicate, on both time axes; null is an open end."""
    rows = history_intervals(spark, folder)
    return periods.periods_from_gaps(rows, _all_gaps(rows), ["subject", "predicate", "axis"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Root and depth of every context; -1 and the loop's smallest iri in a loop or below one."""
    h = build_hierarchy(table(spark, folder, "contexts"), "iri", "parent", "req_id")
    return h.nodes.select(F.col("node").alias("iri"), "root", "depth")


def p4_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Full path and number of descendants of every context outside loops."""
    h = build_hierarchy(table(spark, folder, "contexts"), "iri", "parent", "req_id")
    sizes = h.nodes.where("depth >= 0").select("node", (F.col("size") - 1).alias("n_descendants"))
    paths = h.full_paths().select("node", F.array_join("path", " > ").alias("path"))
    return paths.join(sizes, "node").select(F.col("node").alias("iri"), "path", "n_descendants")


def p4_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every context outside loops with each of its descendants."""
    return build_hierarchy(table(spark, folder, "contexts"), "iri", "parent", "req_id").descendants()


SQL = {
    "p6_found": (
        "SELECT DISTINCT 'predicate' AS listing, batch_id, predicate AS item FROM "
        "(SELECT batch_id, predicate, min(count) AS lo, max(count) AS hi, count(*) AS r, count(count) AS k FROM predicate_rows GROUP BY 1, 2) t FULL JOIN "
        "(SELECT batch_id, predicate, count(DISTINCT stmt_id) AS n FROM statements WHERE batch_id IS NOT NULL AND predicate IS NOT NULL GROUP BY 1, 2) s USING (batch_id, predicate) "
        "WHERE NOT coalesce(r = k AND lo = n AND hi = n, false) UNION ALL "
        "SELECT DISTINCT 'context', batch_id, context FROM "
        "(SELECT batch_id, context, min(count) AS lo, max(count) AS hi, count(*) AS r, count(count) AS k FROM context_rows GROUP BY 1, 2) t FULL JOIN "
        "(SELECT batch_id, context, count(DISTINCT stmt_id) AS n FROM statements WHERE batch_id IS NOT NULL AND context IS NOT NULL GROUP BY 1, 2) s USING (batch_id, context) "
        "WHERE NOT coalesce(r = k AND lo = n AND hi = n, false)"
    ),
    "p5_found": (
        "WITH i AS (SELECT subject, predicate, 'valid' AS axis, coalesce(date_diff('day', DATE '1970-01-01', valid_lo), -4611686018427387904) AS lo, "
        "coalesce(date_diff('day', DATE '1970-01-01', valid_hi), 4611686018427387904) AS hi FROM history UNION ALL "
        "SELECT subject, predicate, 'tx', coalesce(epoch_us(tx_lo), -4611686018427387904), coalesce(epoch_us(tx_hi), 4611686018427387904) FROM history), "
        "o AS (SELECT *, max(hi) OVER (PARTITION BY subject, predicate, axis ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM i WHERE lo < hi AND subject IS NOT NULL AND predicate IS NOT NULL) "
        "SELECT subject, predicate, axis, CAST(e AS BIGINT) AS gap_lo, CAST(lo AS BIGINT) AS gap_hi FROM o WHERE lo > e"
    ),
    "p5_periods": (
        "WITH i AS (SELECT subject, predicate, 'valid' AS axis, coalesce(date_diff('day', DATE '1970-01-01', valid_lo), -4611686018427387904) AS lo, "
        "coalesce(date_diff('day', DATE '1970-01-01', valid_hi), 4611686018427387904) AS hi FROM history UNION ALL "
        "SELECT subject, predicate, 'tx', coalesce(epoch_us(tx_lo), -4611686018427387904), coalesce(epoch_us(tx_hi), 4611686018427387904) FROM history), "
        "o AS (SELECT *, max(hi) OVER (PARTITION BY subject, predicate, axis ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM i WHERE lo < hi AND subject IS NOT NULL AND predicate IS NOT NULL), "
        "g AS (SELECT *, sum(CASE WHEN e IS NULL OR lo > e THEN 1 ELSE 0 END) OVER (PARTITION BY subject, predicate, axis ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM o) "
        "SELECT subject, predicate, axis, CAST(nullif(min(lo), -4611686018427387904) AS BIGINT) AS period_lo, CAST(nullif(max(hi), 4611686018427387904) AS BIGINT) AS period_hi FROM g GROUP BY subject, predicate, axis, k"
    ),
    "p4_found": (
        "WITH RECURSIVE c AS (SELECT iri, arg_min(coalesce(nullif(trim(coalesce(parent, '')), ''), ''), req_id) AS parent FROM contexts WHERE iri IS NOT NULL GROUP BY iri), "
        "n AS (SELECT c.iri, p.iri AS parent FROM c LEFT JOIN c p ON c.parent = p.iri), "
        "t AS (SELECT iri, iri AS root, 0 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.iri, t.root, t.depth + 1 FROM t JOIN n ON n.parent = t.iri), "
        "l AS (SELECT * FROM n WHERE iri NOT IN (SELECT iri FROM t)), "
        "r AS (SELECT iri AS start, parent AS node FROM l UNION SELECT r.start, l.parent FROM r JOIN l ON l.iri = r.node) "
        "SELECT iri, root, depth FROM t UNION ALL SELECT start, min(node), -1 FROM r WHERE node IN (SELECT start FROM r WHERE start = node) GROUP BY start"
    ),
    "p4_paths": (
        "WITH RECURSIVE c AS (SELECT iri, arg_min(coalesce(nullif(trim(coalesce(parent, '')), ''), ''), req_id) AS parent FROM contexts WHERE iri IS NOT NULL GROUP BY iri), "
        "n AS (SELECT c.iri, p.iri AS parent FROM c LEFT JOIN c p ON c.parent = p.iri), "
        "t AS (SELECT iri, iri AS path, [iri] AS nodes FROM n WHERE parent IS NULL UNION ALL SELECT n.iri, t.path || ' > ' || n.iri, list_append(t.nodes, n.iri) FROM t JOIN n ON n.parent = t.iri), "
        "d AS (SELECT a AS iri, count(*) - 1 AS k FROM (SELECT unnest(nodes) AS a FROM t) GROUP BY a) SELECT t.iri, t.path, d.k AS n_descendants FROM t JOIN d USING (iri)"
    ),
    "p4_descendants": (
        "WITH RECURSIVE c AS (SELECT iri, arg_min(coalesce(nullif(trim(coalesce(parent, '')), ''), ''), req_id) AS parent FROM contexts WHERE iri IS NOT NULL GROUP BY iri), "
        "n AS (SELECT c.iri, p.iri AS parent FROM c LEFT JOIN c p ON c.parent = p.iri), "
        "t AS (SELECT iri, [iri] AS nodes FROM n WHERE parent IS NULL UNION ALL SELECT n.iri, list_append(t.nodes, n.iri) FROM t JOIN n ON n.parent = t.iri) "
        "SELECT ancestor, node FROM (SELECT unnest(nodes) AS ancestor, iri AS node FROM t) WHERE ancestor <> node"
    ),
    "p2_found": (
        "WITH v AS (SELECT subject, predicate, value_type, object_iri, regexp_replace(json_extract_string(object_lit, '$.v'), '^\\s+|\\s+$', '', 'g') AS v FROM statements JOIN "
        "(SELECT DISTINCT * FROM predicate_types) USING (predicate) WHERE polarity = 'asserted' AND NOT many_values AND value_type IN ('integer', 'double', 'boolean', 'iri') AND subject IS NOT NULL), "
        "k AS (SELECT subject, predicate, CASE value_type "
        "WHEN 'integer' THEN CASE WHEN regexp_full_match(v, '[+-]?(\\d+|\\d{1,3}(,\\d{3})+)(\\.\\d*)?([eE][+-]?\\d{1,3})?') AND try_cast(replace(v, ',', '') AS DOUBLE) = floor(try_cast(replace(v, ',', '') AS DOUBLE)) "
        "THEN CAST(try_cast(replace(v, ',', '') AS DOUBLE) AS VARCHAR) END "
        "WHEN 'double' THEN CASE WHEN regexp_full_match(v, '[+-]?(\\d+([.,]\\d*)?|[.,]\\d+)([eE][+-]?\\d{1,3})?') THEN CAST(try_cast(replace(v, ',', '.') AS DOUBLE) AS VARCHAR) END "
        "WHEN 'boolean' THEN CASE WHEN lower(v) IN ('true', 'yes', 'y', '1') THEN 't' WHEN lower(v) IN ('false', 'no', 'n', '0') THEN 'f' END "
        "ELSE (SELECT CASE WHEN regexp_full_match(i, '[A-Za-z][A-Za-z0-9+.-]*:\\S+') THEN i END FROM (SELECT replace(regexp_replace(trim(coalesce(object_iri, v)), '^<|>$', '', 'g'), 'http://example.org/', 'ex:') AS i)) END AS key FROM v) "
        "SELECT subject, predicate FROM k GROUP BY 1, 2 HAVING count(key) = 0 OR count(DISTINCT key) > 1"
    ),
}
