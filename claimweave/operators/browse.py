"""Browsing and graph analytics over claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.operators.fixpoint import reach

VALUE = "coalesce(object_iri, get_json_object(object_lit, '$.v'))"


def edges(claims: DataFrame) -> DataFrame:
    return claims.where("tx_hi is null and polarity = 'asserted' and object_iri is not null").select("subject", "predicate", "object_iri", "context").distinct()


def stats_context(claims: DataFrame) -> DataFrame:
    """Per context: all rows, open rows, last assertion."""
    return claims.groupBy("context").agg(F.count("*").alias("statement_count"), F.count_if(F.col("tx_hi").isNull()).alias("open_count"), F.max("tx_lo").alias("last_assert"))


def stats_maturity(claims: DataFrame) -> DataFrame:
    return claims.where("tx_hi is null").groupBy("context", "maturity", "polarity").agg(F.count("*").alias("n"))


def stats_predicate(claims: DataFrame, predicates: DataFrame) -> DataFrame:
    """Uses and contexts of every registered predicate over all rows, closed ones too; unused ones show 0."""
    used = claims.groupBy("predicate").agg(F.count("*").alias("use_count"), F.count_distinct("context").alias("context_count"))
    out = predicates.select("predicate").distinct().join(used, "predicate", "left")
    return out.select("predicate", F.coalesce("use_count", F.lit(0)).alias("use_count"), F.coalesce("context_count", F.lit(0)).alias("context_count"))


def connections(claims: DataFrame) -> DataFrame:
    """Both directions of every open IRI claim: ``entity, other, predicate, direction``."""
    ends = F.array(
        F.struct(F.col("subject").alias("entity"), F.col("object_iri").alias("other"), F.lit("outgoing").alias("direction")),
        F.struct(F.col("object_iri").alias("entity"), F.col("subject").alias("other"), F.lit("incoming").alias("direction")),
    )
    return edges(claims).select("predicate", F.inline(ends)).distinct()


def neighbourhood(claims: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """``seed, node, depth`` within some hops, edges taken both ways."""
    e = connections(claims).select(F.col("entity").alias("src"), F.col("other").alias("dst"))
    return reach(e, seeds, depth)


def degrees(claims: DataFrame) -> DataFrame:
    return connections(claims).groupBy("entity").agg(F.count("*").alias("degree"))


def shortest_paths(claims: DataFrame, source: str, target: str, max_depth: int = 6, limit: int = 10) -> DataFrame:
    """Directed paths without repeated nodes from source to target, shortest first: ``path, depth``.

    The frontier is first cut to nodes that lie on some way to the target (backward
    reach), so it doesn't grow over the rest of the graph.
    """
    spark = claims.sparkSession
    e = edges(claims).select(F.col("subject").alias("src"), F.col("object_iri").alias("dst")).distinct()
    back = reach(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), spark.createDataFrame([(target,)], "node string"), max_depth)
    e = e.join(back.select(F.col("node").alias("dst"), F.col("depth").alias("left")), "dst")
    paths = spark.createDataFrame([(source, [source])], "node string, path array<string>")
    found = None
    for depth in range(1, max_depth + 1):
        step = paths.join(e, F.col("node") == F.col("src")).where(F.col("left") <= max_depth - depth).where(~F.array_contains("path", F.col("dst")))
        paths = step.select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        hit = paths.where(F.col("node") == target).select(F.array_join("path", " > ").alias("path"), F.lit(depth).alias("depth"))
        found = hit if found is None else found.unionByName(hit)
        paths = paths.where(F.col("node") != target)
    return found.orderBy("depth", "path").limit(limit)


def context_analytics(claims: DataFrame) -> DataFrame:
    rows = claims.where("tx_hi is null")
    return rows.groupBy("context").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"), F.count_distinct("predicate").alias("predicates"))


def exclusive_subjects(claims: DataFrame) -> DataFrame:
    """Subjects seen in one context only, and which."""
    return claims.where("tx_hi is null").groupBy("subject").agg(F.min("context").alias("context"), F.max("context").alias("_b")).where("context = _b").drop("_b")


OWN = "claim:"  # prefix of the engine's own predicates


def contradictions(claims: DataFrame) -> DataFrame:
    """Subject and predicate pairs with several values among open rows of any polarity; hard if all have maturity 3 or more.

    The engine's own predicates and those of the type system say nothing here. Grouped,
    not self-joined: a pair with very many values gives one row.
    """
    said = claims.where("tx_hi is null").where(~F.col("predicate").startswith(OWN) & ~F.col("predicate").startswith("rdf:"))
    rows = said.select("subject", "predicate", F.expr(VALUE).alias("value"), "maturity").where("value is not null")
    return rows.groupBy("subject", "predicate").agg(F.count_distinct("value").alias("n_values"), (F.min("maturity") >= 3).alias("hard")).where("n_values > 1")


def corroborations(claims: DataFrame) -> DataFrame:
    """Values that open rows of any polarity state in two contexts or more; own predicates aside."""
    said = claims.where("tx_hi is null").where(~F.col("predicate").startswith(OWN))
    rows = said.select("subject", "predicate", F.expr(VALUE).alias("value"), "context", "maturity")
    return rows.groupBy("subject", "predicate", "value").agg(F.count_distinct("context").alias("n_contexts"), F.max("maturity").alias("max_maturity")).where("n_contexts > 1")


def type_histogram(claims: DataFrame) -> DataFrame:
    return claims.where("predicate = 'rdf:type' and object_iri is not null").groupBy(F.col("object_iri").alias("type")).agg(F.count_distinct("subject").alias("n"))


def time_buckets(claims: DataFrame, months: int = 0, days: int = 0, epoch: str = "1970-01-01") -> DataFrame:
    """Open rows with a start of validity per bucket: ``bucket_start, bucket_end, cnt``."""
    from claimweave.functions.scalars import bucket_date, next_bucket

    rows = claims.where("tx_hi is null and valid_lo is not null").select(bucket_date(F.col("valid_lo"), months, days, epoch).alias("bucket_start"))
    return rows.groupBy("bucket_start").agg(F.count("*").alias("cnt")).withColumn("bucket_end", next_bucket(F.col("bucket_start"), months, days))


def compare(claims: DataFrame, subjects: list[str]) -> DataFrame:
    """Per predicate: which of the subjects have it, and whether all do."""
    rows = claims.where("tx_hi is null").where(F.col("subject").isin(subjects))
    return rows.groupBy("predicate").agg(F.array_join(F.sort_array(F.collect_set("subject")), ",").alias("subjects"), (F.count_distinct("subject") == len(subjects)).alias("shared"))


def pulse(claims: DataFrame) -> DataFrame:
    """Assertions per day."""
    return claims.groupBy(F.to_date("tx_lo").alias("day")).agg(F.count("*").alias("n"))


def predicate_growth(claims: DataFrame) -> DataFrame:
    """Number of predicates first seen on each day."""
    return claims.groupBy("predicate").agg(F.min(F.to_date("tx_lo")).alias("day")).groupBy("day").agg(F.count("*").alias("new_predicates"))


def quality(claims: DataFrame, expected: dict[str, list[str]]) -> DataFrame:
    """Per subject: mean maturity, predicates, share of corroborated values, contradictions, coverage of the expected categories, and one score.

    Weights: maturity of 4 at 0.3, twenty predicates at 0.2, corroboration at 0.2, freedom
    from contradictions (per hundred rows, none at ten) at 0.15, coverage at 0.15.
    """
    rows = claims.where("tx_hi is null").withColumn("value", F.expr(VALUE))
    values = rows.groupBy("subject", "predicate", "value").agg(F.count("*").alias("n"), F.sum("maturity").alias("m"), F.count_distinct("context").alias("contexts"))
    own = F.col("predicate").startswith(OWN) | F.col("predicate").startswith("rdf:")
    pairs = values.groupBy("subject", "predicate").agg(
        F.sum("n").alias("n"), F.sum("m").alias("m"), F.count("*").alias("k"), F.count_if(F.col("contexts") >= 2).alias("twice"), F.count("value").alias("told")
    )
    found = [F.max(F.col("predicate").isin(names).cast("int")) for names in expected.values()]
    out = pairs.groupBy("subject").agg(
        F.sum("n").alias("n"), (F.sum("m") / F.sum("n")).alias("maturity"), F.count("*").alias("predicates"), (F.sum("twice") / F.sum("k")).alias("corroborated"),
        F.count_if((F.col("told") > 1) & ~own).alias("contradictions"), (sum(found) / F.lit(float(len(expected)))).alias("coverage"),
    )
    calm = 1 - F.least(F.least(F.col("contradictions"), F.lit(100)) / F.col("n") * 100 / 10, F.lit(1.0))
    score = (
        0.3 * F.least(F.col("maturity") / 4, F.lit(1.0)) + 0.2 * F.least(F.col("predicates") / 20, F.lit(1.0)) + 0.2 * F.col("corroborated") + 0.15 * calm + 0.15 * F.col("coverage")
    )
    return out.select("subject", "n", "predicates", "contradictions", F.round(score, 6).alias("score"))


def yield_metrics(claims: DataFrame) -> DataFrame:
    rows = claims.where("tx_hi is null")
    return rows.agg(F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"), F.count_distinct("predicate").alias("predicates"), F.count_distinct("context").alias("contexts"), F.count_if(F.col("maturity") <= 1).alias("hypotheses"))


def check_disjointness(types: DataFrame, disjoint: DataFrame) -> DataFrame:
    """``subject, class_a, class_b`` of subjects that have two classes declared disjoint (class_a < class_b)."""
    t = types.select("subject", "class").distinct()
    d = disjoint.select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b")).distinct()
    first = t.join(d, F.col("class") == F.col("class_a")).select("subject", "class_a", "class_b")
    return first.join(t.select("subject", F.col("class").alias("class_b")), ["subject", "class_b"], "left_semi")
