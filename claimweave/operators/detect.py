"""Detectors: paraconsistency, rule durations, reviewer acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimweave.functions.timetext import fence


def normalised_entropy(counts: Column) -> Column:
    """Shannon entropy of an array of counts over log2 of the number of non-zero ones; 0 for one category or none."""
    live = F.filter(counts, lambda c: c > 0)
    total = F.aggregate(live, F.lit(0.0), lambda s, c: s + c)
    h = F.aggregate(live, F.lit(0.0), lambda s, c: s - (c / total) * F.log2(c / total))
    return F.when(F.size(live) <= 1, F.lit(0.0)).otherwise(h / F.log2(F.size(live).cast("double")))


def paraconsistency(claims: DataFrame, window_end=None, samples: int = 5) -> DataFrame:
    """Per subject and predicate with two polarities or more: counts, contexts, score and severity.

    Counts per polarity are aggregated first; what is then grouped per pair has at most
    one row per polarity. Contexts are counted distinct, sample ids are the smallest ones.
    """
    rows = claims.where("tx_hi is null")
    if window_end is not None:
        rows = rows.where(F.col("tx_lo") <= F.lit(window_end).cast("timestamp"))
    per = rows.groupBy("subject", "predicate", "polarity").agg(F.count("*").alias("n"), F.min("statement_id").alias("sample"))
    out = per.groupBy("subject", "predicate").agg(
        F.count("*").alias("distinct_polarities"), F.sort_array(F.collect_list("n")).alias("counts"),
        F.slice(F.sort_array(F.collect_list("sample")), 1, samples).alias("sample_statements"), F.sum("n").alias("n"),
    ).where("distinct_polarities > 1")
    contexts = rows.groupBy("subject", "predicate").agg(F.count_distinct("context").alias("distinct_contexts"))
    scored = out.join(contexts, ["subject", "predicate"]).withColumn("conflict_score", normalised_entropy(F.col("counts")))
    severity = F.when(F.col("conflict_score") >= 0.9, "critical").when(F.col("conflict_score") >= 0.6, "warning")
    return scored.withColumn("severity", severity).drop("counts")


def median_of(a: Column) -> Column:
    """Median of an array column (the mean of the middle two for an even length); pass a plain column, it is used four times."""
    s, n = F.sort_array(a), F.size(a)
    hi = F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n % 2 == 1, hi).otherwise((F.get(s, (n / 2 - 1).cast("int")) + hi) / 2)


def with_mad_z(df: DataFrame, value: str, prior: str, out: str = "z") -> DataFrame:
    """Adds (value - median) / (1.4826 * MAD) against an array column; a flat array gives 0 or infinity, an empty one null."""
    keep = df.columns
    s1 = fence(df, keep, median_of(F.col(prior)).alias("_med"))
    s2 = fence(s1, [*keep, "_med"], F.transform(prior, lambda x: F.abs(x - F.col("_med"))).alias("_dev"))
    s3 = fence(s2, [*keep, "_med"], median_of(F.col("_dev")).alias("_mad"))
    gap = F.col(value) - F.col("_med")
    z = F.when(F.col("_mad") == 0, F.when(gap == 0, 0.0).otherwise(F.lit(float("inf")))).otherwise(gap / (1.4826 * F.col("_mad")))
    return fence(s3, keep, z.alias(out))


def rule_duration(reports: DataFrame, days: int = 30, least: int = 3, most: int = 100, warn: float = 5.0, critical: float = 10.0) -> DataFrame:
    """Runs that took unusually long for their rule: ``rule, report_id, z, severity``.

    Each run is held against at most ``most`` earlier runs of the same rule within
    ``days``; ties in time are ordered by report id. The window frame is bounded by rows,
    so no task ever holds more than that per run.
    """
    timed = reports.where("duration is not null")
    w = W.partitionBy("rule").orderBy("evaluated_at", "report_id").rowsBetween(-most, -1)
    seen = timed.withColumn("_prior", F.collect_list(F.struct("evaluated_at", "duration")).over(w))
    since = F.col("evaluated_at") - F.make_dt_interval(F.lit(days))
    prior = F.transform(F.filter("_prior", lambda p: p["evaluated_at"] >= since), lambda p: p["duration"].cast("double"))
    near = fence(seen, ["rule", "report_id"], F.col("duration").cast("double").alias("_x"), prior.alias("_d"))
    out = with_mad_z(near.where(F.size("_d") >= least), "_x", "_d")
    return out.where(F.col("z") > warn).select("rule", "report_id", "z", F.when(F.col("z") > critical, "critical").otherwise("warning").alias("severity"))


def null_rate(reports: DataFrame) -> DataFrame:
    """``rule, total, nulls, rate`` of missing durations."""
    out = reports.groupBy("rule").agg(F.count("*").alias("total"), F.count_if(F.col("duration").isNull()).alias("nulls"))
    return out.withColumn("rate", F.when(F.col("total") == 0, 0.0).otherwise(F.col("nulls") / F.col("total")))


def reviewer_acceptance(reviews: DataFrame, least: int = 5, limit: float = 0.4) -> DataFrame:
    """Per context and reviewer: decisions, rejects and whether the reject rate is a warning."""
    out = reviews.groupBy(F.coalesce("review_context", F.lit("_no_context")).alias("context"), "reviewer_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("decision") == "accept").alias("accepts"), F.count_if(F.col("decision") == "reject").alias("rejects")
    )
    rate = F.col("rejects") / F.col("total")
    return out.withColumn("reject_rate", rate).withColumn("warning", (rate >= limit) & (F.col("total") >= least))
