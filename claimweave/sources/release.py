"""Release sinks: hashed statement lines, manifest, JSONL, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.scalars import content_hash


def release_rows(claims: DataFrame, contexts: list[str]) -> DataFrame:
    """Open statements of the listed contexts, every polarity, with their content hash."""
    c = F.col
    rows = claims.where("tx_hi is null").where(c("context").isin(contexts))
    h = content_hash(c("subject"), c("predicate"), c("object_iri"), c("object_lit"), c("context"), c("polarity"), c("valid_lo"), c("valid_hi"))
    return rows.withColumn("sha256", h)


def manifest(rows: DataFrame, buckets: int = 4_096) -> DataFrame:
    """One row: number of statements, contexts, and a hash over all statement hashes.

    Hashes are sorted and hashed inside ``buckets`` groups by their first digits, then over
    the group hashes, so the result doesn't depend on partitioning and no task sorts all.
    """
    distinct = rows.select("sha256").distinct()
    part = distinct.groupBy(F.pmod(F.conv(F.substring("sha256", 1, 8), 16, 10).cast("long"), F.lit(buckets)).alias("b")).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list("sha256")), ""), 256).alias("h")
    )
    total = part.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256).alias("manifest_sha256"))
    counts = rows.agg(F.count("*").alias("statements"), F.count_distinct("context").alias("contexts"))
    return counts.join(F.broadcast(total))  # one row beside one row


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object per statement, ordered by hash inside each file."""
    rows.repartitionByRange("sha256").sortWithinPartitions("sha256").write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.repartitionByRange("sha256").sortWithinPartitions("sha256").write.mode("overwrite").option("header", True).csv(path)
